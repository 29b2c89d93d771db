"""Exponential smoothing and Theta, fitted for many windows at once.

All forms of all windows of a batch are rows of one recursion over days, and one
downhill simplex moves for each of them in lockstep, so that a step of Python serves
hundreds of fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from statistics import NormalDist

import numpy as np

from ..config import SEASON

#: Simplex moves of a fit, and simulated paths where a variance has no closed form.
MOVES, PATHS = 40, 2000
#: Smoothing parameters between which the simplex begins: level, trend and season as shares of what is admissible, damping.
_BEGINS = np.array(list(product((0.05, 0.2, 0.5), (0.02, 0.2), (0.05, 0.3), (0.95,))))


def simplexes(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, moves: int, size: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Least points and values of many problems; ``f(problems, points)`` gives one value a row. Never worse than ``start``."""
    m, d = start.shape
    every = np.arange(m)
    points = np.concatenate([start[:, None, :], start[:, None, :] + size * np.eye(d)[None]], axis=1)
    values = f(np.repeat(every, d + 1), points.reshape(-1, d)).reshape(m, d + 1)
    stretch = np.array([1.0, 2.0, 0.5, -0.5])
    for _ in range(moves):
        order = values.argsort(axis=1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], 1), np.take_along_axis(values, order, 1)
        middle = points[:, :-1].mean(axis=1)
        tried = middle[:, None, :] + stretch[None, :, None] * (middle - points[:, -1])[:, None, :]
        found = f(np.repeat(every, 4), tried.reshape(-1, d)).reshape(m, 4)
        plain, best, worst = found[:, 0], values[:, 0], values[:, -1]
        pick = np.where(plain < best, np.where(found[:, 1] < plain, 1, 0), np.where(plain < values[:, -2], 0, np.where(plain < worst, 2, 3)))
        own = found[every, pick]
        better = own < worst
        points[better, -1], values[better, -1] = tried[every, pick][better], own[better]
        shrink = np.flatnonzero(~better)
        if len(shrink):
            points[shrink, 1:] = points[shrink, :1] + 0.5 * (points[shrink, 1:] - points[shrink, :1])
            values[shrink, 1:] = f(np.repeat(shrink, d), points[shrink, 1:].reshape(-1, d)).reshape(-1, d)
    at = values.argmin(axis=1)
    return points[every, at], values[every, at]


def _share(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# exponential smoothing


@dataclass(frozen=True)
class Form:
    """``error``, ``trend`` and ``season``: N none, A added, M multiplied, D an added trend that fades."""

    error: str
    trend: str
    season: str

    def count(self, season: int) -> int:
        """Parameters with first states and the variance."""
        return 3 + {"N": 0, "A": 2, "D": 3}[self.trend] + season * (self.season != "N")


#: Every form but those whose variance can grow without bound: an added error on multiplied seasons.
FORMS = tuple(Form(e, t, s) for e, t, s in product("AM", "NAD", "NAM") if (e, s) != ("A", "M"))


def parameters(free: np.ndarray, trends: np.ndarray, seasons: np.ndarray) -> np.ndarray:
    """Level, trend, season and damping parameters inside the usual bounds, from any numbers (rows, 4)."""
    alpha = 1e-4 + 0.9998 * _share(free[:, 0])
    beta = np.where(trends > 0, alpha * _share(free[:, 1]), 0.0)
    gamma = np.where(seasons > 0, (1 - alpha) * _share(free[:, 2]), 0.0)
    phi = np.where(trends == 0, 0.0, np.where(trends == 1, 1.0, 0.8 + 0.18 * _share(free[:, 3])))
    return np.stack([alpha, beta, gamma, phi], axis=1)


def run(x: np.ndarray, window: np.ndarray, values: np.ndarray, times: np.ndarray, seasonal: np.ndarray, season: int) -> tuple[np.ndarray, ...]:
    """Smooth rows of windows ``x``: sums of squared errors, of squared relative errors and of logarithms of the means, and the last states.

    Rows whose level or mean isn't above 0 where it has to be have infinite sums.
    """
    a, b, g, p = values.T
    cycles = x[:, : 2 * season].reshape(len(x), 2, season).mean(axis=1)
    mean = cycles.mean(axis=1)
    added, factors = cycles - mean[:, None], np.maximum(cycles / np.where(mean > 0, mean, 1.0)[:, None], 1e-2)
    s = np.where(times[:, None], factors[window], np.where(seasonal[:, None], added[window], 0.0)).T.copy()
    level, trend, days = mean[window].copy(), np.zeros(len(window)), x.T[:, window] if len(window) <= 4096 else None
    squares, relative, logs = np.zeros(len(window)), np.zeros(len(window)), np.zeros(len(window))
    broken = np.zeros(len(window), bool)
    gs = g * (seasonal | times)
    for t in range(x.shape[1]):
        own = s[t % season]
        base = level + p * trend
        safe = np.where(times, np.maximum(base, 1e-6), 1.0)
        ahead = np.where(times, base * own, base + own)
        error = (days[t] if days is not None else x[window, t]) - ahead
        squares += error * error
        above = np.maximum(ahead, 1e-6)
        broken |= ahead < 1e-6
        part = error / above
        relative += part * part
        logs += np.log(above)
        part = error / np.where(times, own, 1.0)
        level = base + a * part
        trend = p * trend + b * part
        new = own + gs * error / safe
        s[t % season] = np.where(times, np.maximum(new, 1e-3), new)
    return squares, relative, logs, broken, level, trend, s.T


def fit_ets(x: np.ndarray, season: int = SEASON, forms: tuple[Form, ...] = FORMS, moves: int = MOVES) -> list[tuple[Form, np.ndarray, float, float, float, float, np.ndarray]]:
    """For each window (rows of ``x``) the form of least AICc: form, parameters, AICc, variance, last level, trend and seasons."""
    x = np.asarray(x, float)
    if season <= 1:
        forms, season = tuple(f for f in forms if f.season == "N"), 1
    n, problems = x.shape[1], [(w, f) for w in range(len(x)) for f in forms if (f.error == "A" and f.season != "M") or x[w].min() > 0]
    windows = np.array([w for w, _ in problems])
    trends = np.array(["NAD".index(f.trend) for _, f in problems])
    seasons = np.array(["NAM".index(f.season) for _, f in problems])
    relative = np.array([f.error == "M" for _, f in problems])

    def deviance(rows: np.ndarray, free: np.ndarray) -> np.ndarray:
        values = parameters(free, trends[rows], seasons[rows])
        squares, ratios, logs, broken, *_ = run(x, windows[rows], values, seasons[rows] == 2, seasons[rows] == 1, season)
        own = np.where(relative[rows], n * np.log(np.maximum(ratios / n, 1e-300)) + 2 * logs, n * np.log(np.maximum(squares / n, 1e-300)))
        return np.where(np.isfinite(own) & ~(relative[rows] & broken), own, 1e300)

    odds = lambda share: np.log(share / (1 - share))
    begins = np.column_stack([odds(_BEGINS[:, :3]), odds((_BEGINS[:, 3] - 0.8) / 0.18)])
    every = np.arange(len(problems))
    first = deviance(np.repeat(every, len(begins)), np.tile(begins, (len(every), 1))).reshape(len(every), -1)
    free, least = simplexes(deviance, begins[first.argmin(axis=1)], moves)
    k = np.array([f.count(season) for _, f in problems], float)
    scores = least + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1)
    best = [int(min(np.flatnonzero(windows == w), key=lambda i: scores[i])) for w in range(len(x))]
    values = parameters(free[best], trends[best], seasons[best])
    squares, ratios, _, _, level, trend, s = run(x, windows[best], values, seasons[best] == 2, seasons[best] == 1, season)
    variances = np.where(relative[best], ratios, squares) / n
    return [(problems[i][1], values[j], float(scores[i]), float(variances[j]), float(level[j]), float(trend[j]), s[j]) for j, i in enumerate(best)]


def ets_quantiles(fitted: tuple, n: int, horizon: int, levels: np.ndarray, season: int = SEASON) -> np.ndarray:
    """Quantiles (horizon, levels) from the last states: normal for added errors, from simulated paths for relative ones; not under 0."""
    form, (a, b, g, p), _, variance, level, trend, s = fitted
    season = season if season > 1 else 1
    h = np.arange(1, horizon + 1)
    if form.error == "A":
        fade = np.cumsum(p**h)
        mean = level + fade * trend + s[(n + h - 1) % season]
        c = a + b * np.concatenate([[0.0], fade[:-1]]) + (g * (np.arange(horizon) % season == 0) if form.season == "A" else 0.0)
        deviation = np.sqrt(variance * (1 + np.concatenate([[0.0], np.cumsum(c[1:] ** 2)])))
        z = np.array([NormalDist().inv_cdf(float(q)) for q in levels])
        return np.maximum(mean[:, None] + deviation[:, None] * z, 0.0)
    half = np.random.default_rng(0).normal(size=(PATHS // 2, horizon))
    shocks = np.sqrt(variance) * np.concatenate([half, -half])  # the same draws for every window
    level, trend, s = np.full(PATHS, level), np.full(PATHS, trend), np.tile(s, (PATHS, 1))
    out = np.empty((PATHS, horizon))
    for j in range(horizon):
        k = (n + j) % season
        base, own = level + p * trend, s[:, k].copy()
        ahead = base * own if form.season == "M" else base + own
        error = ahead * np.maximum(shocks[:, j], -0.999)
        out[:, j] = ahead + error
        part = error / own if form.season == "M" else error
        level, trend = base + a * part, p * trend + b * part
        if form.season != "N":
            s[:, k] = np.maximum(own + g * error / np.maximum(base, 1e-6), 1e-3) if form.season == "M" else own + g * error
    return np.maximum(np.quantile(out, levels, axis=0).T, 0.0)


# theta


def _lines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and slope of the least-squares line through the first 1, 2, ... n days of each window; days count from 1."""
    n = x.shape[1]
    t = np.arange(1, n + 1)
    sums, weighted = np.cumsum(x, axis=1), np.cumsum(x * t, axis=1)
    spread = t * (t * t - 1) / 12.0
    slope = np.where(t > 1, (weighted - sums * (t + 1) / 2) / np.where(spread > 0, spread, 1.0), 0.0)
    return sums / t - slope * (t + 1) / 2, slope


def seasonal_indices(x: np.ndarray, season: int = SEASON) -> np.ndarray:
    """Factors by day of the cycle from centred moving averages, or ones where the series isn't positive or shows no season.

    A season shows if the autocorrelation at its length is beyond the 90 % bound
    that the shorter lags leave.
    """
    n, e = len(x), x - x.mean()
    if n < 3 * season or x.min() <= 0 or e @ e <= 0:
        return np.ones(season)
    r = np.array([e[k:] @ e[: n - k] for k in range(1, season + 1)]) / (e @ e)
    if abs(r[-1]) <= 1.645 * np.sqrt((1 + 2 * (r[:-1] ** 2).sum()) / n):
        return np.ones(season)
    wide = np.ones(season) / season if season % 2 else np.r_[0.5, np.ones(season - 1), 0.5] / season
    trend = np.convolve(x, wide, mode="valid")
    ratio, begin = x[len(wide) // 2 : len(wide) // 2 + len(trend)] / trend, len(wide) // 2
    index = np.array([ratio[(k - begin) % season :: season].mean() for k in range(season)])
    return index / index.mean()


#: The four forms: whether the strength of the line is fitted, and whether the line is that of the days so far.
THETAS = ((False, False), (True, False), (False, True), (True, True))


def fit_theta(x: np.ndarray, moves: int = MOVES) -> list[tuple[tuple[bool, bool], float, float, float, float, np.ndarray, float]]:
    """For each window (rows of ``x``, without season) the form of least squared error: form, alpha, theta, mean square, last level, lines, first level."""
    x = np.asarray(x, float)
    m, n = x.shape
    level, slope = _lines(x)
    window, form = np.repeat(np.arange(m), 4), np.tile(np.arange(4), m)
    fitted, moving = np.array([f for f, _ in THETAS])[form], np.array([d for _, d in THETAS])[form]
    unit = np.maximum(x.std(axis=1), 1e-9)
    # the line that each problem knows on each day: that of the days before it, or the whole one
    before = lambda line: np.concatenate([line[:, :1] * 0, line[:, :-1]], axis=1)
    starts, slopes = (np.where(moving[:, None], before(line)[window], line[window, -1:]).T.copy() for line in (level, slope))
    days = x.T[:, window].copy()

    def values(rows: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alpha = 0.01 + 0.98 * _share(free[:, 0])
        theta = np.where(fitted[rows], 1 + np.exp(np.clip(free[:, 1], -6, 6)), 2.0)
        return alpha, theta, x[window[rows], 0] + free[:, 2] * unit[window[rows]]

    def errors(rows: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, theta, now = values(rows, free)
        y, kept = days[:, rows], 1 - alpha
        fading = kept ** np.arange(n)[:, None]
        lines = (1 - 1 / theta) * (fading * starts[:, rows] + (1 - fading * kept) / alpha * slopes[:, rows])
        total, part = 0.0, alpha * y
        for t in range(n):
            e = y[t] - now - lines[t]
            total = total + e * e
            now = part[t] + kept * now
        return total / n, now

    start = np.tile([0.0, 0.0, 0.0], (4 * m, 1))
    free, least = simplexes(lambda rows, points: errors(rows, points)[0], start, moves)
    best = np.array([4 * w + int(least[4 * w : 4 * w + 4].argmin()) for w in range(m)])
    alpha, theta, first = values(best, free[best])
    _, last = errors(best, free[best])
    return [(THETAS[form[i]], float(alpha[w]), float(theta[w]), float(least[i]), float(last[w]), np.array([level[w, -1], slope[w, -1]]), float(first[w])) for w, i in enumerate(best)]


def theta_ahead(fitted: tuple, n: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each day ahead; a moving line takes its own forecasts in as days that came."""
    (_, moving), alpha, theta, variance, now, (level, slope), _ = fitted
    part, mean = 1 - 1 / theta, level + slope * (n + 1) / 2
    out = np.empty(horizon)
    for j in range(horizon):
        t = n + j  # days known
        out[j] = now + part * ((1 - alpha) ** t * level + (1 - (1 - alpha) ** (t + 1)) / alpha * slope)
        now = alpha * out[j] + (1 - alpha) * now
        if moving:
            slope = ((t - 1) * slope + 6 * (out[j] - mean) / (t + 1)) / (t + 2)
            mean = (t * mean + out[j]) / (t + 1)
            level = mean - slope * (t + 2) / 2
    return out, np.sqrt(variance * (1 + np.arange(horizon) * alpha**2))
