"""Exponential smoothing and Theta for many windows against loops over days."""

import math

import numpy as np
import pytest
from ramify.operators import smoothing, statistical

RNG = np.random.default_rng(0)
T = np.arange(140)
WINDOWS = np.stack([
    100 + 10 * np.sin(2 * np.pi * T / 7) + RNG.normal(0, 3, 140), (80 + 0.5 * T) * (1 + 0.3 * np.sin(2 * np.pi * T / 7)) * np.exp(RNG.normal(0, 0.05, 140)),
    50 + np.cumsum(RNG.normal(0, 2, 140)), RNG.poisson(3, 140).astype(float),
])


def plain_run(x, form, values, season=7):
    """Errors and means of one form, day by day, by the textbook equations of its own error."""
    a, b, g, p = values
    cycles = x[: 2 * season].reshape(2, season).mean(axis=0)
    level, trend, mean = x[: 2 * season].mean(), 0.0, cycles.mean()
    s = list({"N": np.zeros(season), "A": cycles - mean, "M": np.maximum(cycles / mean, 1e-2)}[form.season])
    errors, means = [], []
    for t, y in enumerate(x):
        k, base = t % season, level + p * trend
        mu = base * s[k] if form.season == "M" else base + s[k]
        if form.error == "A":
            e = y - mu
            level, trend, s[k] = base + a * e, p * trend + b * e, s[k] + g * e
        else:
            e = (y - mu) / mu
            if form.season == "M":
                level, trend, s[k] = base * (1 + a * e), p * trend + b * base * e, s[k] * (1 + g * e)
            else:
                level, trend, s[k] = base + a * mu * e, p * trend + b * mu * e, s[k] + g * mu * e
        errors.append(e)
        means.append(mu)
    return np.array(errors), np.array(means), level, trend, s


@pytest.mark.parametrize("form", smoothing.FORMS, ids=lambda f: f.error + f.trend + f.season)
def test_recursion_equals_the_textbook(form):
    free = np.array([[-1.0, -2.0, -1.5, 0.3]])
    values = smoothing.parameters(free, np.array(["NAD".index(form.trend)]), np.array(["NAM".index(form.season)]))
    squares, ratios, logs, broken, level, trend, s = smoothing.run(WINDOWS[:2], np.array([1]), values, np.array([form.season == "M"]), np.array([form.season == "A"]), 7)
    errors, means, last, slope, seasons = plain_run(WINDOWS[1], form, values[0])
    assert level[0] == pytest.approx(last) and trend[0] == pytest.approx(slope) and np.allclose(s[0], seasons)
    assert (squares if form.error == "A" else ratios)[0] == pytest.approx((errors**2).sum())
    assert logs[0] == pytest.approx(np.log(means).sum()) and not broken[0]


def test_no_begin_is_better_than_what_the_search_finds():
    n = WINDOWS.shape[1]
    for x, (form, values, found, variance, *_) in zip(WINDOWS, smoothing.fit_ets(WINDOWS), strict=True):
        assert 0 < values[0] < 1 and values[1] <= values[0] and values[2] <= 1 - values[0]
        scores = []
        for f in smoothing.FORMS:
            if (f.error == "M" or f.season == "M") and x.min() <= 0:
                continue
            for a, b, g, p in smoothing._BEGINS:
                own = (a, a * b * (f.trend != "N"), (1 - a) * g * (f.season != "N"), {"N": 0.0, "A": 1.0, "D": p}[f.trend])
                errors, means, *_ = plain_run(x, f, own)
                if f.error == "M" and means.min() < 1e-6:
                    continue
                k = f.count(7)
                deviance = n * math.log((errors**2).mean()) + (2 * np.log(means).sum() if f.error == "M" else 0.0)
                scores.append(deviance + 2 * k + 2 * k * (k + 1) / (n - k - 1))
        assert found <= min(scores) + 1e-6
        errors, *_ = plain_run(x, form, values)
        assert variance == pytest.approx((errors**2).mean())


def test_simulated_quantiles_near_the_normal_ones_where_both_hold():
    levels = np.array([0.05, 0.25, 0.5, 0.75, 0.95])
    s = np.zeros(7)
    for season in ("N", "A"):
        values, level = np.array([0.2, 0.0, 0.05 * (season == "A"), 0.0]), 1000.0
        relative = smoothing.ets_quantiles((smoothing.Form("M", "N", season), values, 0.0, 0.02**2, level, 0.0, s), 70, 14, levels)
        added = smoothing.ets_quantiles((smoothing.Form("A", "N", season), values, 0.0, 20.0**2, level, 0.0, s), 70, 14, levels)
        assert np.allclose(relative, added, atol=3.5)


def test_windows_fitted_together_equal_those_fitted_alone():
    levels = np.array([0.1, 0.5, 0.9])
    for one, many in statistical.TOGETHER.items():
        together = many(WINDOWS, 14, levels)
        for x, q in zip(WINDOWS, together, strict=True):
            assert np.allclose(one(x, 14, levels), q, rtol=1e-9, atol=1e-9)
            assert q.shape == (14, 3) and np.isfinite(q).all() and (q >= 0).all()


def plain_theta(x, alpha, theta, first, moving):
    """One form of Theta with its lines fitted anew each day; squared error, last level."""
    n, level, total = len(x), first, 0.0
    for t in range(n):
        known = x[:t] if moving else x
        days = np.arange(1, len(known) + 1)
        if len(known) == 0:
            a = b = 0.0
        elif len(known) == 1:
            a, b = known[0], 0.0
        else:
            b, a = np.polyfit(days, known, 1)
        ahead = level + (1 - 1 / theta) * ((1 - alpha) ** t * a + (1 - (1 - alpha) ** (t + 1)) / alpha * b)
        total += (x[t] - ahead) ** 2
        level = alpha * x[t] + (1 - alpha) * level
    return total / n, level


def test_theta_errors_equal_lines_fitted_each_day():
    for x, found in zip(WINDOWS, smoothing.fit_theta(WINDOWS), strict=True):
        (_, moving), alpha, theta, square, last, _, first = found
        assert (square, last) == pytest.approx(plain_theta(x, alpha, theta, first, moving))
        for strength, moves in smoothing.THETAS:
            for a in (0.05, 0.3, 0.6):
                assert square <= plain_theta(x, a, 4.0 if strength else 2.0, x[0], moves)[0] * 1.02


def test_moving_line_takes_its_forecasts_in():
    x = WINDOWS[2]
    b, a = np.polyfit(np.arange(1, 141), x, 1)
    out, deviation = smoothing.theta_ahead(((True, True), 0.3, 3.0, 4.0, x[-1], np.array([a, b]), 0.0), 140, 6)
    known, level = list(x), x[-1]
    for j in range(6):
        slope, start = np.polyfit(np.arange(1, len(known) + 1), known, 1)
        want = level + (1 - 1 / 3.0) * (0.7 ** (140 + j) * start + (1 - 0.7 ** (141 + j)) / 0.3 * slope)
        assert out[j] == pytest.approx(want)
        level = 0.3 * want + 0.7 * level
        known.append(want)
    assert deviation == pytest.approx([2 * math.sqrt(1 + j * 0.09) for j in range(6)])


def test_seasons_are_taken_out_only_where_they_show():
    assert np.allclose(smoothing.seasonal_indices(100 + np.random.default_rng(1).normal(0, 5, 700)), 1)
    week = np.array([1.3, 1.1, 1.0, 0.95, 0.9, 0.8, 0.95])
    assert np.allclose(smoothing.seasonal_indices(100 * np.tile(week, 60)), week / week.mean(), atol=1e-9)
    assert np.allclose(smoothing.seasonal_indices(np.zeros(100)), 1) and np.allclose(smoothing.seasonal_indices(np.arange(5.0) + 1), 1)


def test_edge_windows_have_forecasts():
    for x in (np.zeros(60), np.full(60, 4.0), np.arange(60.0), np.tile([5.0, 0, 0, 0, 0, 0, 0], 9)):
        for model in statistical.MODELS.values():
            q = model(x, 14, np.array([0.1, 0.5, 0.9]))
            assert q.shape == (14, 3) and np.isfinite(q).all() and (q >= 0).all()
