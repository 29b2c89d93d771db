"""Local regression on evenly spaced days, and seasonal-trend decomposition by it.

A smoother's kernel depends on lengths and spans alone, so its rows are made once
and kept; smoothing is then a few matrix products, with robustness weights or
without, for one series or for all cycles of a season at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def kernel(n: int, span: int, before: int = 0, after: int = 0) -> np.ndarray:
    """Tricube weights of ``n`` evenly spaced points (columns) at each of them and at points before and after (rows).

    A row's bandwidth is the distance of its ``span``-th nearest point; with fewer
    points it is that of the farthest one, wider by half of what is missing.
    """
    distance = np.abs(np.arange(-before, n + after)[:, None] - np.arange(n)[None, :]).astype(float)
    width = np.partition(distance, min(span, n) - 1, axis=1)[:, min(span, n) - 1] + max(span - n, 0) // 2
    near = distance / np.maximum(width, 1e-9)[:, None]
    return np.where(near < 0.999, (1 - near**3) ** 3, 0.0) + 0.0 * (near <= 0.001)


def smooth(y: np.ndarray, span: int, degree: int = 1, weights: np.ndarray | None = None, before: int = 0, after: int = 0) -> np.ndarray:
    """Local fits of degree 0 or 1 along the first axis of ``y``, at its points and ``before`` and ``after`` them."""
    n = len(y)
    k, x = kernel(n, span, before, after), np.arange(n, dtype=float)
    at = np.arange(-before, n + after, dtype=float)
    if y.ndim > 1:
        x, at = x[:, None], at[:, None]
    w = np.ones_like(y, dtype=float) if weights is None else weights
    s0, t0 = k @ w, k @ (w * y)
    safe = np.where(s0 > 1e-12, s0, 1.0)
    flat = t0 / safe
    if degree:
        s1, s2, t1 = k @ (w * x), k @ (w * x * x), k @ (w * x * y)
        middle = s1 / safe
        spread = s2 - s1 * middle
        slope = (t1 - middle * t0) / np.where(spread > 1e-9 * safe * n, spread, 1.0)
        flat = np.where(spread > 1e-9 * safe * n, flat + slope * (at - middle), flat)
    if weights is not None and not (s0 > 1e-12).all():  # every point near has lost its weight
        flat = np.where(s0 > 1e-12, flat, smooth(y, span, degree, None, before, after))
    return flat


def _means(y: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(y)])
    return (sums[length:] - sums[:-length]) / length


def _cycles(y: np.ndarray, period: int, span: int, weights: np.ndarray | None) -> np.ndarray:
    """Each day of the cycle smoothed over the cycles, one cycle longer on both sides: ``len(y) + 2 * period`` values."""
    out = np.empty(len(y) + 2 * period)
    whole = len(y) % period  # days of the cycle with one value more
    for first, last in ((0, whole), (whole, period)):
        if first < last:
            rows = np.array([np.arange(k, len(y), period) for k in range(first, last)]).T
            fits = smooth(y[rows], span, 0, None if weights is None else weights[rows], 1, 1)
            for column, k in enumerate(range(first, last)):
                out[k::period][: len(fits)] = fits[:, column]
    return out


def next_odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + (n % 2 == 0)


def stl(y: np.ndarray, period: int, span: int, robust: int = 0, inner: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal part and trend of a series; ``robust`` rounds give far-off days less weight."""
    n = len(y)
    trend, weights = np.zeros(n), None
    slow, low = next_odd(1.5 * period / (1 - 1.5 / span)), next_odd(period)
    for _ in range(robust + 1):
        for _ in range(inner):
            cycles = _cycles(y - trend, period, span, weights)
            passed = _means(_means(_means(cycles, period), period), 3)
            seasonal = cycles[period : period + n] - smooth(passed, low)
            trend = smooth(y - seasonal, slow, 1, weights)
        rest = np.abs(y - seasonal - trend)
        far = 6 * np.median(rest)
        weights = np.ones(n) if far <= 0 else np.where(rest < far, (1 - np.minimum(rest / far, 1) ** 2) ** 2, 0.0)
    return seasonal, trend


def decompose(y: np.ndarray, periods, rounds: int = 2, robust: int = 0) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Seasonal parts of several periods, shortest first and each from what the others leave, and the last trend.

    A period of which the series holds less than two cycles is left out; spans grow from 11 by 4 a period.
    """
    parts = {p: np.zeros(len(y)) for p in sorted(periods) if len(y) >= 2 * p}
    trend = np.zeros(len(y))
    for _ in range(rounds if len(parts) > 1 else 1):
        for i, p in enumerate(parts):
            parts[p], trend = stl(y - sum(s for q, s in parts.items() if q != p), p, 11 + 4 * i, robust)
    if not parts:
        trend = smooth(y, min(len(y), 91))
    return parts, trend


def strength(y: np.ndarray, period: int) -> float:
    """How much of the variance around the trend is seasonal: 0 none, 1 all."""
    if len(y) < 2 * period + 2:
        return 0.0
    seasonal, trend = stl(y, period, 11)
    rest = y - seasonal - trend
    whole = (seasonal + rest).var()
    return max(0.0, 1 - rest.var() / whole) if whole > 0 else 0.0
