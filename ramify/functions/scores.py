"""Scores of quantile forecasts as column expressions; the quantile axis is an array column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import check_levels, interval_levels, level_index


def levels_array(levels) -> Column:
    check_levels(levels)
    return F.array(*(F.lit(float(q)) for q in levels))


def pinball(q: Column, y: Column, level: Column | float) -> Column:
    e = y - q
    return F.greatest(F.lit(level) * e, (F.lit(level) - 1) * e)


def pinball_grid(q: Column, y: Column, levels) -> Column:
    """Pinball loss at every level."""
    return F.zip_with(q, levels_array(levels), lambda v, t: pinball(v, y, t))


def crps(q: Column, y: Column, levels) -> Column:
    """Twice the integral of pinball loss over the levels: trapezoids between them, and exact tails where the outer quantiles stay flat."""
    check_levels(levels)
    n, first, last = len(levels), float(levels[0]), float(levels[-1])
    losses = pinball_grid(q, y, levels)
    # the trapezoid rule gives every loss half the distance between its neighbours
    weights = [(levels[min(k + 1, n - 1)] - levels[max(k - 1, 0)]) / 2 for k in range(n)]
    inner = F.aggregate(F.zip_with(losses, F.array(*(F.lit(float(w)) for w in weights)), lambda a, w: a * w), F.lit(0.0), lambda a, x: a + x)
    low, high = y - F.element_at(q, 1), y - F.element_at(q, n)
    lower = F.when(low >= 0, first**2 / 2 * low).otherwise((first - first**2 / 2) * -low)
    upper = F.when(high >= 0, (1 - last**2) / 2 * high).otherwise((1 - last) ** 2 / 2 * -high)
    return 2 * (inner + lower + upper)


def crps_normal(mean: float, deviation: float, y: float) -> float:
    """Closed form for a normal distribution, for tests."""
    z = (y - mean) / deviation
    density, below = math.exp(-z * z / 2) / math.sqrt(2 * math.pi), (1 + math.erf(z / math.sqrt(2))) / 2
    return deviation * (z * (2 * below - 1) + 2 * density - 1 / math.sqrt(math.pi))


def crosses(q: Column) -> Column:
    """True if any quantile lies below the one before."""
    return F.exists(F.zip_with(F.slice(q, 2, 10**6), F.slice(q, 1, F.size(q) - 1), lambda b, a: b < a), lambda x: x)


def repaired(q: Column) -> Column:
    """Quantiles in order."""
    return F.array_sort(q)


def bounds(q: Column, levels, coverage: float) -> tuple[Column, Column]:
    lo, hi = interval_levels(coverage)
    return F.element_at(q, level_index(levels, lo) + 1), F.element_at(q, level_index(levels, hi) + 1)


def covered(y: Column, low: Column, high: Column) -> Column:
    """Inside the closed interval."""
    return (y >= low) & (y <= high)


def _share(value: Column, whole: Column, strict: bool, name: str) -> Column:
    """``value``, null where ``whole`` isn't positive; strict: that ends the query, and only an unknown whole gives null."""
    if not strict:
        return F.when(whole > 0, value)
    refused = F.raise_error(F.concat(F.lit(f"{name} needs a positive divisor, not "), whole.cast("string"))).cast("double")
    return F.when(whole <= 0, refused).when(whole > 0, value)


def relative_width(low: Column, high: Column, y: Column, strict: bool = False) -> Column:
    """Width as a share of the outcome; null where that isn't positive, or refused if ``strict``."""
    return _share((high - low) / y, y, strict, "relative width")


def skill(score: Column, base: Column, strict: bool = False) -> Column:
    """Share of the baseline's score saved; null where that isn't positive, or refused if ``strict``."""
    return _share(1 - score / base, base, strict, "skill")


def score_forecasts(forecasts: DataFrame, actuals: DataFrame, levels, reporting, nominal) -> DataFrame:
    """Forecasts (``model, origin, node, step, q``) against actuals: CRPS, pinball losses, absolute error, hits and widths."""
    at = [level_index(levels, q) + 1 for q in reporting]
    joined = forecasts.join(actuals, ["origin", "node", "step"])
    q, y = F.col("q"), F.col("y")
    pairs = [bounds(q, levels, c) for c in nominal]
    shown = F.array(*(F.element_at(q, k) for k in at))
    return joined.select(
        "model", "origin", "node", "level", "step", "y",
        crps(q, y, levels).alias("crps"),
        pinball_grid(shown, y, reporting).alias("pinball"),
        F.abs(y - F.element_at(q, level_index(levels, 0.5) + 1)).alias("abs_error"),
        F.array(*(covered(y, lo, hi) for lo, hi in pairs)).alias("hits"),
        F.array(*(hi - lo for lo, hi in pairs)).alias("widths"),
    )


def by_origin(scores: DataFrame, value: Column, name: str) -> DataFrame:
    """Mean over a level's nodes and all steps: ``model, level, origin, name``."""
    return scores.groupBy("model", "level", "origin").agg(F.avg(value).alias(name))


def rolling(rows: DataFrame, value: str, window: int, keys: list[str], order: str = "origin") -> DataFrame:
    """Trailing mean ``rolling``; null until the window is full of values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def worst_window(rows: DataFrame, value: str, window: int, keys: list[str], order: str = "origin") -> DataFrame:
    """The first lowest full window of each key: ``keys, order, worst``."""
    full = rolling(rows, value, window, keys, order).filter("rolling is not null")
    best = F.min(F.struct(F.col("rolling").alias("worst"), F.col(order))).alias("w")
    return full.groupBy(*keys).agg(best).select(*keys, f"w.{order}", "w.worst")


def extent(rows: DataFrame, value: str, keys: list[str], order: str = "origin") -> DataFrame:
    """``keys, mean, lowest, lowest_at, low, high`` of the finite values of a series; the lowest is the first of its size."""
    own = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    least = F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("at"))).alias("w")
    found = own.groupBy(*keys).agg(F.avg(value).alias("mean"), least, F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(*keys, "mean", F.col("w.v").alias("lowest"), F.col("w.at").alias("lowest_at"), "low", "high")
