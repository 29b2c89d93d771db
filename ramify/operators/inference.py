"""Moving-block bootstrap of per-origin scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, RESAMPLES, SEED = 28, 2000, 0
#: Fewer origins than this get no interval.
LEAST_ORIGINS = 4 * BLOCK


def block_starts(n: int, block: int = BLOCK, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """Starts of the blocks of every resample, from one continuing generator."""
    if not 1 <= block <= n:
        raise ValueError("a block must have between 1 and n origins")
    draw = np.random.default_rng(seed)
    return np.vstack([draw.integers(0, n - block + 1, size=-(-n // block)) for _ in range(resamples)])


def block_table(spark: SparkSession, n: int, block: int = BLOCK, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``resample, lo, hi``: block bounds (hi exclusive); the last block is cut so that lengths add up to n."""
    starts = block_starts(n, block, resamples, seed)
    last = n - block * (starts.shape[1] - 1)
    rows = [(r, int(s), int(s) + (last if k == starts.shape[1] - 1 else block)) for r, own in enumerate(starts) for k, s in enumerate(own)]
    return spark.createDataFrame(rows, "resample int, lo int, hi int")


def arithmetic_blocks(spark: SparkSession, n: int, block: int = BLOCK, resamples: int = RESAMPLES) -> DataFrame:
    """Blocks whose starts follow from the resample's number, for comparison with other engines."""
    count = -(-n // block)
    ids = spark.range(resamples * count).select((F.col("id") / count).cast("int").alias("resample"), (F.col("id") % count).cast("int").alias("k"))
    lo = F.pmod((F.col("resample") * 7919 + F.col("k") * 104729 + 12345), F.lit(n - block + 1)).cast("int")
    size = F.when(F.col("k") == count - 1, n - block * (count - 1)).otherwise(block)
    return ids.select("resample", lo.alias("lo"), (lo + size).cast("int").alias("hi"))


def _resamples(blocks: DataFrame) -> DataFrame:
    """One row ``draws``: the blocks of every resample, resamples times blocks of them and no more."""
    each = blocks.groupBy("resample").agg(F.collect_list(F.struct("lo", "hi")).alias("blocks"))
    return each.agg(F.collect_list(F.struct("resample", "blocks")).alias("draws"))


def _drawn(series: DataFrame, blocks: DataFrame, values: list[str], keys: list[str], *more: Column) -> DataFrame:
    """A row for each key and resample with its sums by block and ``__n`` origins; ``more`` are aggregates of the key's series.

    A series becomes one array of running sums, so that a block costs two look-ups
    and the series is computed once.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    running = series.select("*", F.struct("pos", *(F.sum(v).over(w).alias(v) for v in values)).alias("__run"))
    sums = F.transform(F.array_sort(F.collect_list("__run")), lambda r: F.struct(*(r[v].alias(v) for v in values))).alias("__sums")
    rows = running.groupBy(*keys).agg(sums, *more).join(F.broadcast(_resamples(blocks)))
    each = rows.withColumn("__draw", F.explode("draws")).drop("draws")
    upto = lambda k, v: F.when(k > 0, F.element_at("__sums", k)[v]).otherwise(0.0)
    totals = [F.aggregate("__draw.blocks", F.lit(0.0), _adder(upto, v)).alias(v) for v in values]
    n = F.aggregate("__draw.blocks", F.lit(0), lambda a, b: a + b["hi"] - b["lo"]).alias("__n")
    kept = [c for c in rows.columns if c not in ("__sums", "draws", *values)]
    return each.select(*kept, F.col("__draw.resample").alias("resample"), *totals, n)


def _adder(upto, value: str):
    return lambda a, b: a + upto(b["hi"], value) - upto(b["lo"], value)


def resampled_means(series: DataFrame, blocks: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """``keys, resample`` and the means of every resample. ``series`` has ``keys, pos`` (0 to n - 1 without gaps) and the values."""
    found = _drawn(series.select(*keys, "pos", *values), blocks, values, keys)
    return found.select(*keys, "resample", *((F.col(v) / F.col("__n")).alias(v) for v in values))


_ENDS = (0.025, 0.975)


def interval(resampled: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``keys, low, high``: the 2.5 % and 97.5 % points."""
    both = F.percentile(value, F.array(*map(F.lit, _ENDS))).alias("b")
    return resampled.groupBy(*keys).agg(both).select(*keys, F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def skill_interval(series: DataFrame, blocks: DataFrame, keys: list[str], score: str = "score", base: str = "base") -> DataFrame:
    """Interval of 1 - mean(score) / mean(base); both means come from the same drawn origins."""
    means = resampled_means(series, blocks, [score, base], keys)
    return interval(means.withColumn("skill", 1 - F.col(score) / F.col(base)), "skill", keys)


def with_intervals(series: DataFrame, blocks: DataFrame, keys: list[str], values: list[str], statistics: dict[str, Callable[[Callable[[str], Column]], Column]], **aggregates: Column) -> DataFrame:
    """``keys``, aggregates of the series (``keys, pos`` and the values), and each statistic with ``_low`` and ``_high``.

    A statistic is made from means: ``lambda mean: 1 - mean("score") / mean("base")``.
    All statistics of a key come from the same drawn origins, in one pass over it.
    Fewer than ``LEAST_ORIGINS`` origins get no interval.
    """
    if taken := {*statistics, *aggregates} & {*values, *keys}:
        raise ValueError(f"{sorted(taken)} name values of the series")
    points = [of(F.avg).alias(n) for n, of in statistics.items()]
    drawn = _drawn(series, blocks, values, keys, F.count("*").alias("__origins"), *points, *(c.alias(n) for n, c in aggregates.items()))
    mean = lambda v: F.col(v) / F.col("__n")
    ends = [F.percentile(of(mean), F.array(*map(F.lit, _ENDS))).alias(f"__{n}") for n, of in statistics.items()]
    found = drawn.groupBy(*keys).agg(*ends, F.first("__origins").alias("__origins"), *(F.first(n).alias(n) for n in (*statistics, *aggregates)))
    enough = F.col("__origins") >= LEAST_ORIGINS
    at = lambda n, k: F.when(enough, F.col(f"__{n}")[k])
    return found.select(*keys, *aggregates, *(c for n in statistics for c in (n, at(n, 0).alias(f"{n}_low"), at(n, 1).alias(f"{n}_high"))))


def skill_of(score: str = "score", base: str = "base") -> Callable[[Callable[[str], Column]], Column]:
    """The statistic 1 - mean(score) / mean(base)."""
    return lambda mean: 1 - mean(score) / mean(base)


def with_skill_interval(series: DataFrame, blocks: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``keys``, aggregates of the series (``keys, pos, score, base``), and ``low, high`` of its skill, in one pass over it."""
    found = with_intervals(series, blocks, keys, ["score", "base"], {"__skill": skill_of()}, **aggregates)
    return found.select(*keys, *aggregates, F.col("__skill_low").alias("low"), F.col("__skill_high").alias("high"))
