"""Assignment of areas to boroughs and checks of daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assign_areas(counts: DataFrame) -> DataFrame:
    """``area, borough``: each area's borough with the most counts, ties to the first name."""
    totals = counts.groupBy("area", "borough").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("n"), "borough"))
    return totals.withColumn("place", place).filter("place = 1").select("area", "borough")


def recount(counts: DataFrame, areas: DataFrame) -> DataFrame:
    """``day, borough, area, n`` with each area under its assigned borough."""
    return counts.drop("borough").join(areas, "area").groupBy("day", "borough", "area").agg(F.sum("n").alias("n"))


def disagreement(counts: DataFrame, areas: DataFrame, most: int = 10) -> DataFrame:
    """``area, assigned, moved, total, share``: the areas whose counts the assignment moved most, ties by name."""
    joined = counts.join(areas.withColumnRenamed("borough", "assigned"), "area")
    moved = F.sum(F.when(F.col("borough") != F.col("assigned"), F.col("n")).otherwise(0))
    by_area = joined.groupBy("area", "assigned").agg(moved.alias("moved"), F.sum("n").alias("all"))
    total = by_area.agg(F.sum("all").alias("total"), (F.sum("moved") / F.sum("all")).alias("share"))
    worst = by_area.filter("moved > 0").orderBy(F.desc("moved"), "area").limit(most)
    return worst.join(F.broadcast(total)).select("area", "assigned", "moved", "total", "share")


def bounds(counts: DataFrame) -> DataFrame:
    """One row ``lo, hi, n_days``; of an empty table all are null."""
    return counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).withColumn("n_days", F.datediff("hi", "lo") + 1)


def calendar(counts: DataFrame) -> DataFrame:
    """Every day from the first to the last."""
    return bounds(counts).select(F.explode(F.sequence("lo", "hi")).alias("day"))


def missing_days(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys, day``: days inside the record on which there is no row at all, or none of a key."""
    if not keys:
        return calendar(counts).join(counts.select("day").distinct(), "day", "left_anti")
    span = bounds(counts).select(F.sequence("lo", "hi").alias("days"))
    wanted = counts.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode("days").alias("day"))
    return wanted.join(counts.select(*keys, "day").distinct(), [*keys, "day"], "left_anti")


def coverage(counts: DataFrame) -> DataFrame:
    """``area, first, last, active_days, n, share``: how much of the record each area is active for."""
    own = counts.groupBy("area").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.countDistinct("day").alias("active_days"), F.sum("n").alias("n")
    )
    return own.join(F.broadcast(bounds(counts).select("n_days"))).withColumn("share", F.col("active_days") / F.col("n_days")).drop("n_days")


def outliers(series: DataFrame, threshold: float = 6.0, value: str = "value") -> DataFrame:
    """``day, value, z``: days far from the median in robust deviations (1.4826 MAD; the standard deviation where MAD is 0)."""
    centre = series.agg(F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("deviation"))
    off = series.join(F.broadcast(centre)).withColumn("off", F.col(value) - F.col("median"))
    mad = off.agg((F.percentile(F.abs("off"), F.lit(0.5)) * 1.4826).alias("mad"))
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("deviation") > 0, F.col("deviation"))
    scored = off.join(F.broadcast(mad)).withColumn("z", F.col("off") / scale)
    return scored.filter(F.abs("z") > threshold).select("day", F.col(value).alias("value"), "z")
