"""The three-level hierarchy and its daily panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LEVELS, ROOT, Panel
from .checks import bounds


def node_id(*parts: Column | str) -> Column:
    """Path of a node below the root."""
    return F.concat_ws("/", F.lit(ROOT), *parts)


def level_of(borough: Column, area: Column) -> Column:
    return F.when(borough.isNull(), LEVELS[0]).when(area.isNull(), LEVELS[1]).otherwise(LEVELS[2])


def double_owned(paths: DataFrame) -> DataFrame:
    """Areas under more than one borough; a hierarchy has none."""
    return paths.groupBy("area").agg(F.countDistinct("borough").alias("n")).filter("n > 1").select("area")


def nodes(paths: DataFrame) -> DataFrame:
    """``node, level, node_ord``: the root, boroughs by name, then areas by borough and name, whatever the input's order."""
    if double_owned(paths).limit(1).count():
        raise ValueError("an area lies under two boroughs")
    rolled = paths.select("borough", "area").distinct().rollup("borough", "area").agg(F.count("*").alias("c"))
    own = rolled.select(node_id("borough", "area").alias("node"), level_of(F.col("borough"), F.col("area")).alias("level"), "borough", "area")
    rank = F.when(F.col("level") == LEVELS[0], 0).when(F.col("level") == LEVELS[1], 1).otherwise(2)
    # areas are numbered within their borough, and only boroughs in one row; a borough's areas follow those of the boroughs before it
    place = F.row_number().over(Window.partitionBy("level", "borough").orderBy("area"))
    placed = own.withColumn("rank", rank).withColumn("place", place)
    groups = placed.groupBy("rank", "borough").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank", "borough").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select("rank", F.col("borough").alias("of"), before.alias("before"))
    joined = placed.join(starts, (placed["rank"] == starts["rank"]) & placed["borough"].eqNullSafe(starts["of"]))
    return joined.select("node", "level", (F.col("before") + F.col("place") - 1).cast("int").alias("node_ord"))


def summing(paths: DataFrame) -> DataFrame:
    """``node, leaf``: the edges of the summing matrix, three for each leaf."""
    leaf = node_id("borough", "area")
    up = F.array(F.lit(ROOT), node_id("borough"), leaf)
    return paths.select("borough", "area").distinct().select(F.explode(up).alias("node"), leaf.alias("leaf"))


def leaf_quality(counts: DataFrame, rule: Panel = Panel()) -> DataFrame:
    """``area, span, per_day, kept``: a leaf must span most of the window and average enough a day."""
    span = counts.groupBy("area").agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("span"), F.sum("n").alias("n"))
    joined = span.join(F.broadcast(bounds(counts).select("n_days"))).withColumn("per_day", F.col("n") / F.col("n_days"))
    kept = (F.col("span") >= rule.min_coverage * F.col("n_days")) & (F.col("per_day") >= rule.min_daily)
    return joined.select("area", "span", "per_day", kept.alias("kept"))


def dropped_share(counts: DataFrame, rule: Panel = Panel()) -> DataFrame:
    """One row ``dropped, total, share``."""
    judged = counts.join(leaf_quality(counts, rule), "area")
    dropped = F.coalesce(F.sum(F.when(~F.col("kept"), F.col("n"))), F.lit(0.0))
    return judged.agg(dropped.alias("dropped"), F.sum("n").alias("total")).withColumn("share", F.coalesce(F.try_divide("dropped", "total"), F.lit(0.0)))


def dense_grid(counts: DataFrame, rule: Panel = Panel()) -> DataFrame:
    """``day, day_idx, borough, area, n`` for every day and kept area; a day without a row is a zero.

    The days come from an array on each area's row, so nothing is cross-joined.
    """
    kept = leaf_quality(counts, rule).filter("kept").select("area")
    own = counts.join(kept, "area")
    leaves = own.select("borough", "area").distinct().join(F.broadcast(bounds(counts).select("lo", "hi")))
    days = leaves.select("borough", "area", F.posexplode(F.sequence("lo", "hi")).alias("day_idx", "day"))
    return days.join(own.select("day", "area", "n"), ["day", "area"], "left").select("day", "day_idx", "borough", "area", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def panel(counts: DataFrame, rule: Panel = Panel()) -> DataFrame:
    """``node, level, day, day_idx, value``: the dense grid summed up the hierarchy by a rollup."""
    rolled = dense_grid(counts, rule).groupBy("day", "day_idx", "borough", "area").agg(F.sum("n").alias("n"))
    up = rolled.rollup("day_idx", "day", "borough", "area").agg(F.sum("n").alias("value")).filter("day is not null")
    return up.select(node_id("borough", "area").alias("node"), level_of(F.col("borough"), F.col("area")).alias("level"), "day", "day_idx", "value")


def pivot_boroughs(counts: DataFrame, boroughs: list[str]) -> DataFrame:
    """One row per day, one column per borough."""
    return counts.groupBy("day").pivot("borough", boroughs).agg(F.sum("n")).na.fill(0.0)


def coherence(values: DataFrame, edges: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """``keys, error``: the largest breach of a node by the sum of its leaves."""
    leaves = values.select(*keys, F.col("node").alias("leaf"), F.col(value).alias("part"))
    sums = leaves.join(edges, "leaf").groupBy(*keys, "node").agg(F.sum("part").alias("summed"))
    return values.join(sums, [*keys, "node"]).groupBy(*keys).agg(F.max(F.abs(F.col(value) - F.col("summed"))).alias("error"))


def coherent(values: DataFrame, edges: DataFrame, *keys: str, value: str = "value", tolerance: float = 1e-8) -> DataFrame:
    """``keys, coherent``: whether every node is the sum of its leaves, to a tolerance that grows with values over one."""
    size = values.groupBy(*keys).agg(F.greatest(F.max(F.abs(value)), F.lit(1.0)).alias("size"))
    found = coherence(values, edges, *keys, value=value).join(size, list(keys))
    return found.select(*keys, (F.col("error") <= tolerance * F.col("size")).alias("coherent"))
