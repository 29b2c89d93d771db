"""Features of the global boosted model, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LEVELS, SEASON
from ..functions.calendar import features as calendar_features

#: Days back from the anchor that are features, lengths of the trailing means, same weekdays known, and the
#: days of history that the longest of them needs.
RECENT, MEANS, SAME_WEEKDAYS, LOOKBACK = (0, 1, 6, 13), (7, 28, 91), 4, 91
_HISTORY = (*(f"recent_{k}" for k in RECENT), *(f"mean_{k}" for k in MEANS))
_CALENDAR = ("dow", "day_of_year", "is_holiday", "is_holiday_observed")


def scales(panel: DataFrame, origins: DataFrame) -> DataFrame:
    """``origin, node, scale``: mean of the training window, 1 at least. Prefix sums, so no window is scanned twice."""
    w = Window.partitionBy("node").orderBy("day_idx")
    sums = panel.select("node", (F.col("day_idx") + 1).alias("end"), F.sum("value").over(w).alias("s"))
    ends = sums.join(origins.withColumn("end", F.col("origin_idx") + 1), "end").select("origin", "node", "origin_idx", "train_from", F.col("s").alias("s1"))
    starts = sums.join(origins.select("origin", F.col("train_from").alias("end")), "end").select("origin", "node", F.col("s").alias("s0"))
    both = ends.join(starts, ["origin", "node"], "left")
    mean = (F.col("s1") - F.coalesce("s0", F.lit(0.0))) / (F.col("origin_idx") + 1 - F.col("train_from"))
    return both.select("origin", "node", F.greatest(mean, F.lit(1.0)).alias("scale"))


def _history(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("node").orderBy("day_idx")
    longest = SEASON * (SAME_WEEKDAYS + 2)
    recent = [F.lag("value", k).over(w).alias(f"recent_{k}") if k else F.col("value").alias("recent_0") for k in RECENT]
    means = [F.avg("value").over(w.rowsBetween(1 - k, 0)).alias(f"mean_{k}") for k in MEANS]
    return panel.select("node", "level", "day", "day_idx", F.collect_list("value").over(w.rowsBetween(1 - longest, 0)).alias("known"), *recent, *means)


def design(panel: DataFrame, node_ord: DataFrame, horizon: int, anchors: Column | None = None, extend_years: bool = False) -> DataFrame:
    """``node, day_idx, target_idx`` and the features, unscaled, for every anchor day and step.

    Demand is read at or before the anchor, the calendar at the target day. Days
    without a full look-back have no rows; ``anchors`` narrows the anchor days.
    """
    rows = _history(panel).filter(F.col("day_idx") >= LOOKBACK - 1)
    rows = rows.filter(anchors) if anchors is not None else rows
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    week = F.ceil(F.col("step") / F.lit(float(SEASON))).cast("int")
    same = [F.element_at("known", F.col("step") - 1 - SEASON * (week + k - 1)).alias(f"same_weekday_{k}") for k in range(1, SAME_WEEKDAYS + 1)]
    target = F.date_add("day", F.col("step"))
    own = steps.select("node", "level", "day_idx", (F.col("day_idx") + F.col("step")).alias("target_idx"), target.alias("target"), "step", *same, *_HISTORY)
    span = panel.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", F.date_add("hi", horizon))).alias("day"))
    dates = calendar_features(days, extend_years).select(
        F.col("day").alias("target"), "dow", F.dayofyear("day").alias("day_of_year"), F.col("is_holiday").cast("int").alias("is_holiday"), F.col("is_holiday_observed").cast("int").alias("is_holiday_observed")
    )
    code = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.col("level")) - 1
    series = node_ord.select("node", F.col("node_ord").alias("series"))
    return own.join(dates, "target").join(series, "node").withColumn("level_code", code.cast("int")).select(
        "node", "level", "day_idx", "target_idx", "step", "series", "level_code", *(f"same_weekday_{k}" for k in range(1, SAME_WEEKDAYS + 1)), *_HISTORY, *_CALENDAR
    )
