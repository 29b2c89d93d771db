"""Forecast origins, their training and target days, and the actuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Schedule


def origins(spark: SparkSession, n_days: int, schedule: Schedule = DEFAULT) -> DataFrame:
    """``origin, origin_idx, train_from, refit, refit_origin``: day indexes count from 0, the origin's day is the last one known."""
    rows = spark.range(schedule.count(n_days)).select(F.col("id").cast("int").alias("origin"))
    idx = F.lit(schedule.min_train - 1) + F.col("origin") * schedule.step
    start = F.greatest(idx + 1 - schedule.train_window, F.lit(0)) if schedule.train_window else F.lit(0)
    late = F.col("origin") % schedule.refit_every
    return rows.select("origin", idx.alias("origin_idx"), start.alias("train_from"), (late == 0).alias("refit"), (F.col("origin") - late).alias("refit_origin"))


def n_days(panel: DataFrame) -> int:
    return (panel.agg(F.max("day_idx")).first()[0] or 0) + 1


def targets(schedule_rows: DataFrame, schedule: Schedule = DEFAULT) -> DataFrame:
    """``origin, origin_idx, step, target_idx``."""
    steps = schedule_rows.select("origin", "origin_idx", F.explode(F.sequence(F.lit(1), F.lit(schedule.horizon))).alias("step"))
    return steps.withColumn("target_idx", F.col("origin_idx") + F.col("step"))


def covering(schedule_rows: DataFrame, day_idx: int, schedule: Schedule = DEFAULT) -> DataFrame:
    """Origins whose horizon covers a day."""
    return schedule_rows.filter(F.lit(day_idx).between(F.col("origin_idx") + 1, F.col("origin_idx") + schedule.horizon))


def actuals(panel: DataFrame, schedule_rows: DataFrame, schedule: Schedule = DEFAULT) -> DataFrame:
    """``origin, node, level, step, y``: an equality join on the target day."""
    wanted = targets(schedule_rows, schedule)
    return panel.join(wanted, panel.day_idx == wanted.target_idx).select("origin", "node", "level", "step", F.col("value").alias("y"))


#: Windows on which a pretrained model may be judged, by the first origin day of each. The second is
#: part of the first and no second result.
WINDOWS = (("clean", "2023-11-30"), ("cross_check", "2025-09-15"))


def dated(schedule_rows: DataFrame, days: DataFrame) -> DataFrame:
    """``origin, origin_idx, day``; ``days`` has ``day, day_idx``."""
    own = days.select("day", F.col("day_idx").alias("origin_idx")).distinct()
    return schedule_rows.select("origin", "origin_idx").join(own, "origin_idx").select("origin", "origin_idx", "day")


def clean_origins(schedule_rows: DataFrame, days: DataFrame, cutoff: str) -> DataFrame:
    """Origins from the first whose day reaches the cutoff; a schedule without one is refused."""
    clean = dated(schedule_rows, days).filter(F.col("day") >= F.lit(cutoff).cast("date"))
    if not clean.limit(1).count():
        raise ValueError(f"no clean window: no origin lies at or after {cutoff}")
    return clean


def in_windows(rows: DataFrame, origin_days: DataFrame, windows=WINDOWS) -> DataFrame:
    """``rows`` (``origin``) once for each named window that holds its origin, with ``window`` and the window's ``first_day``.

    Windows overlap and are never pooled: group by ``window`` from here on.
    """
    first = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(d).cast("date").alias("cutoff")) for n, d in windows))
    member = origin_days.select("origin", "day", F.explode(first).alias("w")).filter("day >= w.cutoff").select("origin", "day", "w.window")
    opens = member.groupBy("window").agg(F.min("day").alias("first_day"))
    return rows.join(member.drop("day"), "origin").join(opens, "window")
