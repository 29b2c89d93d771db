"""Tables that queries share: panel, schedule, actuals, forecasts, scores."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, NOMINAL, REPORTING, Schedule
from ..functions import scores
from ..operators import hierarchy, naive, schedule as plan
from ..sources import star


@dataclass(frozen=True)
class Setup:
    """Panel, origins, hierarchy edges and node order of one folder of tables."""

    counts: DataFrame
    panel: DataFrame
    origins: DataFrame
    edges: DataFrame
    nodes: DataFrame
    schedule: Schedule
    n_days: int

    def actuals(self) -> DataFrame:
        return plan.actuals(self.panel, self.origins, self.schedule)


#: The tables cached last: session, folder, counts, panel, number of days.
_held: list[tuple] = []


#: Lets Spark choose a cached table's partitions by its size, as it does for other results.
BY_SIZE = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def cached(table: DataFrame) -> DataFrame:
    """The table, cached in as many partitions as its size asks for.

    Else it keeps the session's number of shuffle partitions, and every stage that
    reads it has as many tasks, whose metrics all go to the driver.
    """
    conf = table.sparkSession.conf
    before = conf.get(BY_SIZE)
    conf.set(BY_SIZE, "true")  # read when the table is marked
    try:
        return table.cache()
    finally:
        conf.set(BY_SIZE, before)


def setup(spark: SparkSession, folder: str, schedule: Schedule = DEFAULT) -> Setup:
    """Read the star schema once into daily leaf counts, which every later table is made from.

    The counts have one row an area and day; they and the panel are cached (they may
    spill to disk) until another folder or session is set up.
    """
    if _held and _held[0][:2] != (spark, folder):
        release()
    if not _held:
        counts = cached(star.leaf_counts(spark, folder))
        _held.append((spark, folder, counts, cached(hierarchy.panel(counts)), hierarchy.bounds(counts).first()["n_days"] or 0))
    _, _, counts, panel, n = _held[0]
    for table in (counts, panel):
        if not table.storageLevel.useMemory:  # somebody cleared the cache
            cached(table)
    kept = counts.join(hierarchy.leaf_quality(counts).filter("kept").select("area"), "area").select("borough", "area").distinct()
    return Setup(counts, panel, plan.origins(spark, n, schedule), hierarchy.summing(kept), hierarchy.nodes(kept), schedule, n)


def release() -> None:
    """Give up the cached tables."""
    while _held:
        session, _, counts, panel, _ = _held.pop()
        if session.sparkContext._jsc is not None:  # else the session has ended
            panel.unpersist()
            counts.unpersist()


def copied(s: Setup) -> DataFrame:
    """``origin, node, level, step, point, y`` of the rule that repeats the last known week."""
    return naive.points(s.panel, s.origins, s.schedule).join(s.actuals().drop("level"), ["origin", "node", "step"])


def weekday_mean(s: Setup) -> DataFrame:
    """Our second baseline: the mean of the last four known days of the target's weekday, with the same columns."""
    week = F.ceil(F.col("step") / F.lit(7.0)).cast("int")
    wanted = plan.targets(s.origins, s.schedule).select("origin", "step", F.explode(F.transform(F.sequence(week, week + 3), lambda k: F.col("target_idx") - 7 * k)).alias("day_idx"))
    point = s.panel.join(wanted, "day_idx").groupBy("origin", "node", "level", "step").agg(F.avg("value").alias("point"))
    return point.join(s.actuals().drop("level"), ["origin", "node", "step"])


def naive_scores(s: Setup, levels=REPORTING, reporting=REPORTING) -> DataFrame:
    forecasts = naive.seasonal_naive(s.panel, s.origins, s.schedule, levels)
    return scores.score_forecasts(forecasts, s.actuals(), levels, reporting, NOMINAL)


def sampled_origins(n: int) -> list[int]:
    """Three origins that stand for a schedule of ``n``: a tenth in, the middle, and the last but one."""
    if n < 2:
        raise ValueError("a schedule of two origins at least is needed")
    return sorted({n // 10, n // 2, n - 2})


def timings(s: Setup, models: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``model, origin, origins, rows, seconds``: what each model costs at the sampled origins, before a whole run.

    A model maps origins to forecasts. Each sampled origin is a job of its own, whose
    rows are counted as they pass and not kept; the panel is computed beforehand. The
    cost of the whole schedule follows by ``report.compute_cost``.
    """
    spark = s.panel.sparkSession
    s.panel.count()
    took = []
    for model, forecast in models.items():
        for origin in sampled_origins(s.schedule.count(s.n_days)):
            seen = Observation()
            found = forecast(s.origins.filter(F.col("origin") == origin)).observe(seen, F.count("*").alias("rows"))
            began = time.perf_counter()
            found.write.format("noop").mode("overwrite").save()
            took.append((model, origin, 1, seen.get["rows"], time.perf_counter() - began))
    return spark.createDataFrame(took, "model string, origin int, origins int, rows long, seconds double")
