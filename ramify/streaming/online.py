"""Structured Streaming forms: daily counts, and adaptive conformal intervals fed by outcomes as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Conformal, Schedule
from ..operators.conformal import DEFAULT, AdaptiveLevel, horizon_lag


def daily_counts(events: DataFrame, *keys: str, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts by day and keys of a stream; events later than ``late`` behind the newest are dropped by the watermark."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    counted = stamped.groupBy(F.window("__time", "1 day"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), *keys, "n")


def adaptive_widths(outcomes: DataFrame, schedule: Schedule, settings: Conformal = DEFAULT, gamma: float | None = None) -> DataFrame:
    """``node, step, origin, half, alpha`` from a stream of outcomes (``node, step, origin, point, y``).

    An outcome of origin j completes what the forecast of origin j + lag may know,
    so it emits that forecast's half-width: the same numbers as the batch form. The
    state holds the last window of scores and outcomes that came before their turn.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node, step = key
        level, turn, held = AdaptiveLevel.start(settings, gamma), 0, {}
        if state.exists:
            level.alpha, turn, window, early, early_scores = state.get
            level.window.extend(window)
            held = dict(zip(early, early_scores, strict=True))
        for rows in batches:
            for r in rows.itertuples(index=False):
                if r.origin >= turn:
                    held[int(r.origin)] = abs(float(r.y) - float(r.point))
        lag, out = horizon_lag(int(step), schedule.step), []
        while turn in held:
            half = level.learn(held.pop(turn))
            out.append((node, int(step), turn + lag, half, level.alpha))
            turn += 1
        state.update((level.alpha, turn, list(level.window), list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["node", "step", "origin", "half", "alpha"])

    kept = "alpha double, turn int, scores array<double>, early array<int>, early_scores array<double>"
    grouped = outcomes.select("node", "step", "origin", "point", "y").groupBy("node", "step")
    return grouped.applyInPandasWithState(run, "node string, step int, origin int, half double, alpha double", kept, "append", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and return the rows; for small results, as in checks."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
