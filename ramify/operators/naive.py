"""Seasonal naive forecasts with empirical residual quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEASON, Schedule, check_levels
from .schedule import targets


def seasonal_lag(step: Column) -> Column:
    return (F.ceil(step / F.lit(float(SEASON))) * SEASON).cast("int")


def source_idx(week2: str = "as_built") -> Column:
    """Day index a step copies. As built, the second week repeats the week before the last known one; "documented" repeats two weeks back."""
    lag = seasonal_lag(F.col("step"))
    ahead = F.pmod(F.col("step") - 1, F.lit(SEASON)) if week2 == "as_built" else F.col("step") - 1
    return F.col("origin_idx") + 1 - lag + ahead


def points(panel: DataFrame, origins: DataFrame, schedule: Schedule, week2: str = "as_built") -> DataFrame:
    """``origin, node, level, step, point``: an equality join on the copied day."""
    wanted = targets(origins, schedule).withColumn("source_idx", source_idx(week2).cast("int"))
    return panel.join(wanted, panel.day_idx == wanted.source_idx).select("origin", "node", "level", "step", F.col("value").alias("point"))


def seasonal_naive(panel: DataFrame, origins: DataFrame, schedule: Schedule, levels, model: str = "naive", week2: str = "as_built") -> DataFrame:
    """``model, origin, node, step, q``: point plus quantiles of seasonal differences in the training window, floored at 0.

    One task per node: a node's series has one value a day, and every origin's
    window of differences is cut from it, so days aren't multiplied by origins.
    """
    check_levels(levels)
    weeks = -(-schedule.horizon // SEASON)
    if (schedule.train_window or schedule.min_train) < 2 * weeks * SEASON:
        raise ValueError("the training window is too short for the horizon's longest lag")
    plan = [(r["origin"], r["origin_idx"], r["train_from"]) for r in origins.orderBy("origin").collect()]
    grid, horizon = np.array(levels), schedule.horizon

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("day_idx")["value"].to_numpy(float)
        out = []
        for origin, last, first in plan:
            train = x[first : last + 1]
            for step in range(1, horizon + 1):
                lag = SEASON * -(-step // SEASON)
                if step % SEASON == 1:
                    spread = np.quantile(train[lag:] - train[:-lag], grid)
                ahead = (step - 1) % SEASON if week2 == "as_built" else step - 1
                out.append((model, origin, rows["node"].iloc[0], step, np.maximum(train[len(train) - lag + ahead] + spread, 0.0)))
        return pd.DataFrame(out, columns=["model", "origin", "node", "step", "q"])

    return panel.select("node", "day_idx", "value").groupBy("node").applyInPandas(run, "model string, origin int, node string, step int, q array<double>")


class RankedCounts:
    """Counts by rank of the values in a window that moves over ``values``; order statistics take the log of their number."""

    def __init__(self, values: np.ndarray):
        self.sorted, rank = np.unique(values, return_inverse=True)
        self.rank, self.size, self.n = rank + 1, len(self.sorted), 0
        self.tree = np.zeros(self.size + 1, np.int64)

    def move(self, places: np.ndarray, by: int) -> None:
        """Count the values at these places once more (1) or once less (-1)."""
        at = self.rank[places]
        self.n += by * len(at)
        while len(at):
            np.add.at(self.tree, at, by)
            at = at + (at & -at)
            at = at[at <= self.size]

    def smallest(self, k: np.ndarray) -> np.ndarray:
        """The values of 0-based places ``k`` in the order of the window."""
        at, left = np.zeros(len(k), np.int64), k + 1
        for bit in range(self.size.bit_length() - 1, -1, -1):
            ahead = at + (1 << bit)
            below = self.tree[np.minimum(ahead, self.size)]
            go = (ahead <= self.size) & (below < left)
            at, left = np.where(go, ahead, at), np.where(go, left - below, left)
        return self.sorted[at]

    def quantiles(self, levels: np.ndarray) -> np.ndarray:
        """Quantiles between neighbouring order statistics, in proportion."""
        at = levels * (self.n - 1)
        low = np.floor(at).astype(np.int64)
        a, b = self.smallest(low), self.smallest(np.minimum(low + 1, self.n - 1))
        return a + (b - a) * (at - low)


def residual_quantiles(panel: DataFrame, origins: DataFrame, schedule: Schedule, levels) -> DataFrame:
    """``origin, node, lag, residuals``: the quantiles of seasonal differences alone.

    One task per node. A node's differences enter and leave ranked counts as the
    window moves, so the work grows with its days, not with days times origins.
    Days that a node lacks give no difference; a window without any has no row.
    """
    check_levels(levels)
    plan = [(r["origin"], r["origin_idx"], r["train_from"]) for r in origins.orderBy("origin").collect()]
    grid, lags = np.array(levels), [SEASON * (k + 1) for k in range(-(-schedule.horizon // SEASON))]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        days = rows["day_idx"].to_numpy()
        x = np.full(days.max() + 1, np.nan)
        x[days] = rows["value"].to_numpy(float)
        out = []
        for lag in lags:
            d = x[lag:] - x[:-lag]
            known = np.flatnonzero(np.isfinite(d))
            counts = RankedCounts(d[known])
            low = high = 0
            for origin, last, first in plan:
                # a difference counts if both of its days lie in [first, last]
                new_low, new_high = np.searchsorted(known, [first, max(last - lag + 1, first)])
                counts.move(np.arange(max(high, new_low), new_high), 1)
                counts.move(np.arange(low, min(new_low, high)), -1)
                low, high = new_low, new_high
                if counts.n:
                    out.append((origin, rows["node"].iloc[0], lag, counts.quantiles(grid)))
        return pd.DataFrame(out, columns=["origin", "node", "lag", "residuals"])

    return panel.select("node", "day_idx", "value").groupBy("node").applyInPandas(run, "origin int, node string, lag int, residuals array<double>")
