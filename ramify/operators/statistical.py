"""Statistical forecasters in numpy, one series window at a time, spread over Spark by (node, origin).

They follow the published methods with searches of their own, so they are
relatives of the well-known libraries' models and not digit for digit the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SEASON, Schedule, check_levels
from . import arima as sarima
from . import smoothing
from .loess import decompose


class Forecaster(Protocol):
    """Anything that turns one series' training window into quantiles (horizon, levels)."""

    def __call__(self, train: np.ndarray, horizon: int, levels: np.ndarray) -> np.ndarray: ...


def normal_quantiles(mean: np.ndarray, deviation: np.ndarray, levels: np.ndarray) -> np.ndarray:
    z = np.array([NormalDist().inv_cdf(float(q)) for q in levels])
    return np.maximum(mean[:, None] + deviation[:, None] * z[None, :], 0.0)


def ets_many(trains: np.ndarray, horizon: int, levels: np.ndarray, season: int = SEASON, forms: tuple = smoothing.FORMS) -> np.ndarray:
    """Exponential smoothing of several windows of one length; each takes the form of least AICc."""
    found = smoothing.fit_ets(trains, season, forms)
    return np.stack([smoothing.ets_quantiles(f, trains.shape[1], horizon, levels, season) for f in found])


def ets(train: np.ndarray, horizon: int, levels: np.ndarray, season: int = SEASON, forms: tuple = smoothing.FORMS) -> np.ndarray:
    """``ets_many`` of one window."""
    return ets_many(train[None, :], horizon, levels, season, forms)[0]


def theta_many(trains: np.ndarray, horizon: int, levels: np.ndarray, season: int = SEASON) -> np.ndarray:
    """Theta method of several windows of one length: the best of its four forms, on series divided by weekly indices where a season shows."""
    n = trains.shape[1]
    index = np.stack([smoothing.seasonal_indices(x, season) for x in trains])
    found = smoothing.fit_theta(trains / index[:, np.arange(n) % season])
    out = []
    for f, factors in zip(found, index[:, (n + np.arange(horizon)) % season], strict=True):
        mean, deviation = smoothing.theta_ahead(f, n, horizon)
        out.append(normal_quantiles(mean * factors, deviation * factors, levels))
    return np.stack(out)


def theta(train: np.ndarray, horizon: int, levels: np.ndarray, season: int = SEASON) -> np.ndarray:
    """``theta_many`` of one window."""
    return theta_many(train[None, :], horizon, levels, season)[0]


#: Forms for what a decomposition leaves, which may be negative.
_ADDED = tuple(f for f in smoothing.FORMS if f.error == "A" and f.season == "N")


def mstl_many(trains: np.ndarray, horizon: int, levels: np.ndarray, seasons: tuple[int, ...] = (SEASON, 365)) -> np.ndarray:
    """``mstl`` of several windows of one length."""
    n, where = trains.shape[1], np.arange(horizon)
    rests, ahead = [], []
    for x in trains.astype(float):
        parts, _ = decompose(x, seasons)
        rests.append(x - sum(parts.values(), np.zeros(n)))
        ahead.append(sum((s[n - p + where % p] for p, s in parts.items()), np.zeros(horizon)))
    high = 1e6  # keeps quantiles of the rest from being cut at 0
    return np.maximum(ets_many(np.stack(rests) + high, horizon, levels, 1, _ADDED) - high + np.stack(ahead)[:, :, None], 0.0)


def mstl(train: np.ndarray, horizon: int, levels: np.ndarray, seasons: tuple[int, ...] = (SEASON, 365)) -> np.ndarray:
    """Seasons of several periods by local regression, repeated as they were last, and smoothing of the rest; the interval has no seasonal variance."""
    return mstl_many(train[None, :], horizon, levels, seasons)[0]


def arima(train: np.ndarray, horizon: int, levels: np.ndarray, season: int = SEASON) -> np.ndarray:
    """Seasonal ARIMA whose differences and orders are chosen by tests and AICc, fitted by the exact likelihood."""
    return normal_quantiles(*sarima.ahead(train, horizon, season), levels)


MODELS: dict[str, Callable] = {"ets": ets, "theta": theta, "mstl": mstl, "arima": arima}
#: Forms of the models that fit several windows of one length faster than one by one, and windows fitted together.
TOGETHER: dict[Callable, Callable] = {ets: ets_many, theta: theta_many, mstl: mstl_many}
WINDOWS = 16


def _quantiles(model: Callable, trains: list[np.ndarray], horizon: int, grid: np.ndarray) -> list[np.ndarray]:
    """Ordered quantiles of each window."""
    many, out = TOGETHER.get(model), [None] * len(trains)
    for n in {len(x) for x in trains} if many else ():
        rows = [i for i, x in enumerate(trains) if len(x) == n]
        for k in range(0, len(rows), WINDOWS):
            own = rows[k : k + WINDOWS]
            for i, q in zip(own, many(np.stack([trains[i] for i in own]), horizon, grid), strict=True):
                out[i] = np.sort(q, axis=1)
    return out if many else [np.sort(model(x, horizon, grid), axis=1) for x in trains]


def training_windows(panel: DataFrame, origins: DataFrame) -> DataFrame:
    """``origin, node, train array<double>``: each window cut once; a series has one value a day, so a node's array is short."""
    series = panel.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("day_idx", "value"))), lambda p: p["value"]).alias("x"))
    plan = origins.agg(F.collect_list(F.struct("origin", "origin_idx", "train_from")).alias("plan"))  # the schedule: bounded by days
    each = series.join(F.broadcast(plan)).select("node", "x", F.explode("plan").alias("o"))
    return each.select("o.origin", "node", F.slice("x", F.col("o.train_from") + 1, F.col("o.origin_idx") - F.col("o.train_from") + 1).alias("train"))


def forecast(panel: DataFrame, origins: DataFrame, schedule: Schedule, levels, models: dict[str, Forecaster] | None = None) -> DataFrame:
    """``model, origin, node, step, q`` of several models from one pass over the windows.

    A model sees its window and nothing else. Quantiles are put in order.
    """
    check_levels(levels)
    models, grid, horizon = models or MODELS, np.array(levels), schedule.horizon

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trains, out = [np.asarray(x, float) for x in batch["train"]], []
            for name, model in models.items():
                for origin, node, q in zip(batch["origin"], batch["node"], _quantiles(model, trains, horizon, grid), strict=True):
                    out += [(name, origin, node, k + 1, q[k]) for k in range(horizon)]
            yield pd.DataFrame(out, columns=["model", "origin", "node", "step", "q"])

    # fits cost time, not bytes: a number of parts of its own keeps Spark from joining them by size
    tasks = 4 * panel.sparkSession.sparkContext.defaultParallelism
    dealt = training_windows(panel, origins).repartition(tasks, "origin", "node")
    return dealt.mapInPandas(run, "model string, origin int, node string, step int, q array<double>")


def external(rows: DataFrame, levels) -> DataFrame:
    """Forecasts made elsewhere (neural or zero-shot models): checked for a full, ordered, non-negative grid.

    Rows need ``model, origin, node, step, q``; a row that breaks the rule raises when it is read.
    """
    check_levels(levels)
    q = F.col("q")
    fine = (F.size(q) == len(levels)) & F.forall(q, lambda x: x >= 0) & (F.array_sort(q) == q)
    return rows.withColumn("q", F.when(fine, q).otherwise(F.raise_error(F.lit("external forecast with a partial or disordered grid")).cast("array<double>")))
