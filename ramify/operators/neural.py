"""A global multi-rate network with a multi-quantile loss: fitted at refit origins, served until the next one.

Each stack pools its input at its own rate, runs two hidden layers, and gives a few
coefficients that are interpolated over the days: a part of the input that it
explains, which the next stack no longer sees, and a part of the forecast. Over
quantiles the forecast is interpolated between knots as well. Gradients are written
out; steps are Adam's.

On Spark a fit is dealt by series. Every round, each task takes steps from the
common weights on windows of its own series, and the mean of the tasks' weights is
the next round's start; with few series one task takes all steps. A round is an
ordinary job whose result is written, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import io
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SEASON, Schedule, check_levels
from .statistical import training_windows


@dataclass(frozen=True)
class Network:
    """Shape and training of the network; input days, steps, rate and seed are fixed values."""

    days: int = 112
    steps: int = 1000
    rate: float = 1e-3
    seed: int = 0
    batch: int = 256
    hidden: int = 128
    #: Days pooled to one and days between two forecast coefficients, stack by stack.
    pools: tuple[int, ...] = (8, 4, 1)
    strides: tuple[int, ...] = (7, 2, 1)
    #: Quantile knots; forecasts of other levels lie on the lines between them.
    knots: int = 25
    #: Series of one task, and rounds of a fit that several tasks share.
    series: int = 512
    rounds: int = 10


DEFAULTS = Network()


def interpolation(knots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Matrix (knots, wanted) that reads values at ``wanted`` off the lines between knots; flat beyond them."""
    out = np.zeros((len(knots), len(wanted)))
    for j, x in enumerate(np.clip(wanted, knots[0], knots[-1])):
        k = min(int(np.searchsorted(knots, x, side="right")) - 1, len(knots) - 2) if len(knots) > 1 else 0
        if len(knots) == 1:
            out[0, j] = 1.0
            continue
        part = (x - knots[k]) / (knots[k + 1] - knots[k])
        out[k, j], out[k + 1, j] = 1 - part, part
    return out


def scaled(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and spread (median distance from it, never under a thousandth of its size) of each window."""
    middle = np.median(windows, axis=1, keepdims=True)
    spread = np.median(np.abs(windows - middle), axis=1, keepdims=True)
    return middle, np.maximum(spread, 1e-3 * np.maximum(np.abs(middle), 1.0))


class Stacks:
    """The network as a function of its weights: forecasts, loss and gradients."""

    def __init__(self, p: Network, horizon: int, levels):
        self.p, self.horizon, self.levels = p, horizon, np.asarray(levels, float)
        knots = self.levels[np.unique(np.linspace(0, len(self.levels) - 1, min(p.knots, len(self.levels))).round().astype(int))]
        self.over_levels = interpolation(knots, self.levels)
        self.quantiles = len(knots)
        days, ahead = np.arange(p.days, dtype=float), np.arange(horizon, dtype=float)
        self.back, self.fore = [], []
        for pool, stride in zip(p.pools, p.strides, strict=True):
            self.back.append(interpolation(np.unique(np.append(days[::pool], days[-1])), days))
            self.fore.append(interpolation(np.unique(np.append(ahead[::stride], ahead[-1])), ahead))

    def start(self) -> list[np.ndarray]:
        """First weights, the same for every fit."""
        draw, out = np.random.default_rng(self.p.seed), []
        for pool, back, fore in zip(self.p.pools, self.back, self.fore, strict=True):
            sizes = [self.p.days // pool, self.p.hidden, self.p.hidden, len(back) + len(fore) * self.quantiles]
            for a, b in zip(sizes, sizes[1:], strict=False):
                out += [draw.uniform(-1, 1, (a, b)) * np.sqrt(3 / a) * (1.0 if b == self.p.hidden else 0.1), np.zeros(b)]
        return out

    def forward(self, weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Forecasts (rows, horizon, quantile knots) of scaled inputs, and what the gradients need."""
        base = x[:, -SEASON:][:, np.arange(self.horizon) % SEASON]
        out, kept = np.repeat(base[:, :, None], self.quantiles, axis=2), []
        for s, (pool, back, fore) in enumerate(zip(self.p.pools, self.back, self.fore, strict=True)):
            w1, b1, w2, b2, w3, b3 = weights[6 * s : 6 * s + 6]
            cells = x[:, x.shape[1] % pool :].reshape(len(x), -1, pool)
            top = cells.argmax(axis=2)
            pooled = np.take_along_axis(cells, top[:, :, None], axis=2)[:, :, 0]
            first = np.maximum(pooled @ w1 + b1, 0)
            second = np.maximum(first @ w2 + b2, 0)
            theta = second @ w3 + b3
            kept.append((top, pooled, first, second, x.shape[1] % pool))
            x = x - theta[:, : len(back)] @ back
            ahead = theta[:, len(back) :].reshape(len(x), self.quantiles, len(fore)) @ fore
            out = out + ahead.transpose(0, 2, 1)
        return out, kept

    def gradients(self, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean quantile loss over rows, days and levels, and its gradient by every weight."""
        out, kept = self.forward(weights, x)
        error = y[:, :, None] - out @ self.over_levels
        loss = float(np.maximum(self.levels * error, (self.levels - 1) * error).mean())
        slope = np.where(error > 0, -self.levels, 1 - self.levels) / error.size
        by_out = (slope @ self.over_levels.T).transpose(0, 2, 1)  # rows, knots, horizon
        found: list[np.ndarray] = [None] * len(weights)
        by_x = np.zeros_like(x)
        for s in reversed(range(len(self.p.pools))):
            pool, back, fore = self.p.pools[s], self.back[s], self.fore[s]
            w1, _, w2, _, w3, _ = weights[6 * s : 6 * s + 6]
            top, pooled, first, second, cut = kept[s]
            by_theta = np.concatenate([-by_x @ back.T, (by_out @ fore.T).reshape(len(x), -1)], axis=1)
            by_second = (by_theta @ w3.T) * (second > 0)
            by_first = (by_second @ w2.T) * (first > 0)
            found[6 * s : 6 * s + 6] = [
                pooled.T @ by_first, by_first.sum(axis=0), first.T @ by_second, by_second.sum(axis=0), second.T @ by_theta, by_theta.sum(axis=0)
            ]
            cells = np.zeros((len(x), top.shape[1], pool))
            np.put_along_axis(cells, top[:, :, None], (by_first @ w1.T)[:, :, None], axis=2)
            by_x = by_x.copy()
            by_x[:, cut:] += cells.reshape(len(x), -1)
        return loss, found

    def train(self, weights: list[np.ndarray], series: np.ndarray, steps: int, seed: int) -> list[np.ndarray]:
        """Adam's steps on windows drawn from the rows of ``series`` (series, days)."""
        p, draw = self.p, np.random.default_rng(seed)
        whole = p.days + self.horizon
        begins = series.shape[1] - whole + 1
        weights = [w.copy() for w in weights]
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        reach = np.arange(whole)
        for step in range(1, steps + 1):
            rows, at = draw.integers(0, len(series), p.batch), draw.integers(0, begins, p.batch)
            windows = series[rows[:, None], at[:, None] + reach]
            middle, spread = scaled(windows[:, : p.days])
            windows = (windows - middle) / spread
            _, slopes = self.gradients(weights, windows[:, : p.days], windows[:, p.days :])
            for w, m, v, g in zip(weights, mean, square, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return weights

    def predict(self, weights: list[np.ndarray], last: np.ndarray) -> np.ndarray:
        """Quantiles (rows, horizon, levels) from the last days of each series: in order and not under 0."""
        middle, spread = scaled(last)
        out = self.forward(weights, (last - middle) / spread)[0] @ self.over_levels
        return np.sort(np.maximum(out * spread[:, :, None] + middle[:, :, None], 0.0), axis=2)


def dump(weights: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *weights)
    return out.getvalue()


def load(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return [held[f"arr_{i}"] for i in range(len(held.files))]


_MODELS = "refit_origin int, model binary, seconds double"


def fitted(panel: DataFrame, origins: DataFrame, schedule: Schedule, levels, p: Network = DEFAULTS) -> DataFrame:
    """``refit_origin, model binary, seconds``: a network for every refit origin, from all series' training windows."""
    check_levels(levels)
    if (schedule.train_window or schedule.min_train) < p.days + schedule.horizon:
        raise ValueError(f"the training window must have {p.days + schedule.horizon} days or more")
    net, spark = Stacks(p, schedule.horizon, levels), panel.sparkSession
    shards = -(-panel.select("node").distinct().count() // p.series)
    rounds = 1 if shards == 1 else p.rounds
    refits = origins.filter("refit")
    keys = panel.select("node").distinct().withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    windows = training_windows(panel, refits).join(keys, "node").withColumnRenamed("origin", "refit_origin").repartition(8 * max(refits.count() * shards, 1), "refit_origin", "shard")
    models = refits.select(F.col("origin").alias("refit_origin"), F.lit(dump(net.start())).alias("model"), F.lit(0.0).alias("seconds"))

    def steps(number: int):
        def run(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"refit_origin": [], "model": [], "seconds": [], "shard": [], "n": []})
            began, rows = time.time(), rows.sort_values("node")
            seed = [p.seed, int(rows["shard"].iloc[0]), number]
            weights = net.train(load(kept["model"].iloc[0]), np.stack(rows["train"].to_numpy()), p.steps // rounds, seed)
            return pd.DataFrame({"refit_origin": [rows["refit_origin"].iloc[0]], "model": [dump(weights)], "seconds": [time.time() - began], "shard": [rows["shard"].iloc[0]], "n": [len(rows)]})

        return run

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        share = rows["n"].to_numpy() / rows["n"].sum()
        weights = [sum(a * w for a, w in zip(share, layer, strict=True)) for layer in zip(*map(load, rows["model"]), strict=True)]
        return pd.DataFrame({"refit_origin": [rows["refit_origin"].iloc[0]], "model": [dump(weights)], "seconds": [rows["seconds"].sum()]})

    for number in range(rounds):
        each = models.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        trained = windows.groupBy("refit_origin", "shard").cogroup(each.groupBy("refit_origin", "shard")).applyInPandas(steps(number), f"{_MODELS}, shard int, n int")
        if shards == 1:
            models = trained.drop("shard", "n")
        else:
            before = models.select("refit_origin", F.col("seconds").alias("spent"))
            models = trained.groupBy("refit_origin").applyInPandas(mean, _MODELS)
            models = models.join(before, "refit_origin").select("refit_origin", "model", (F.col("seconds") + F.col("spent")).alias("seconds"))
            if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
                if spark.sparkContext.getCheckpointDir() is None:
                    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
                models = models.checkpoint()
    return models


def served(panel: DataFrame, origins: DataFrame, models: DataFrame, schedule: Schedule, levels, name: str, p: Network = DEFAULTS) -> DataFrame:
    """``model, origin, node, step, q``: every origin is forecast by its refit's network from its own last days."""
    net = Stacks(p, schedule.horizon, levels)
    last = training_windows(panel, origins).join(F.broadcast(origins.select("origin", "refit_origin")), "origin")
    last = last.select("refit_origin", "origin", "node", F.slice("train", -p.days, p.days).alias("train"))

    def run(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(kept):
            return pd.DataFrame({"model": [], "origin": [], "node": [], "step": [], "q": []})
        found = net.predict(load(kept["model"].iloc[0]), np.stack(rows["train"].to_numpy()))
        n, h = found.shape[:2]
        return pd.DataFrame(
            {"model": name, "origin": np.repeat(rows["origin"].to_numpy(), h), "node": np.repeat(rows["node"].to_numpy(), h), "step": np.tile(np.arange(1, h + 1), n), "q": list(found.reshape(n * h, -1))}
        )

    return last.groupBy("refit_origin").cogroup(models.groupBy("refit_origin")).applyInPandas(run, "model string, origin int, node string, step int, q array<double>")


def forecast(panel: DataFrame, origins: DataFrame, schedule: Schedule, levels, p: Network = DEFAULTS) -> DataFrame:
    """Forecasts of ``served`` from networks of ``fitted``, which are fitted as they are needed."""
    return served(panel, origins, fitted(panel, origins, schedule, levels, p), schedule, levels, f"network-refit{schedule.refit_every}", p)
