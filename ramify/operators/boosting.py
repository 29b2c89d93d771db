"""Global boosted trees with absolute loss: histograms over binned features, leaf-wise growth, leaves at medians.

One model serves all series. A fit needs the training windows of every series at a
refit origin; features are cut from them where the fit runs. Fits of different
refits are independent. A fit that one task can hold is one task; a larger one is
dealt over a barrier stage by series, whose tasks add up their histograms before
every choice. Both ways take the same choices: gradients of absolute loss are -1, 0
or 1, so that sums are whole numbers, and cuts and medians are order statistics of
all rows.
"""

from __future__ import annotations

import base64
import heapq
import io
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LEVELS, SEASON, Schedule
from ..functions.calendar import features as calendar_features
from .design import LOOKBACK, MEANS, RECENT, SAME_WEEKDAYS
from .statistical import training_windows

Total = Callable[[np.ndarray], np.ndarray]
#: Rows that one task fits; with more, a fit is dealt over the cluster.
ONE_TASK = 3_000_000


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit; the defaults are fixed values but for the number of bins."""

    rounds: int = 400
    rate: float = 0.05
    leaves: int = 63
    least: int = 100
    share: float = 0.9
    seed: int = 0
    bins: int = 64
    #: Categories are put in order by gradients shrunk by this count, and their splits pay this much of a penalty.
    smooth: float = 10.0
    penalty: float = 10.0


DEFAULTS = Boosting()
DEMAND = (*(f"same_weekday_{k}" for k in range(1, SAME_WEEKDAYS + 1)), *(f"recent_{k}" for k in RECENT), *(f"mean_{k}" for k in MEANS))
NUMBERS = (*DEMAND, "step", "day_of_year", "is_holiday", "is_holiday_observed")
CATEGORIES = ("series", "level_code", "dow")


# order statistics and histograms, over one task's rows or all tasks'


def _keys(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned whole numbers in the same order."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _values(keys: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(keys & top, keys ^ top, ~keys).view(np.float64)


def order_statistics(groups: list[np.ndarray], shares: np.ndarray, total: Total | None = None, bits: int = 8) -> list[np.ndarray]:
    """For each group of values, those of rank ``ceil(share * n)`` (1 at least) among all tasks' rows; groups without rows have none.

    Alone, by partial sorting; with other tasks, some bits of the ordered key at a
    time: an exchange of ``2**bits`` counts a rank for each, however many rows there are.
    """
    if total is None:
        out = []
        for v in groups:
            ranks = np.clip(np.ceil(shares * len(v) - 1e-9).astype(int), 1, max(len(v), 1)) - 1
            out.append(np.partition(v, np.unique(ranks))[ranks] if len(v) else np.zeros(0))
        return out
    keys = [np.sort(_keys(v)) for v in groups]
    n = total(np.array([len(k) for k in keys]))
    ranks = np.clip(np.ceil(shares[None, :] * n[:, None] - 1e-9).astype(int), 1, None)
    found = np.zeros(ranks.shape, np.uint64)
    begin = 64
    while begin:
        shift = max(begin - bits, 0)
        digits = np.arange(1 << (begin - shift), dtype=np.uint64) << np.uint64(shift)
        tries = found[..., None] | digits | np.uint64((1 << shift) - 1)
        below = total(np.stack([np.searchsorted(k, t.ravel(), side="right").reshape(t.shape) for k, t in zip(keys, tries, strict=True)]))
        found |= digits[(below < ranks[..., None]).sum(axis=-1).clip(max=len(digits) - 1)]
        begin = shift
    return [_values(f) if size else np.zeros(0) for f, size in zip(found, n, strict=True)]


class Table:
    """Binned features, ``numeric`` ones first, and what their histograms need: narrow ones are counted two at a time."""

    def __init__(self, columns: list[np.ndarray], widths: list[int], numeric: int):
        self.columns = [np.asarray(c, np.int32) for c in columns]
        self.widths, self.rows, self.numeric = widths, len(columns[0]), numeric
        narrow = [f for f, w in enumerate(widths) if w <= 64]
        self.groups = [narrow[i : i + 2] for i in range(0, len(narrow), 2)] + [[f] for f, w in enumerate(widths) if w > 64]
        self.codes = []
        for group in self.groups:
            code = self.columns[group[0]]
            if len(group) == 2:
                code = code * widths[group[1]] + self.columns[group[1]]
            self.codes.append((code * 3).astype(np.uint16 if code.max(initial=0) * 3 < 1 << 16 else np.int32))
        self.begins = np.concatenate([[0], np.cumsum(widths)])
        place = np.arange(max(widths[:numeric], default=0))
        self.padding = place >= np.array(widths[:numeric])[:, None]
        self.padded = np.where(self.padding, 0, self.begins[:numeric, None] + place)

    def histogram(self, rows: np.ndarray | None, state: np.ndarray) -> np.ndarray:
        """For every bin of every feature, rows whose gradient is -1, 0 and 1 (``state`` 0, 1, 2)."""
        out = np.zeros((self.begins[-1], 3), np.int64)
        own = state if rows is None else state[rows]
        for group, code in zip(self.groups, self.codes, strict=True):
            shape = [self.widths[f] for f in group]
            counts = np.bincount((code if rows is None else code[rows]) + own, minlength=3 * int(np.prod(shape))).reshape(*shape, 3)
            for place, f in enumerate(group):
                out[self.begins[f] : self.begins[f + 1]] = counts if len(group) == 1 else counts.sum(axis=1 - place)
        return out


def best_split(table: Table, histogram: np.ndarray, chosen: np.ndarray, p: Boosting) -> tuple[float, int, np.ndarray] | None:
    """Gain, feature and the bins that go left of the best split of a leaf; the first of equals, none without a gain.

    Numeric features split by order; the others are categories, put in order by
    their mean gradient.
    """
    first = histogram[: table.widths[0]].sum(axis=0)
    n_all, g_all = int(first.sum()), int(first[2] - first[0])

    def gains(left: np.ndarray, grad: np.ndarray, penalty: float) -> np.ndarray:
        right = n_all - left
        worth = grad**2 / (left + penalty + 1e-300) + (g_all - grad) ** 2 / (right + penalty + 1e-300) - g_all**2 / n_all
        return np.where((left >= p.least) & (right >= p.least), worth, -np.inf)

    best: tuple[float, int, np.ndarray] | None = None
    ordered = chosen[chosen < table.numeric]
    if len(ordered):
        counts = np.where(table.padding[ordered][..., None], 0, histogram[table.padded[ordered]])
        counts = np.cumsum(counts, axis=1)[:, :-1]
        gain = gains(counts.sum(axis=2), counts[..., 2] - counts[..., 0], 0.0)
        f, at = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, at] > 1e-9:
            best = float(gain[f, at]), int(ordered[f]), np.arange(table.widths[ordered[f]]) <= at
    for f in chosen[chosen >= table.numeric]:
        counts = histogram[table.begins[f] : table.begins[f + 1]]
        n, g = counts.sum(axis=1), counts[:, 2] - counts[:, 0]
        met = np.flatnonzero(n)
        order = met[np.argsort(g[met] / (n[met] + p.smooth), kind="stable")]
        gain = gains(np.cumsum(n[order])[:-1], np.cumsum(g[order])[:-1], p.penalty)
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
            goes = np.zeros(len(n), bool)
            goes[order[: at + 1]] = True
            best = float(gain[at]), int(f), goes
    return best


def grow(table: Table, state: np.ndarray, chosen: np.ndarray, p: Boosting, total: Total | None = None) -> tuple[list, list[np.ndarray]]:
    """Splits ``(leaf, feature, left bins)`` in the order taken, and each leaf's rows here: always the leaf of most gain.

    A split's left rows keep the leaf's number, its right rows get the next one.
    Only the smaller side is counted; the other is the difference. Alone, sides are
    counted when a leaf is split; with other tasks, those of all leaves that could
    still be split are counted in one exchange, as exchanges are slow.
    """
    add = total or (lambda x: x)
    leaves: list[np.ndarray] = [np.arange(table.rows)]
    counts = [add(table.histogram(None, state))]
    splits: list[tuple[int, int, np.ndarray]] = []
    queue: list[tuple] = []
    ready: dict[int, tuple[bool, np.ndarray]] = {}

    def offer(leaf: int) -> None:
        found = best_split(table, counts[leaf], chosen, p)
        if found:
            heapq.heappush(queue, (-found[0], leaf, found[1], found[2]))

    def sides(leaf: int, feature: int, goes: np.ndarray) -> tuple[bool, np.ndarray]:
        """Whether the left side is the smaller one, and its histogram here."""
        part = counts[leaf][table.begins[feature] : table.begins[feature + 1]].sum(axis=1)
        small = bool(part[goes].sum() * 2 <= part.sum())
        return small, table.histogram(leaves[leaf][goes[table.columns[feature][leaves[leaf]]] == small], state)

    offer(0)
    while queue and len(leaves) < p.leaves:
        if queue[0][1] not in ready:
            # no leaf behind so many better ones can be reached any more
            next_ones = heapq.nsmallest(p.leaves - len(leaves) if total else 1, queue, key=lambda q: q[:2])
            found = {q[1]: sides(*q[1:]) for q in next_ones if q[1] not in ready}
            summed = add(np.stack([h for _, h in found.values()]))
            ready |= {leaf: (small, h) for (leaf, (small, _)), h in zip(found.items(), summed, strict=True)}
        _, leaf, feature, goes = heapq.heappop(queue)
        small, held = ready.pop(leaf)
        rows, before = leaves[leaf], counts[leaf]
        to_left = goes[table.columns[feature][rows]]
        splits.append((leaf, feature, goes))
        leaves[leaf] = rows[to_left]
        leaves.append(rows[~to_left])
        counts[leaf] = held if small else before - held
        counts.append(before - held if small else held)
        offer(leaf)
        offer(len(leaves) - 1)
    return splits, leaves


# the model


@dataclass
class Model:
    """Cuts of the numeric features, start value, and for every tree its splits and leaf values."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[list, np.ndarray]]

    def leaves(self, columns: list[np.ndarray], splits: list) -> np.ndarray:
        """Each row's leaf, by the splits in the order they were taken."""
        at = np.zeros(len(columns[0]), np.int32)
        for number, (leaf, feature, goes) in enumerate(splits, 1):
            rows = np.flatnonzero(at == leaf)
            bins = columns[feature][rows]
            known = bins < len(goes)  # a category that no row of the fit had goes right
            at[rows[~(known & goes[np.minimum(bins, len(goes) - 1)])]] = number
        return at

    def predict(self, numbers: list[np.ndarray], categories: list[np.ndarray]) -> np.ndarray:
        columns = [np.searchsorted(e, x, side="left") for e, x in zip(self.edges, numbers, strict=True)] + [np.asarray(c, int) for c in categories]
        out = np.full(len(columns[0]), self.start)
        for splits, values in self.trees:
            out += values[self.leaves(columns, splits)]
        return out

    def dump(self) -> bytes:
        """As arrays in one file; no code is stored."""
        held = {f"e{i}": e for i, e in enumerate(self.edges)}
        splits = [(t, leaf, feature, goes) for t, (s, _) in enumerate(self.trees) for leaf, feature, goes in s]
        held |= {
            "start": np.array(self.start), "at": np.array([s[:3] for s in splits], np.int32).reshape(-1, 3), "widths": np.array([len(s[3]) for s in splits], np.int32),
            "goes": np.packbits(np.concatenate([s[3] for s in splits]) if splits else np.zeros(0, bool)),
            "sizes": np.array([len(v) for _, v in self.trees], np.int32), "values": np.concatenate([v for _, v in self.trees]) if self.trees else np.zeros(0),
        }
        out = io.BytesIO()
        np.savez_compressed(out, **held)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            edges = [held[f"e{i}"] for i in range(sum(k[1:].isdigit() and k[0] == "e" for k in held.files))]
            widths, sizes, at, values = held["widths"], held["sizes"], held["at"], held["values"]
            bits, start = np.unpackbits(held["goes"], count=int(widths.sum())).astype(bool), float(held["start"])
        ends, stops = np.concatenate([[0], np.cumsum(widths)]), np.concatenate([[0], np.cumsum(sizes)])
        trees: list[tuple[list, np.ndarray]] = [([], values[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
        for i, (tree, leaf, feature) in enumerate(at.tolist()):
            trees[tree][0].append((leaf, feature, bits[ends[i] : ends[i + 1]]))
        return Model(edges, start, trees)


def fit(numbers: list[np.ndarray], categories: list[np.ndarray], sizes: list[int], y: np.ndarray, p: Boosting = DEFAULTS, total: Total | None = None) -> Model:
    """Boost from the median: each tree is grown on the signs of the errors, and each leaf moves by a share of its median error.

    ``sizes`` are the numbers of categories. With ``total``, which adds up an array
    over all tasks, every task gets the model of all tasks' rows.
    """
    shares = np.arange(1, p.bins) / p.bins
    edges = [np.unique(e) for e in order_statistics(numbers, shares, total)]
    binned = [np.searchsorted(e, x, side="left") for e, x in zip(edges, numbers, strict=True)]
    table = Table(binned + list(categories), [len(e) + 1 for e in edges] + list(sizes), len(binned))
    half = np.array([0.5])
    start = float(order_statistics([y], half, total)[0][0])
    ahead, draw, trees = np.full(len(y), start), np.random.default_rng(p.seed), []
    many = len(table.widths)
    used = max(1, round(p.share * many))
    for _ in range(p.rounds):
        chosen = np.sort(draw.choice(many, used, replace=False))
        errors = y - ahead
        splits, leaves = grow(table, (1 - np.sign(errors)).astype(np.int32), chosen, p, total)
        if not splits:
            trees.append(([], np.zeros(1)))
            continue
        medians = order_statistics([errors[rows] for rows in leaves], half, total, bits=11)
        values = np.array([p.rate * m[0] if len(m) else 0.0 for m in medians])
        for rows, value in zip(leaves, values, strict=True):
            ahead[rows] += value
        trees.append((splits, values))
    return Model(edges, start, trees)


# on Spark


def rows_of_windows(x: np.ndarray, levels: np.ndarray, series: np.ndarray, calendar: np.ndarray, first_day: int, steps, anchors=None) -> tuple[list, list, np.ndarray]:
    """Numbers, categories and outcomes of scaled windows ``x`` (series, days); ``calendar`` has a row a day: dow, day of year, holiday, observed.

    Rows run over steps, then series, then anchors; outcomes beyond the window are NaN.
    """
    n = x.shape[1]
    sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)
    parts: list[list[np.ndarray]] = []
    for step in steps:
        a = np.arange(LOOKBACK - 1, n - step) if anchors is None else np.asarray(anchors)
        week = -(-step // SEASON)
        columns = [x[:, a + step - SEASON * (week + k - 1)] for k in range(1, SAME_WEEKDAYS + 1)]
        columns += [x[:, a - k] for k in RECENT] + [(sums[:, a + 1] - sums[:, a + 1 - k]) / k for k in MEANS]
        days = calendar[first_day + a + step]
        whole = lambda v: np.broadcast_to(v, (len(x), len(a)))  # noqa: B023, E731
        columns += [whole(float(step)), *(whole(days[:, j]) for j in (1, 2, 3)), whole(series[:, None]), whole(levels[:, None]), whole(days[:, 0])]
        inside = np.minimum(a + step, n - 1)
        columns.append(np.where(a + step < n, x[:, inside], np.nan))
        parts.append([c.ravel() for c in columns])
    every = [np.concatenate(c) for c in zip(*parts, strict=True)]
    k = len(NUMBERS)
    return every[:k], [c.astype(np.int64) for c in every[k : k + len(CATEGORIES)]], every[-1]


def _calendar(panel: DataFrame, horizon: int) -> np.ndarray:
    """One row a day of the panel and the horizon after it: as long as history, whatever the number of series."""
    lo, hi = panel.agg(F.min("day"), F.max("day")).first()
    days = panel.sparkSession.range(1).select(F.explode(F.sequence(F.lit(lo), F.date_add(F.lit(hi), horizon))).alias("day"))
    rows = calendar_features(days).distinct().orderBy("day").select("dow", F.dayofyear("day"), F.col("is_holiday").cast("int"), F.col("is_holiday_observed").cast("int"))
    return np.array([tuple(r) for r in rows.collect()], float)


def _windows(panel: DataFrame, node_ord: DataFrame, origins: DataFrame) -> DataFrame:
    code = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.col("level")) - 1
    names = node_ord.select("node", "level", code.cast("int").alias("level_code"), F.col("node_ord").cast("int").alias("series"))
    return training_windows(panel, origins).join(names, "node").join(F.broadcast(origins.select("origin", "train_from", "refit_origin")), "origin")


def _gathered(task: BarrierTaskContext) -> Total:
    """Adds up an array of whole numbers over the tasks of a barrier stage; Spark takes about a second for each exchange."""

    def total(x: np.ndarray) -> np.ndarray:
        sent = task.allGather(base64.b64encode(np.ascontiguousarray(x, np.int64).tobytes()).decode())
        return sum(np.frombuffer(base64.b64decode(s), np.int64) for s in sent).reshape(x.shape)

    return total


def fitted(panel: DataFrame, node_ord: DataFrame, origins: DataFrame, schedule: Schedule, p: Boosting = DEFAULTS, one_task: int = ONE_TASK) -> DataFrame:
    """``refit_origin, model binary, seconds``: a model for every refit origin, learned from all anchors of all series' windows."""
    calendar, many = _calendar(panel, schedule.horizon), node_ord.count()
    refits = origins.filter("refit")
    window = schedule.train_window or panel.agg(F.max("day_idx")).first()[0] + 1
    if (schedule.train_window or schedule.min_train) < LOOKBACK + schedule.horizon:
        raise ValueError(f"the training window must have {LOOKBACK + schedule.horizon} days or more")
    steps, schema = range(1, schedule.horizon + 1), "refit_origin int, model binary, seconds double"

    def learn(rows: pd.DataFrame, total: Total | None) -> Model:
        rows = rows.sort_values("series")
        x = np.stack(rows["train"].to_numpy()) if len(rows) else np.zeros((0, LOOKBACK + schedule.horizon))
        x = x / np.maximum(x.mean(axis=1, keepdims=True), 1.0) if len(rows) else x
        first = int(rows["train_from"].iloc[0]) if len(rows) else 0
        numbers, categories, y = rows_of_windows(x, rows["level_code"].to_numpy(), rows["series"].to_numpy(), calendar, first, steps)
        return fit(numbers, categories, [many, len(LEVELS), SEASON], y, p, total)

    if many * window * schedule.horizon <= one_task:

        def alone(rows: pd.DataFrame) -> pd.DataFrame:
            began = time.time()
            model = learn(rows, None).dump()
            return pd.DataFrame({"refit_origin": [int(rows["refit_origin"].iloc[0])], "model": [model], "seconds": [time.time() - began]})

        # more parts than fits: keys of a few refits would share tasks by chance
        rows = _windows(panel, node_ord, refits).repartition(8 * max(refits.count(), 1), "refit_origin")
        return rows.groupBy("refit_origin").applyInPandas(alone, schema)

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, began = BarrierTaskContext.get(), time.time()
        rows = pd.concat(batches) if (batches := list(batches)) else pd.DataFrame({c: [] for c in ("train", "train_from", "level_code", "series")})
        model = learn(rows, _gathered(task)).dump()
        if task.partitionId() == 0:
            yield pd.DataFrame({"refit_origin": [refit], "model": [model], "seconds": [time.time() - began]})

    out, tasks = None, max(1, panel.sparkSession.sparkContext.defaultParallelism)
    for refit in [r["origin"] for r in refits.orderBy("origin").collect()]:
        rows = _windows(panel, node_ord, refits.filter(F.col("origin") == refit)).repartition(tasks, "series")
        own = rows.mapInPandas(together, schema, barrier=True)
        kept = panel.sparkSession.createDataFrame(own.collect(), schema)  # a model, not rows
        out = kept if out is None else out.unionByName(kept)
    return out


def served(panel: DataFrame, node_ord: DataFrame, origins: DataFrame, models: DataFrame, schedule: Schedule, name: str) -> DataFrame:
    """``model, origin, node, level, step, point``: every origin is forecast by its refit's model from its own last days, floored at 0."""
    calendar, horizon = _calendar(panel, schedule.horizon), schedule.horizon
    mean = F.aggregate("train", F.lit(0.0), lambda a, v: a + v) / F.size("train")
    last = _windows(panel, node_ord, origins).select(
        "refit_origin", "origin", "node", "level", "level_code", "series", (F.col("train_from") + F.size("train") - LOOKBACK).alias("from_day"),
        F.greatest(mean, F.lit(1.0)).alias("scale"), F.slice("train", -LOOKBACK, LOOKBACK).alias("train"),
    )

    def run(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        columns = ["model", "origin", "node", "level", "step", "point"]
        if not len(rows) or not len(kept):
            return pd.DataFrame(columns=columns)
        model, out = Model.load(kept["model"].iloc[0]), []
        for origin, own in rows.groupby("origin"):
            scale = own["scale"].to_numpy()
            x = np.stack(own["train"].to_numpy()) / scale[:, None]
            numbers, categories, _ = rows_of_windows(x, own["level_code"].to_numpy(), own["series"].to_numpy(), calendar, int(own["from_day"].iloc[0]), range(1, horizon + 1), [LOOKBACK - 1])
            point = np.maximum(model.predict(numbers, categories).reshape(horizon, -1) * scale, 0.0)
            for step in range(1, horizon + 1):
                out.append(pd.DataFrame({"model": name, "origin": origin, "node": own["node"], "level": own["level"], "step": step, "point": point[step - 1]}))
        return pd.concat(out)[columns]

    return (
        last.groupBy("refit_origin").cogroup(models.groupBy("refit_origin"))
        .applyInPandas(run, "model string, origin int, node string, level string, step int, point double")
    )


def boosted(panel: DataFrame, node_ord: DataFrame, origins: DataFrame, schedule: Schedule, p: Boosting = DEFAULTS) -> DataFrame:
    """Forecasts of ``served`` from models of ``fitted``, which are fitted as they are needed."""
    models = fitted(panel, node_ord, origins, schedule, p)
    return served(panel, node_ord, origins, models, schedule, f"boosted-refit{schedule.refit_every}")
