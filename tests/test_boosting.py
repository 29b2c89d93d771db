"""Leaf-wise boosting: choices against loops, one task against several, windows against the feature table, and what it learns."""

import threading
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from ramify.config import Schedule
from ramify.operators import boosting, design
from ramify.operators import schedule as plan

SMALL = boosting.Boosting(rounds=12, leaves=7, least=5, bins=16)


def table_of(rng, n=400):
    columns = [rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 70, n), rng.integers(0, 6, n)]
    return boosting.Table(columns, [9, 5, 70, 6], 3)


def test_histograms_count_every_row():
    rng = np.random.default_rng(0)
    table, state = table_of(rng), rng.integers(0, 3, 400)
    for rows in (None, np.flatnonzero(rng.random(400) < 0.3)):
        got, own = table.histogram(rows, state), range(400) if rows is None else rows
        for f, column in enumerate(table.columns):
            for b in range(table.widths[f]):
                assert got[table.begins[f] + b].tolist() == [sum(column[r] == b and state[r] == g for r in own) for g in range(3)]


def plain_best(table, rows, state, chosen, p):
    """Gain of the best split by trying every bin of every feature."""
    gradient = state - 1.0
    worth = lambda held, extra=0.0: gradient[held].sum() ** 2 / (len(held) + extra)
    best = 0.0
    for f in chosen:
        bins = table.columns[f]
        order, extra = list(range(table.widths[f])), 0.0
        if f >= table.numeric:
            means = {b: gradient[rows[bins[rows] == b]].sum() / ((bins[rows] == b).sum() + p.smooth) for b in set(bins[rows].tolist())}
            order, extra = sorted(means, key=lambda b: (means[b], b)), p.penalty
        for k in range(1, len(order)):
            goes = np.isin(bins[rows], order[:k])
            left, right = rows[goes], rows[~goes]
            if min(len(left), len(right)) >= p.least:
                best = max(best, worth(left, extra) + worth(right, extra) - worth(rows))
    return best


def test_splits_and_the_leaf_taken_equal_brute_force():
    rng = np.random.default_rng(1)
    for chosen in (np.arange(4), np.array([1, 3]), np.array([2])):
        table = table_of(rng)
        state = (1 + np.sign(table.columns[0] - 3 + 2 * (table.columns[3] % 2) + rng.normal(0, 2, 400))).astype(np.int64)
        splits, leaves = boosting.grow(table, state, chosen, SMALL)
        held = [np.arange(400)]
        for leaf, feature, goes in splits:
            best = [plain_best(table, rows, state, chosen, SMALL) for rows in held]
            assert best[leaf] == pytest.approx(max(best))
            rows = held[leaf]
            to_left = goes[table.columns[feature][rows]]
            gradient = state - 1.0
            extra = SMALL.penalty if feature >= table.numeric else 0.0
            taken = sum(gradient[x].sum() ** 2 / (len(x) + extra) for x in (rows[to_left], rows[~to_left])) - gradient[rows].sum() ** 2 / len(rows)
            assert taken == pytest.approx(best[leaf])
            held[leaf] = rows[to_left]
            held.append(rows[~to_left])
        assert len(splits) and all(np.array_equal(a, b) for a, b in zip(held, leaves, strict=True))
        assert len(leaves) == SMALL.leaves or max(plain_best(table, rows, state, chosen, SMALL) for rows in held) <= 1e-9


def test_order_statistics_of_parts_equal_those_of_the_whole():
    rng = np.random.default_rng(2)
    groups = [rng.normal(size=301) * 10.0 ** rng.integers(-9, 9, 301), np.array([0.0, -0.0, 0.0]), np.zeros(0), rng.integers(-3, 3, 100).astype(float), np.array([-5.5])]
    shares = np.array([0.01, 0.25, 0.5, 0.99])
    whole = boosting.order_statistics(groups, shares)
    parts = [[g[k::3] for g in groups] for k in range(3)]
    barrier, results = threading.Barrier(3), [None] * 3
    sent: dict[int, np.ndarray] = {}

    def task(k):
        def total(x):
            sent[k] = x
            barrier.wait()
            out = sum(sent.values())
            barrier.wait()
            return out

        results[k] = [boosting.order_statistics(parts[k], shares, total, bits) for bits in (8, 11)]

    threads = [threading.Thread(target=task, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    for got in [g for r in results for g in r]:
        assert all(np.array_equal(a, b) for a, b in zip(got, whole, strict=True))


WEEKLY = Schedule(horizon=14, step=7, refit_every=4, min_train=380, train_window=380)


@pytest.fixture(scope="module")
def weekly(spark):
    """Three series of one weekly shape on different scales, with two per cent of noise."""
    rng = np.random.default_rng(0)
    shape = np.array([1.3, 1.1, 1.0, 0.95, 0.9, 0.8, 0.95])
    rows = []
    for node, level, scale in (("ALL", "city", 4000.0), ("ALL/A", "borough", 800.0), ("ALL/A/a", "area", 20.0)):
        for t in range(430):
            rows.append((node, level, date(2015, 1, 5) + timedelta(days=t), t, float(scale * shape[t % 7] * rng.normal(1, 0.02))))
    panel = spark.createDataFrame(rows, "node string, level string, day date, day_idx int, value double").cache()
    nodes = panel.select("node", "level").distinct().orderBy("node").toPandas()
    node_ord = spark.createDataFrame([(r.node, r.level, i) for i, r in enumerate(nodes.itertuples())], "node string, level string, node_ord int")
    return panel, node_ord, plan.origins(spark, 430, WEEKLY)


def test_windows_make_the_rows_of_the_feature_table(spark, weekly):
    panel, node_ord, origins = weekly
    last = origins.filter("origin = 4").first()
    x = np.array([[r["value"] for r in panel.filter(F.col("node") == n["node"]).orderBy("day_idx").collect()] for n in node_ord.orderBy("node_ord").collect()])
    window = x[:, last["train_from"] : last["origin_idx"] + 1]
    calendar = boosting._calendar(panel, 14)
    numbers, categories, y = boosting.rows_of_windows(window, np.array([0, 1, 2]), np.arange(3), calendar, last["train_from"], range(1, 15))
    first = last["train_from"] + design.LOOKBACK - 1
    table = design.design(panel, node_ord, 14).filter(F.col("day_idx").between(first, last["origin_idx"]) & (F.col("target_idx") <= last["origin_idx"]))
    outcome = panel.select("node", F.col("day_idx").alias("target_idx"), F.col("value").alias("y"))
    want = table.join(outcome, ["node", "target_idx"]).orderBy("step", "series", "day_idx").toPandas()
    assert len(want) == len(y) and np.allclose(want["y"], y)
    for name, column in zip((*boosting.NUMBERS, *boosting.CATEGORIES), (*numbers, *categories), strict=True):
        assert np.allclose(want[name].to_numpy(float), column), name


def test_the_model_learns_the_shape_and_serves_until_the_next_refit(spark, weekly):
    panel, node_ord, origins = weekly
    models = boosting.fitted(panel, node_ord, origins, WEEKLY, boosting.Boosting(rounds=60, leaves=15)).cache()
    assert sorted(r["refit_origin"] for r in models.collect()) == [0, 4]
    assert all(r["seconds"] > 0 for r in models.collect())
    found = boosting.served(panel, node_ord, origins, models, WEEKLY, "b").join(plan.actuals(panel, origins, WEEKLY).drop("level"), ["origin", "node", "step"]).toPandas()
    assert len(found) == 3 * 14 * origins.count() and (found["point"] >= 0).all()
    flat = panel.groupBy("node").agg(F.avg("value").alias("flat")).toPandas().set_index("node")["flat"]
    error, plain = abs(found["point"] - found["y"]) / found["y"], abs(found["node"].map(flat) - found["y"]) / found["y"]
    assert error.mean() < 0.5 * plain.mean()
    again = boosting.Model.load(models.orderBy("refit_origin").first()["model"])
    assert again.dump() == models.orderBy("refit_origin").first()["model"] or len(again.trees) == 60


def test_days_after_the_origin_change_nothing(spark, weekly):
    panel, node_ord, origins = weekly
    one = origins.filter("origin = 0")
    cut = one.first()["origin_idx"]
    spoiled = panel.withColumn("value", F.when(F.col("day_idx") > cut, 1e9).otherwise(F.col("value")))
    a, b = (boosting.boosted(p, node_ord, one, WEEKLY, SMALL).orderBy("node", "step").toPandas()["point"].tolist() for p in (panel, spoiled))
    assert a == b


def test_a_barrier_of_tasks_fits_the_model_of_one(spark, weekly):
    panel, node_ord, origins = weekly
    first = origins.filter("origin = 0")
    few = boosting.Boosting(rounds=2, leaves=7, least=5, bins=16)
    one = boosting.fitted(panel, node_ord, first, WEEKLY, few).first()["model"]
    many = boosting.fitted(panel, node_ord, first, WEEKLY, few, one_task=0).first()["model"]
    a, b = boosting.Model.load(one), boosting.Model.load(many)
    assert a.start == b.start and all(np.array_equal(x, y) for x, y in zip(a.edges, b.edges, strict=True))
    for (s, v), (t, w) in zip(a.trees, b.trees, strict=True):
        assert np.array_equal(v, w) and [(x[0], x[1], x[2].tolist()) for x in s] == [(x[0], x[1], x[2].tolist()) for x in t]


def test_windows_too_short_are_refused(spark, weekly):
    panel, node_ord, origins = weekly
    with pytest.raises(ValueError, match="105 days"):
        boosting.fitted(panel, node_ord, origins, Schedule(min_train=100, train_window=100), SMALL)
