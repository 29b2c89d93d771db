"""The multi-rate network: gradients by differences, order and sign of quantiles, repeatability, and what it learns."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from ramify.config import REPORTING, SCORING, Schedule
from ramify.operators import neural
from ramify.operators import schedule as plan

TINY = neural.Network(days=28, steps=60, batch=16, hidden=8, pools=(4, 1), strides=(7, 1), knots=5)


def test_interpolation_reads_lines_between_knots():
    knots, wanted = np.array([0.0, 2.0, 5.0]), np.array([-1.0, 0.0, 1.0, 3.5, 5.0, 9.0])
    values = np.array([1.0, 5.0, -1.0])
    assert np.allclose(values @ neural.interpolation(knots, wanted), np.interp(wanted, knots, values))
    assert np.allclose(neural.interpolation(np.array([3.0]), wanted), 1)


def test_gradients_equal_differences():
    net, rng = neural.Stacks(TINY, 14, REPORTING), np.random.default_rng(0)
    weights = [w + rng.normal(0, 0.05, w.shape) for w in net.start()]
    x, y = rng.normal(size=(6, 28)), rng.normal(size=(6, 14))
    _, found = net.gradients(weights, x, y)
    for w, g in zip(weights, found, strict=True):
        for at in rng.integers(0, w.size, 6):
            place, step = np.unravel_index(at, w.shape), 1e-6
            before = w[place]
            w[place] = before + step
            up = net.gradients(weights, x, y)[0]
            w[place] = before - step
            down = net.gradients(weights, x, y)[0]
            w[place] = before
            assert (up - down) / (2 * step) == pytest.approx(g[place], abs=2e-6)


def test_training_lowers_the_loss_and_repeats():
    net, rng = neural.Stacks(TINY, 14, REPORTING), np.random.default_rng(1)
    series = 100 + 30 * np.sin(np.arange(200) * 2 * np.pi / 10) + rng.normal(0, 2, (4, 200))
    windows = np.stack([series[:, k : k + 42] for k in range(0, 150, 5)]).reshape(-1, 42)
    middle, spread = neural.scaled(windows[:, :28])
    windows = (windows - middle) / spread
    loss = lambda w: net.gradients(w, windows[:, :28], windows[:, 28:])[0]
    start = net.start()
    trained = net.train(start, series, 300, 7)
    assert loss(trained) < 0.6 * loss(start)
    assert all(np.array_equal(a, b) for a, b in zip(trained, net.train(start, series, 300, 7), strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(trained, neural.load(neural.dump(trained)), strict=True))


SCHEDULE = Schedule(horizon=14, step=7, refit_every=2, min_train=60, train_window=60)


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(0), []
    for k, node in enumerate(("ALL", "ALL/A", "ALL/B", "ALL/Z")):
        for t in range(100):
            rows.append((node, "area", date(2020, 1, 6) + timedelta(days=t), t, 0.0 if node == "ALL/Z" else float(10 ** (k + 1) * (1 + 0.3 * (t % 7 < 2)) * rng.normal(1, 0.05))))
    return spark.createDataFrame(rows, "node string, level string, day date, day_idx int, value double").cache()


@pytest.mark.parametrize("series", [512, 1])
def test_every_origin_is_served_with_ordered_quantiles(spark, panel, series):
    from dataclasses import replace

    origins, p = plan.origins(spark, 100, SCHEDULE), replace(TINY, series=series, rounds=3)
    models = neural.fitted(panel, origins, SCHEDULE, SCORING, p).cache()
    assert sorted(r["refit_origin"] for r in models.collect()) == [0, 2]
    found = neural.served(panel, origins, models, SCHEDULE, SCORING, "n", p).toPandas()
    assert len(found) == 4 * 14 * origins.count()
    q = np.stack(found["q"])
    assert q.shape[1] == 199 and (q >= 0).all() and (np.diff(q, axis=1) >= 0).all() and np.isfinite(q).all()
    again = neural.forecast(panel, origins, SCHEDULE, SCORING, p).toPandas()
    order = ["origin", "node", "step"]
    assert np.array_equal(np.stack(found.sort_values(order)["q"]), np.stack(again.sort_values(order)["q"]))


def test_days_after_the_origin_change_nothing(spark, panel):
    origins = plan.origins(spark, 100, SCHEDULE).filter("origin < 2")
    last = origins.agg(F.max("origin_idx")).first()[0]
    spoiled = panel.withColumn("value", F.when(F.col("day_idx") > last, -7.0).otherwise(F.col("value")))
    a, b = (np.stack(neural.forecast(x, origins, SCHEDULE, REPORTING, TINY).orderBy("origin", "node", "step").toPandas()["q"]) for x in (panel, spoiled))
    assert np.array_equal(a, b)


def test_short_windows_and_wrong_levels_are_refused(spark, panel):
    with pytest.raises(ValueError, match="42 days"):
        neural.fitted(panel, plan.origins(spark, 100, SCHEDULE), Schedule(min_train=40, train_window=40), REPORTING, TINY)
    with pytest.raises(ValueError, match="levels"):
        neural.fitted(panel, plan.origins(spark, 100, SCHEDULE), SCHEDULE, (0.5, 0.4), TINY)
