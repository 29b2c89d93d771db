from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from ramify.config import REPORTING, SCORING, Schedule
from ramify.functions import scores
from ramify.operators import conformal, decision, hierarchy, inference, naive, reconcile, statistical
from ramify.operators import schedule as plan

PLAN = Schedule(horizon=14, step=7, min_train=60, train_window=60)


def panel_of(spark, x, node="ALL"):
    return spark.createDataFrame([(node, "city", k, float(v)) for k, v in enumerate(x)], "node string, level string, day_idx int, value double")


def test_quiet_day_is_zero_and_sums_go_up(spark):
    day = lambda k: date(2020, 1, 1) + timedelta(k)
    rows = [(day(k), "BRONX", "B1", 10.0) for k in range(100)] + [(day(k), "BRONX", "B2", 4.0) for k in range(100) if k != 40]
    rows += [(day(k), "QUEENS", "LATE", 10.0) for k in range(95, 100)]
    counts = spark.createDataFrame(rows, "day date, borough string, area string, n double")
    got = {(r["node"], r["day_idx"]): r["value"] for r in hierarchy.panel(counts).collect()}
    assert (got["ALL/BRONX/B2", 40], got["ALL", 40], got["ALL", 39]) == (0.0, 10.0, 14.0)
    assert not any("LATE" in node for node, _ in got)
    assert hierarchy.dropped_share(counts).first()["dropped"] == 50.0


def test_double_ownership_is_refused(spark):
    with pytest.raises(ValueError):
        hierarchy.nodes(spark.createDataFrame([("A", "X"), ("B", "X")], "borough string, area string"))


def test_second_week_repeats_the_week_before_the_last_as_built(spark):
    ramp = panel_of(spark, range(200))
    origins = plan.origins(spark, 200, PLAN)
    built = {r["step"]: r["point"] for r in naive.points(ramp, origins, PLAN).filter("origin = 0").collect()}
    prose = {r["step"]: r["point"] for r in naive.points(ramp, origins, PLAN, "documented").filter("origin = 0").collect()}
    assert 59 + 8 - built[8] == 21 and 59 + 8 - prose[8] == 14 and built[1] == prose[1] == 53


def test_naive_sees_nothing_after_its_origin(spark):
    x = np.random.default_rng(1).poisson(20, 200).astype(float)
    y = x.copy()
    y[60:] = 1e6
    origins = plan.origins(spark, 200, PLAN).filter("origin = 0")
    a, b = (naive.seasonal_naive(panel_of(spark, v), origins, PLAN, REPORTING).orderBy("step").collect() for v in (x, y))
    assert [r["q"] for r in a] == [r["q"] for r in b] and all(sorted(r["q"]) == r["q"] and r["q"][0] >= 0 for r in a)


def test_crps_matches_the_normal_closed_form_and_points(spark):
    from statistics import NormalDist

    q = [NormalDist(100, 15).inv_cdf(t) for t in SCORING]
    rows = spark.createDataFrame([(q, 90.0), (q, 140.0), ([90.0] * 199, 100.0), ([130.0] * 199, 100.0)], "q array<double>, y double")
    got = [r[0] for r in rows.select(scores.crps(F.col("q"), F.col("y"), SCORING)).collect()]
    assert got[0] == pytest.approx(scores.crps_normal(100, 15, 90), rel=2e-3)
    assert got[1] == pytest.approx(scores.crps_normal(100, 15, 140), rel=5e-3)
    assert got[2:] == pytest.approx([10.0, 30.0])


def test_rolling_needs_a_full_window(spark):
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(6)], "k string, origin int, v double")
    assert [r["rolling"] for r in scores.rolling(rows, "v", 3, ["k"]).orderBy("origin").collect()] == [None, None, 1.0, 2.0, 3.0, 4.0]


def test_feedback_rule_and_order_statistics():
    assert [conformal.horizon_lag(s, 7) for s in (1, 7, 8, 14, 15)] == [1, 1, 2, 2, 3]
    assert [conformal.available_upto(*x, 7) for x in ((5, 1), (5, 14), (0, 1), (1, 14))] == [5, 4, 0, 0]
    assert conformal.ranks((0.01, 0.05, 0.5, 0.95, 0.999), 52) == [0, 2, 26, 50, 51]
    assert conformal.order_statistic(np.arange(1.0, 11), 0.1) == 10 and conformal.order_statistic(np.arange(1.0, 20), 0.1) == 18
    assert conformal.first_valid_origin(Schedule()) == 53


def test_adaptive_ignores_the_future_and_recovers():
    rng = np.random.default_rng(0)
    x = np.abs(np.concatenate([rng.normal(0, 10, 600), rng.normal(0, 30, 600)]))
    bad = x.copy()
    bad[700:] = 1e4
    for f in (lambda v: conformal.adapt(v, 1, 0.05)[0], lambda v: conformal.aggregate(v, 2)):
        np.testing.assert_array_equal(f(x)[:700], f(bad)[:700])
    half = conformal.adapt(x, 1, 0.05)[0]
    assert abs((x[900:] <= half[900:]).mean() - 0.9) < 0.03


def test_split_matches_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    y = rng.poisson(50, (80, 14)).astype(float)
    rows = [(o, "ALL", "city", s + 1, 50.0, float(y[o, s])) for o in range(80) for s in range(14)]
    frame = spark.createDataFrame(rows, "origin int, node string, level string, step int, point double, y double")
    for r in conformal.split(frame, Schedule()).collect():
        end = conformal.available_upto(r["origin"], r["step"], 7)
        known = np.sort(np.abs(y[max(0, end - 52) : end, r["step"] - 1] - 50))
        assert r["half"] == (conformal.order_statistic(known, 0.1) if len(known) else None)


def test_blocks_are_contiguous_and_block_sums_are_means(spark):
    starts = inference.block_starts(100, 7, 50, 9)
    assert starts.shape == (50, 15) and starts.max() <= 93
    x = np.random.default_rng(3).normal(size=100)
    series = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "k string, pos int, v double")
    got = {r["resample"]: r["v"] for r in inference.resampled_means(series, inference.block_table(spark, 100, 7, 50, 9), ["v"], ["k"]).collect()}
    for r, own in enumerate(starts):
        taken = np.concatenate([np.arange(s, s + 7) for s in own])[:100]
        assert got[r] == pytest.approx(x[taken].mean())


def test_reconciled_paths_are_coherent(spark):
    rng = np.random.default_rng(4)
    leaves = ["ALL/A/1", "ALL/A/2", "ALL/B/3", "ALL/B/4"]
    names = ["ALL", "ALL/A", "ALL/B", *leaves]
    s = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [0, 0, 1, 1], *np.eye(4)])
    y = rng.gamma(20, 2, (60, 4)) @ s.T
    base = y + rng.normal(0, 5, y.shape)
    rows = [(o, n, 1, float(base[o, k]), float(y[o, k])) for o in range(60) for k, n in enumerate(names)]
    edges = spark.createDataFrame([(n, leaf) for k, n in enumerate(names) for j, leaf in enumerate(leaves) if s[k, j]], "node string, leaf string")
    frame = spark.createDataFrame(rows, "origin int, node string, step int, point double, y double")
    got = reconcile.reconcile(frame, edges, Schedule(horizon=1), levels=(0.1, 0.5, 0.9)).toPandas()
    assert got["coherence"].max() < 1e-8 and got["origin"].min() == 52
    one = got[got["origin"] == 55].set_index("node")["median"]
    assert one["ALL"] == pytest.approx(one[leaves].sum()) and all(sorted(q) == list(q) for q in got["q"])


def test_shrinkage_reaches_the_diagonal_for_independent_errors():
    w, intensity = reconcile.shrunk_covariance(np.random.default_rng(0).normal(size=(30, 5)))
    assert 0.5 < intensity <= 1 and np.allclose(w, w.T)
    with pytest.raises(ValueError):
        reconcile.shrunk_covariance(np.ones((5, 2)))


def test_critical_ratio_is_the_best_staffing_level():
    demand = np.sort(np.random.default_rng(0).gamma(9, 11, 20001))
    for over, under in ((1, 4), (1, 1), (3, 1)):
        inputs = decision.DecisionInputs(cost_over=over, cost_under=under)
        cost = [over * np.maximum(s - demand, 0).mean() + under * np.maximum(demand - s, 0).mean() for s in np.quantile(demand, np.linspace(0.05, 0.95, 91))]
        assert abs(np.linspace(0.05, 0.95, 91)[int(np.argmin(cost))] - inputs.critical_ratio) < 0.02


def test_units_cost_and_levels(spark):
    inputs = decision.DecisionInputs()
    row = spark.createDataFrame([([10.0, 20.0, 40.0],)], "q array<double>")
    at = lambda p: row.select(decision.demand_at(F.col("q"), (0.1, 0.5, 0.9), p)).first()[0]
    assert at(0.5) == 20 and at(0.7) == pytest.approx(30)
    with pytest.raises(ValueError):
        at(0.95)
    units = spark.createDataFrame([(20.0,), (20.01,), (0.0,), (-3.0,)], "d double").select(decision.units_for(F.col("d"), inputs))
    assert [r[0] for r in units.collect()] == [2, 3, 0, 0]


def test_statistical_models_follow_a_weekly_series():
    rng = np.random.default_rng(0)
    x = np.tile([80, 100, 100, 100, 100, 130, 90], 60) + rng.normal(0, 5, 420)
    for model in statistical.MODELS.values():
        q = np.sort(model(x, 14, np.array(REPORTING)), axis=1)
        assert q.shape == (14, 11) and (q >= 0).all()
        assert np.abs(q[:, 5] - np.tile([80, 100, 100, 100, 100, 130, 90], 2)).max() < 15


def test_reconciliation_in_blocks_equals_each_origin_alone(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "BLOCK", 7)
    rng = np.random.default_rng(8)
    leaves = ["ALL/A/1", "ALL/A/2", "ALL/B/3"]
    names = ["ALL", "ALL/A", "ALL/B", *leaves]
    s = np.array([[1, 1, 1], [1, 1, 0], [0, 0, 1], *np.eye(3)])
    y = rng.gamma(20, 2, (75, 2, 3)) @ s.T
    base = y + rng.normal(0, 5, y.shape)
    rows = [(o, n, t + 7, float(base[o, t, k]), float(y[o, t, k])) for o in range(75) for t in range(2) for k, n in enumerate(names)]
    edges = spark.createDataFrame([(n, leaf) for k, n in enumerate(names) for j, leaf in enumerate(leaves) if s[k, j]], "node string, leaf string")
    frame = spark.createDataFrame(rows, "origin int, node string, step int, point double, y double")
    got = {(r["origin"], r["step"], r["node"]): r for r in reconcile.reconcile(frame, edges, Schedule(), levels=(0.1, 0.9)).collect()}
    assert {k[0] for k in got} == set(range(53, 75))
    for o in range(53, 75):
        for t in range(2):
            end = conformal.available_upto(o, t + 7, 7)
            e = (y - base)[end - 52 : end, t]
            x = e - e.mean(axis=0)
            cov, r, spread = x.T @ x / 51, np.corrcoef(x.T), 0.0
            z = x / x.std(axis=0, ddof=1)
            for i in range(6):
                for j in range(6):
                    if i != j:
                        w = z[:, i] * z[:, j]
                        spread += 52 / 51**3 * ((w - w.mean()) ** 2).sum()
            share = min(max(spread / ((r - np.eye(6)) ** 2).sum(), 0), 1)
            w = (1 - share) * cov + share * np.diag(np.diag(cov)) + reconcile.RIDGE * np.eye(6)
            inverse = np.linalg.inv(w)
            p = s @ np.linalg.inv(s.T @ inverse @ s) @ s.T @ inverse
            want, paths = p @ base[o, t], np.sort((base[o, t] + e) @ p.T, axis=0)
            for k, n in enumerate(names):
                r = got[o, t + 7, n]
                assert r["median"] == pytest.approx(want[k], abs=1e-6) and r["intensity"] == pytest.approx(share)
                assert r["q"] == pytest.approx([paths[i, k] for i in conformal.ranks((0.1, 0.9), 52)], abs=1e-6)


def test_models_on_another_grid_get_a_conformal_distribution(spark):
    rng = np.random.default_rng(9)
    rows = [(m, o, "a", 1, [50.0] if m == "point" else [40.0, 50.0, 60.0], float(rng.poisson(50))) for m in ("point", "own") for o in range(60)]
    frame = spark.createDataFrame(rows, "model string, origin int, node string, step int, q array<double>, y double")
    got = conformal.distribution(frame, Schedule(), (0.1, 0.5, 0.9), {"point": (0.5,)})
    sizes = {(r["model"], r["n"]): r["count"] for r in got.groupBy("model", F.size("q").alias("n")).count().collect()}
    assert sizes == {("own", 3): 60, ("point", 3): 7}
    with pytest.raises(Exception, match="grid"):
        conformal.distribution(frame, Schedule(), (0.1, 0.5, 0.9), {}).collect()


def test_own_windows_overlap_and_are_refused_when_empty(spark):
    days = spark.createDataFrame([(o, date(2023, 11, 26) + timedelta(o)) for o in range(6)], "origin int, day date")
    rows = plan.in_windows(days.select("origin"), days, (("late", "2023-11-30"), ("later", "2023-12-01")))
    assert {(r["window"], r["origin"], r["first_day"].day) for r in rows.collect()} == {("late", 4, 30), ("late", 5, 30), ("later", 5, 1)}
    with pytest.raises(ValueError):
        plan.clean_origins(days.selectExpr("origin", "origin as origin_idx"), days.selectExpr("origin as day_idx", "day"), "2024-01-01")


def test_softmin_is_even_where_a_loss_is_not_finite():
    assert conformal.softmin(np.array([[1.0, np.inf], [1.0, 2.0]]), 0.05).tolist() == [[0.5, 0.5], [0.5, 0.5]]
    a, b = conformal.softmin(np.array([0.0, 20.0]), 0.05)
    assert a / b == pytest.approx(np.e)


def test_service_quantile_is_held_inside_the_bands(spark):
    row = spark.createDataFrame([([10.0, 20.0, 40.0],)], "b array<double>")
    at = lambda p: row.select(decision.service_quantile(F.col("b"), (0.05, 0.5, 0.95), p)).first()[0]
    assert [at(p) for p in (0.01, 0.05, 0.5, 0.95, 0.99)] == [10, 10, 20, 40, 40] and at(0.725) == pytest.approx(30)
    assert decision.DecisionInputs().slider_levels == [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def test_multiplying_seasons_and_moving_averages_are_found():
    rng = np.random.default_rng(3)
    week = np.array([0.6, 0.9, 1.0, 1.0, 1.1, 1.5, 0.9])
    growing = np.linspace(60, 400, 420) * np.tile(week, 60) + rng.normal(0, 2, 420)
    want = np.linspace(400, 400 + 14 * 340 / 419, 14) * np.tile(week, 2)
    q = np.sort(statistical.ets(growing, 14, np.array(REPORTING)), axis=1)
    assert np.abs(q[:, 5] / want - 1).max() < 0.06
    shocks = rng.normal(0, 4, 1000)
    noisy = 100 + shocks + 0.8 * np.concatenate([[0], shocks[:-1]])  # one lag of memory
    q = np.sort(statistical.arima(noisy, 14, np.array(REPORTING)), axis=1)
    wide = q[:, 8] - q[:, 2]
    assert abs(q[0, 5] - (100 + 0.8 * shocks[-1])) < 2.5 and np.abs(q[2:, 5] - 100).max() < 2.5
    assert wide[0] == pytest.approx(3.29 * 4, rel=0.15) and wide[5] == pytest.approx(3.29 * 4 * 1.64**0.5, rel=0.15)
    walk = 500 + np.cumsum(rng.normal(0, 3, 1000))
    q = np.sort(statistical.arima(walk, 14, np.array(REPORTING)), axis=1)
    assert np.abs(q[:, 5] - walk[-1]).max() < 8 and (q[13, 8] - q[13, 2]) == pytest.approx(3.29 * 3 * 14**0.5, rel=0.25)


def test_ranked_counts_equal_sorted_windows():
    draw = np.random.default_rng(4)
    for values in (draw.normal(size=300), draw.integers(0, 6, 300).astype(float), np.zeros(50)):
        counts, levels = naive.RankedCounts(values), np.array([0.005, 0.25, 0.5, 0.9, 0.995])
        low = high = 0
        for new_low, new_high in [(0, 1), (0, 40), (7, 47), (40, 48), (49, 50)]:
            counts.move(np.arange(max(high, new_low), new_high), 1)
            counts.move(np.arange(low, min(new_low, high)), -1)
            low, high = new_low, new_high
            assert counts.n == high - low
            assert np.allclose(counts.quantiles(levels), np.quantile(values[low:high], levels), atol=1e-12)


def test_residual_quantiles_skip_days_without_a_value(spark):
    plan = Schedule(horizon=14, step=7, min_train=28, train_window=28)
    draw = np.random.default_rng(9)
    series = {d: float(v) for d, v in enumerate(draw.integers(0, 30, 63)) if d not in (5, 20, 33)}
    panel = spark.createDataFrame([("n", d, v) for d, v in series.items()], "node string, day_idx int, value double")
    origins = spark.createDataFrame([(k, 27 + 7 * k, 7 * k) for k in range(4)], "origin int, origin_idx int, train_from int")
    found = {(r["origin"], r["lag"]): r["residuals"] for r in naive.residual_quantiles(panel, origins, plan, (0.1, 0.5, 0.9)).collect()}
    assert len(found) == 8
    for (k, lag), got in found.items():
        d = [series[t] - series[t - lag] for t in range(7 * k + lag, 28 + 7 * k) if t in series and t - lag in series]
        assert np.allclose(got, np.quantile(d, [0.1, 0.5, 0.9]))


def test_shares_of_nothing_are_null_or_refused(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0.0), (1.0, 3.0, 4.0), (1.0, 3.0, None)], "low double, high double, y double")
    width = lambda strict: scores.relative_width(F.col("low"), F.col("high"), F.col("y"), strict)
    assert [r[0] for r in rows.select(width(False)).collect()] == [None, 0.5, None]
    assert [r[0] for r in rows.filter("y is null or y > 0").select(width(True)).collect()] == [0.5, None]
    with pytest.raises(Exception, match="relative width needs a positive divisor"):
        rows.select(width(True)).collect()
    with pytest.raises(Exception, match="skill needs a positive divisor"):
        rows.select(scores.skill(F.col("low"), F.col("y"), strict=True)).collect()
