import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from ramify.config import Schedule
from ramify.operators import decision, inference
from ramify.plans import backtest as bt
from ramify.plans import report
from ramify.sources.store import ForecastStore, fingerprint

PLAN = Schedule(min_train=30, train_window=30, horizon=7)


def test_store_resumes_and_refuses_other_settings(spark, tmp_path):
    origins = spark.range(25).select(F.col("id").cast("int").alias("origin"))
    forecast = lambda o: o.select("origin", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("node"), F.lit(1).alias("step"), F.array(F.lit(1.0)).alias("q"))
    settings = fingerprint("naive", PLAN, (0.5,), ["a", "b"])
    store = ForecastStore(spark, str(tmp_path / "s"), settings)
    store.run(origins.filter("origin < 10"), forecast)
    assert not store.complete(origins)
    with pytest.raises(ValueError):
        store.scored(origins, lambda d: d)
    again = ForecastStore(spark, str(tmp_path / "s"), settings)
    assert again.remaining(origins).count() == 15
    again.run(origins, forecast)
    assert again.complete(origins) and again.scored(origins, lambda d: d).count() == 50
    again.run(origins, forecast)  # nothing is left to do
    assert again.forecasts().count() == 50
    part = ForecastStore(spark, str(tmp_path / "t"), settings)
    part.run(origins.filter("origin < 15"), forecast)
    part.run(origins, forecast)  # the second block was stored in part and is replaced
    assert part.complete(origins) and part.forecasts().count() == 50 and part.seconds().agg(F.sum("origins")).first()[0] == 25
    with pytest.raises(ValueError, match="levels"):
        ForecastStore(spark, str(tmp_path / "s"), fingerprint("naive", PLAN, (0.4,), ["a", "b"]))


def test_numbers_tables_and_markers():
    assert [report.number(x) for x in (123.4, 12.34, 1.234, 0.1234, -0.0001)] == ["123", "12.3", "1.23", "0.123", "0.000"]
    assert report.estimate(report.Estimate(1.0, 0.5, 2.0)) == "1.00 [0.500, 2.00]"
    with pytest.raises(ValueError):
        report.Estimate(3.0, 0.0, 1.0)
    with pytest.raises(ValueError):
        report.markdown(["a"], [["b|c"]])
    assert report.splice("x<!-- report:begin -->old<!-- report:end -->y", "new").count("new") == 1
    with pytest.raises(ValueError):
        report.splice("x", "new")


def test_payload_schema_finds_a_lost_field():
    good = {"schema_version": 2, "origins": {"count": 1, "step": 7, "horizon": 14}, "hierarchy": [], "models": [], "staffing": [], "coverage": [], "reconciliation": [], "own_windows": []}
    good["fan"] = {"levels": [0.5], "nodes": ["a"], "days": [], "actual": [[]], "bands": [[[]]]}
    report.validate(good, report.PAYLOAD_SCHEMA)
    for name in good:
        with pytest.raises(ValueError):
            report.validate({k: v for k, v in good.items() if k != name}, report.PAYLOAD_SCHEMA)
    assert json.dumps(report.clean({"a": float("nan"), "b": 1.23456}), allow_nan=False) == '{"a": null, "b": 1.2346}'


def test_fan_is_laid_out_by_node_level_and_day(spark):
    rows = [("a", "2020-01-02", 1, [float(k) for k in range(11)], 5.0), ("a", "2020-01-01", 0, [float(k + 1) for k in range(11)], 4.0)]
    frame = spark.createDataFrame(rows, "node string, d string, target_idx int, q array<double>, y double")
    days = frame.select(F.col("d").cast("date").alias("day"), "target_idx")
    got = report.fan_section(report.fan(frame, days, report.REPORTING))
    assert got["days"] == ["2020-01-01", "2020-01-02"] and got["actual"] == [[4.0, 5.0]]
    assert got["bands"] == [[[3.0, 2.0], [5.0, 4.0], [6.0, 5.0], [7.0, 6.0], [9.0, 8.0]]]


def test_best_model_and_chart_ranges(spark):
    table = spark.createDataFrame([("b", 0.25), ("b", 0.5), ("a", 0.125), ("a", 0.625), ("c", 0.0)], "model string, skill double")
    assert report.best_model(table) == "a"
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2021-01-01')) as day")
    assert report.range_window(days).count() == 732
    assert report.range_window(days, "year").count() == 366 and report.range_window(days, "shift").count() == 367
    with pytest.raises(ValueError):
        report.range_window(days, "week")


def test_cost_of_stored_timings_joins_the_skill_table(spark, tmp_path):
    origins = spark.range(25).select(F.col("id").cast("int").alias("origin"))
    forecast = lambda o: o.select("origin", F.lit("a").alias("node"), F.lit(1).alias("step"), F.array(F.lit(1.0)).alias("q"))
    store = ForecastStore(spark, str(tmp_path / "s"), fingerprint("naive", PLAN, (0.5,), ["a"]))
    store.run(origins, forecast)
    kept = store.seconds().withColumn("model", F.lit("naive"))
    each = sorted(r["seconds"] / r["origins"] for r in kept.collect())
    assert len(each) == 3  # blocks of 10, 10 and 5 origins
    table = spark.createDataFrame([("naive", "city", 0.1), ("other", "city", 0.2)], "model string, level string, skill double")
    found = {r["model"]: r["cost"] for r in report.with_cost(table, kept, 199).collect()}
    assert found["naive"] == pytest.approx(each[1] * 199)
    assert found["other"] is None


def test_durations_are_minutes_under_an_hour():
    assert [report.duration(x) for x in (0, 20, 240, 3599, 3600, 65_880)] == ["1 min", "1 min", "4 min", "60 min", "1.0 h", "18.3 h"]
    for x in (-1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError, match="length of time"):
            report.duration(x)


def _series(n, shift=0.0):
    return [(float(10 + k % 7 + shift), float(12 + k % 5)) for k in range(n)]


def test_intervals_of_all_statistics_equal_plain_resampling(spark):
    n, rows = 120, _series(120)
    series = spark.createDataFrame([("m", k, *row) for k, row in enumerate(rows)], "model string, pos int, score double, base double")
    blocks = inference.block_table(spark, n, resamples=200)
    statistics = {"mean": lambda mean: mean("score"), "skill": inference.skill_of(), "change": lambda mean: mean("score") - mean("base")}
    got = inference.with_intervals(series, blocks, ["model"], ["score", "base"], statistics, origins=F.count("*")).first()
    score, base = np.array(rows).T
    starts = inference.block_starts(n, resamples=200)
    drawn = np.array([np.concatenate([np.arange(x, x + 28) for x in own])[:n] for own in starts])
    means = score[drawn].mean(axis=1), base[drawn].mean(axis=1)
    for name, of in (("mean", lambda a, b: a), ("skill", lambda a, b: 1 - a / b), ("change", lambda a, b: a - b)):
        assert got[name] == pytest.approx(of(score.mean(), base.mean()))
        assert (got[f"{name}_low"], got[f"{name}_high"]) == pytest.approx(tuple(np.quantile(of(*means), [0.025, 0.975])))
    assert got["origins"] == n
    with pytest.raises(ValueError, match="score"):
        inference.with_intervals(series, blocks, ["model"], ["score", "base"], {"score": lambda mean: mean("score")})


@pytest.mark.parametrize("n", [inference.LEAST_ORIGINS - 1, inference.LEAST_ORIGINS])
def test_too_few_origins_get_values_and_no_interval(spark, n):
    series = spark.createDataFrame([("m", k, *row) for k, row in enumerate(_series(n))], "model string, pos int, score double, base double")
    got = inference.with_skill_interval(series, inference.block_table(spark, n, resamples=20), ["model"], crps=F.avg("score")).first()
    assert got["crps"] > 0
    assert (got["low"] is None) == (got["high"] is None) == (n < inference.LEAST_ORIGINS)


def _scores(spark, model, n, shift):
    rows = [(model, k, "a", "city", 1, s + shift, [s / 3] * len(report.REPORTING), [True, k % 9 > 0, True], [1.0, 2.0 + k % 3, 4.0]) for k, (s, _) in enumerate(_series(n))]
    return spark.createDataFrame(rows, "model string, origin int, node string, level string, step int, crps double, pinball array<double>, hits array<boolean>, widths array<double>")


def test_comparison_rows_and_section(spark):
    n, schedule = 120, Schedule()
    own, base = _scores(spark, "own", n, 0.0), _scores(spark, "copy", n, 2.0)
    days = spark.range(n).select(F.col("id").cast("int").alias("origin"), F.date_add(F.lit("2020-01-06").cast("date"), (7 * F.col("id")).cast("int")).alias("day"))
    table = report.skill_rows(own.unionByName(base), base, inference.block_table(spark, n, resamples=300), schedule, days, "copy")
    rows = {r["model"]: r for r in table.collect()}
    assert rows["copy"]["skill"] is None and rows["copy"]["skill_low"] is None and rows["copy"]["crps"] == pytest.approx(rows["own"]["crps"] + 2)
    assert rows["own"]["skill_low"] <= rows["own"]["skill"] <= rows["own"]["skill_high"] and rows["own"]["median_skill"] == pytest.approx(0.0)
    rolled = [np.mean([j % 9 > 0 for j in range(k - 12, k + 1)]) for k in range(12, n)]
    first = 12 + int(np.argmin(np.round(rolled, 9)))
    assert rows["own"]["worst"] == pytest.approx(min(rolled))
    assert rows["own"]["worst_day"] == days.filter(F.col("origin") == first).first()["day"]
    seconds = spark.createDataFrame([("own", 10, 5.0), ("own", 10, 15.0), ("own", 10, 7.0)], "model string, origins int, seconds double")
    section = report.comparison_section(table, "copy", 0.9, {"own": "statistical"}, seconds, 200)
    assert [(m["name"], m["kind"], m["fit_seconds"]) for m in section["rows"]] == [("copy", "baseline", None), ("own", "statistical", 140.0)]
    assert section["rows"][0]["levels"][0]["skill"] is None and set(section["rows"][1]["levels"][0]["crps"]) == {"point", "low", "high"}
    with pytest.raises(ValueError, match="baseline"):
        report.comparison_section(table, "naive", 0.9, {})
    report.validate(report.clean({"comparison": section}), {"type": "object", "properties": {"comparison": report.PAYLOAD_SCHEMA["properties"]["comparison"]}})


def test_staffing_rows_compare_with_the_reference(spark):
    n = 112
    rows = [(m, level, k, u + k % 3, 4.0, c + k % 2) for m, u, c in (("copy", 6.0, 5.0), ("own", 5.0, 3.0)) for level in (0.8, 0.9) for k in range(n)]
    staffed = spark.createDataFrame(rows, "model string, service_level double, origin int, units double, oracle_units double, cost double")
    table = report.staffing_rows(staffed, "copy", inference.block_table(spark, n, resamples=50))
    inputs = decision.DecisionInputs()
    section = report.methods_section(table, "copy", inputs)
    own = next(m for m in section["methods"] if m["name"] == "own")
    assert section["service_levels"] == [0.8, 0.9] and section["oracle_units"] == 4.0
    assert own["cost_change"] == [{"point": -2.0, "low": -2.0, "high": -2.0}] * 2 and own["hours_saved"] == pytest.approx([2 * 365 * 24] * 2)
    assert next(m for m in section["methods"] if m["name"] == "copy")["cost_change"] == [None, None]
    with pytest.raises(ValueError, match="reference"):
        report.methods_section(table, "naive", inputs)
    with pytest.raises(ValueError, match="lacks"):
        report.methods_section(table.filter("model = 'copy' or service_level < 0.9"), "copy", inputs)


def test_reconciled_and_regime_sections(spark):
    n = 112
    base = _scores(spark, "own", n, 1.0)
    table = report.reconciliation_rows(base, {"medians": _scores(spark, "own", n, 0.5), "paths": base}, inference.block_table(spark, n, resamples=50))
    (level,) = report.reconciled_section(table)
    change = {v["name"]: v["crps_change"] for v in level["variants"]}
    assert change == {"medians": {"point": -0.5, "low": -0.5, "high": -0.5}, "paths": {"point": 0.0, "low": 0.0, "high": 0.0}}
    days = spark.sql("select explode(sequence(date'2012-10-22', date'2012-11-05', interval 7 days)) as day")
    assert [(r["name"], r["first"], r["origins"]) for r in report.regimes_section(days, (("storm", date(2012, 10, 29)),))] == [(None, "2012-10-22", 1), ("storm", "2012-10-29", 2)]


def test_timings_of_sampled_origins(spark, data):
    assert bt.sampled_origins(199) == [19, 99, 197] and bt.sampled_origins(2) == [0, 1]
    with pytest.raises(ValueError):
        bt.sampled_origins(1)
    s = bt.setup(spark, data)
    found = bt.timings(s, {"copy": lambda o: bt.naive.points(s.panel, o, s.schedule)})
    rows = found.collect()
    nodes = s.nodes.count()
    assert [r["origin"] for r in rows] == bt.sampled_origins(s.schedule.count(s.n_days))
    assert all(r["rows"] == nodes * s.schedule.horizon and r["seconds"] > 0 for r in rows)
    assert report.compute_cost(found, 199).first()["cost"] == pytest.approx(199 * sorted(r["seconds"] for r in rows)[1])


def test_json_is_written_through_spark(spark, tmp_path):
    report.write_json(spark, str(tmp_path / "payload"), {"a": [1, None]})
    assert spark.read.text(str(tmp_path / "payload")).first()[0] == '{"a":[1,null]}'
    with pytest.raises(ValueError):
        report.write_json(spark, str(tmp_path / "bad"), {"a": float("nan")})


def test_cached_tables_take_partitions_by_size(spark, data):
    """stages that read the shared tables must not have as many tasks as the session has shuffle partitions."""
    before, by_size = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(bt.BY_SIZE)
    bt.release()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        s = bt.setup(spark, data)
        for table in (s.counts, s.panel, bt.cached(bt.copied(s))):
            assert table.storageLevel.useMemory
            assert 0 < table.count() and table.rdd.getNumPartitions() < 32
        assert spark.conf.get(bt.BY_SIZE) == by_size
    finally:
        spark.catalog.clearCache()
        bt.release()
        spark.conf.set("spark.sql.shuffle.partitions", before)
