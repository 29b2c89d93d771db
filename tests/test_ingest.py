from datetime import date, timedelta

import pytest
from ramify.functions import calendar
from ramify.operators import checks
from ramify.sources import ingest

COUNTS = "day date, borough string, area string, n bigint"


def test_tidy_maps_names_and_drops_rows_without_a_place(spark):
    raw = spark.createDataFrame(
        [("2011-07-09T05:00:00", "Richmond / Staten Island ", "north", "4"), ("2011-07-09T11:30:00", "STATEN ISLAND", "NORTH", "9"), ("2011-07-09", None, "north", "7"), ("2011-07-10", "unknown", "west", "5"), ("2011-07-10", "harbour", None, "6"), ("2011-07-10", "harbour", " west", "13")],
        ingest.RAW,
    )
    got = {tuple(r) for r in ingest.tidy(raw).collect()}
    assert got == {(date(2011, 7, 9), "STATEN ISLAND", "NORTH", 13), (date(2011, 7, 10), "HARBOUR", "WEST", 13)}
    assert ingest.tidy(raw.limit(0)).count() == 0


def test_assignment_takes_the_largest_then_the_first_name(spark):
    a, b = date(2012, 2, 28), date(2012, 2, 29)
    counts = spark.createDataFrame([(a, "hill", "p", 3), (b, "hill", "p", 4), (a, "dale", "p", 6), (a, "moor", "q", 8), (b, "dale", "q", 8), (b, "fen", "r", 2)], COUNTS)
    areas = checks.assign_areas(counts)
    assert {tuple(r) for r in areas.collect()} == {("p", "hill"), ("q", "dale"), ("r", "fen")}
    assert {(r["day"], r["area"]): r["n"] for r in checks.recount(counts, areas).collect()} == {(a, "p"): 9, (b, "p"): 4, (a, "q"): 8, (b, "q"): 8, (b, "r"): 2}
    worst = [(r["area"], r["assigned"], r["moved"], r["total"]) for r in checks.disagreement(counts, areas).collect()]
    assert worst == [("q", "dale", 8, 31), ("p", "hill", 6, 31)]


def test_missing_day_and_coverage(spark):
    days = [date(2020, 3, 1), date(2020, 3, 3), date(2020, 3, 4)]
    counts = spark.createDataFrame([(d, "BRONX", "B1", 1) for d in days] + [(days[0], "BRONX", "B2", 2)], COUNTS)
    assert [r[0] for r in checks.missing_days(counts).collect()] == [date(2020, 3, 2)]
    assert {r["area"]: r["share"] for r in checks.coverage(counts).collect()} == {"B1": 0.75, "B2": 0.25}
    assert {(r["area"], r["day"].day) for r in checks.missing_days(counts, "area").collect()} == {("B1", 2), ("B2", 2), ("B2", 3), ("B2", 4)}


def test_outliers_fall_back_to_the_deviation(spark):
    day = lambda k: date(2020, 1, 1) + timedelta(k)
    spiky = spark.createDataFrame([(day(k), 100.0 if k == 50 else 10.0) for k in range(100)], "day date, value double")
    flat = spark.createDataFrame([(day(k), 10.0) for k in range(30)], "day date, value double")
    assert [r["day"] for r in checks.outliers(spiky).collect()] == [day(50)]
    assert checks.outliers(flat).count() == 0


def test_observed_holidays_and_juneteenth(spark):
    found = {(r["day"], r["holiday"]): r["observed"] for r in calendar.holidays(spark, 2019, 2021).collect()}
    assert found[date(2021, 7, 4), "independence"] == date(2021, 7, 5)
    assert found[date(2020, 7, 4), "independence"] == date(2020, 7, 3)
    assert found[date(2019, 7, 4), "independence"] == date(2019, 7, 4)
    assert [d for d, name in found if name == "juneteenth"] == [date(2021, 6, 19)]
    assert found[date(2020, 11, 26), "thanksgiving"] and found[date(2021, 5, 31), "memorial"]


def test_yearly_cache_replaces_only_its_years(spark, tmp_path):
    raw = spark.createDataFrame([("2019-05-01T00", "B", "A", "1"), ("2020-05-01T00", "B", "A", "2")], ingest.RAW)
    ingest.write_cache(raw, str(tmp_path / "c"))
    got = ingest.read_cache(spark, str(tmp_path / "c"), date(2020, 1, 1), date(2021, 1, 1))
    assert [r["n"] for r in got.collect()] == ["2"]
    with pytest.raises(ValueError):
        ingest.read_cache(spark, str(tmp_path / "c"), date(2021, 1, 1), date(2020, 1, 1))


def test_a_year_cut_short_is_always_fetched(spark, tmp_path):
    asked = []

    def fetch(lo, hi):
        asked.append((lo, hi))
        return spark.createDataFrame([(f"{lo}T00", "B", "A", str(len(asked)))], ingest.RAW)

    folder = str(tmp_path / "c")
    window = (date(2018, 1, 1), date(2020, 6, 1))
    assert ingest.refresh_cache(spark, fetch, folder, *window) == [2018, 2019, 2020]
    assert ingest.refresh_cache(spark, fetch, folder, *window) == [2020] and asked[-1] == (date(2020, 1, 1), date(2020, 6, 1))
    assert ingest.refresh_cache(spark, fetch, folder, *window, everything=True) == [2018, 2019, 2020]
    assert {r["n"] for r in ingest.read_cache(spark, folder, *window).collect()} == {"5", "6", "7"}
    with pytest.raises(ValueError):
        ingest.refresh_cache(spark, fetch, folder, window[1], window[0])


def test_regimes_and_days_that_arent_days(spark):
    days = spark.createDataFrame([(date(2012, 10, 28),), (date(2012, 10, 29),), (date(2020, 3, 1),)], "day date")
    assert [r["regime"] for r in calendar.regimes(days).orderBy("day").collect()] == [None, "sandy", "covid"]
    with pytest.raises(TypeError):
        calendar.regimes(days.selectExpr("cast(day as timestamp) as day"))
