"""The paged source against the rows that were written, and what it leaves unread."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from ramify.sources import paged

ROWS = [(date(1994, 11, 1) + timedelta(days=d), b, a, float(d)) for d in range(500) for b, a in (("X", "one"), ("X", None), ("Y", "ü"))]


@pytest.fixture()
def folder(spark, tmp_path):
    paged.write_pages(spark.createDataFrame(ROWS, paged.SCHEMA), str(tmp_path / "p"), 100)
    return tmp_path / "p"


def key(r):
    return r[0], r[1], r[2] or "", r[3]


def test_all_rows_come_back(spark, folder):
    assert sorted(map(tuple, paged.read_pages(spark, str(folder), 100).collect()), key=key) == sorted(ROWS, key=key)


def test_only_years_of_the_range_are_opened(spark, folder):
    for f in Path(folder, "year=1994").rglob("*.json"):
        f.write_text("not a row")
    wanted = sorted((r for r in ROWS if date(1995, 3, 1) <= r[0] < date(1995, 7, 1)), key=key)
    by_option = paged.read_pages(spark, str(folder), 100, start="1995-03-01", end="1995-07-01")
    assert sorted(map(tuple, by_option.collect()), key=key) == wanted
    by_filter = paged.read_pages(spark, str(folder), 100).filter("day >= date'1995-03-01' and day < date'1995-07-01'")
    assert sorted(map(tuple, by_filter.collect()), key=key) == wanted
    assert by_filter.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="not a row|Expecting value|JSON"):
        paged.read_pages(spark, str(folder), 100).collect()


def test_reading_stops_on_a_short_page(folder):
    reader = paged.PageReader(str(folder), date(1994, 1, 1), date(1995, 1, 1), 100)
    seen = []
    reader.page, whole = lambda y, k: seen.append(k) or whole(y, k), reader.page
    assert len(list(reader.read(reader.partitions()[0]))) == 3 * 61
    assert seen == [0, 1]  # 183 rows: a full page and a short one
    reader.limit = 61
    reader.page = lambda y, k: seen.append(k) or [{"day": "1994-12-01"}] * (61 if k < 2 else 0)
    assert len(list(reader.read(reader.partitions()[0]))) == 122
    assert seen == [0, 1, 0, 1, 2]  # no page is short, so the end is an empty one


def test_refusals_and_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="not there"):
        paged.read_pages(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="isn't a path"):
        paged.read_pages(spark, "s3a://bucket/pages")
    with pytest.raises(ValueError, match="one row"):
        paged.write_pages(spark.createDataFrame([], paged.SCHEMA), str(tmp_path / "z"), 0)
    paged.write_pages(spark.createDataFrame([], paged.SCHEMA), str(tmp_path / "e"))
    assert paged.read_pages(spark, str(tmp_path / "e")).count() == 0
