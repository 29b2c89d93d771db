"""Paged source: rows of a year come in numbered pages of at most ``limit`` rows, and a short page is the last.

The pages are line-JSON files ``folder/year=Y/page=K``, in a folder that the driver
and all executors can open. Years are the source's partitions.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from datetime import date
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

#: Fixed value: rows of a full page.
PAGE = 50_000
SCHEMA = "day date, borough string, area string, n double"


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names for checkpoints; a local one where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pages-")
    return f"{base.rstrip('/')}/pages-{uuid.uuid4().hex}"


def local_path(folder: str) -> str:
    """The folder as a path; one in a store that files can't be opened in is refused."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"pages are read as files, and {folder} isn't a path")
    return parts.path


def write_pages(rows: DataFrame, folder: str, limit: int = PAGE) -> None:
    """Rows (``day, borough, area, n``) as pages by year, in the order of day, borough and area.

    A row without a day has no year and is refused; no rows give no pages.
    """
    if limit < 1:
        raise ValueError("a page holds one row or more")
    day = F.coalesce("day", F.raise_error(F.lit("a row has no day")).cast("date"))
    place = F.row_number().over(Window.partitionBy("year").orderBy("day", "borough", "area")) - 1
    paged = rows.select(day.alias("day"), "borough", "area", F.col("n").cast("double").alias("n")).withColumn("year", F.year("day"))
    paged.withColumn("page", F.floor(place / F.lit(limit))).repartition("year", "page").write.mode("overwrite").partitionBy("year", "page").json(folder)


class Year(InputPartition):
    """A year's part of the range [lo, hi)."""

    def __init__(self, year: int, lo: date, hi: date):
        super().__init__(year)
        self.year, self.lo, self.hi = year, lo, hi


class PageReader(DataSourceReader):
    """One partition a year of [start, end); filters on ``day`` narrow the range, and Spark still applies them."""

    def __init__(self, folder: str, start: date, end: date, limit: int):
        self.folder, self.start, self.end, self.limit = folder, start, end, limit

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name that Spark calls
        for f in filters:
            if getattr(f, "attribute", None) == ("day",) and isinstance(getattr(f, "value", None), date):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.start = max(self.start, f.value)
                if isinstance(f, LessThan):
                    self.end = min(self.end, f.value)
                if isinstance(f, EqualTo | LessThanOrEqual) and f.value < date.max:
                    self.end = min(self.end, date.fromordinal(f.value.toordinal() + 1))
            yield f

    def partitions(self) -> list[Year]:
        there = sorted(int(p.name.partition("=")[2]) for p in Path(self.folder).glob("year=*"))
        return [Year(y, lo, hi) for y in there if (lo := max(self.start, date(y, 1, 1))) < (hi := min(self.end, date(y + 1, 1, 1)))]

    def page(self, year: int, k: int) -> list[dict]:
        """The rows of a page; one that isn't there is empty."""
        files = sorted(Path(self.folder, f"year={year}", f"page={k}").glob("*.json"))
        return [json.loads(line) for f in files for line in f.read_text(encoding="utf-8").splitlines()]

    def read(self, partition: Year | None) -> Iterator[tuple]:
        k = 0
        while partition is not None:
            rows = self.page(partition.year, k)
            for r in rows:
                if partition.lo <= (day := date.fromisoformat(r["day"])) < partition.hi:
                    yield day, r.get("borough"), r.get("area"), r.get("n")
            if len(rows) < self.limit:
                return
            k += 1


class PagedCounts(DataSource):
    """``spark.read.format("paged_counts")`` with the options ``folder``, ``limit``, ``start`` (first day) and ``end`` (day after the last)."""

    @classmethod
    def name(cls) -> str:
        return "paged_counts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        o = self.options
        start, end = (date.fromisoformat(o.get(k, d)) for k, d in (("start", "0001-01-01"), ("end", "9999-12-31")))
        if end <= start:
            raise ValueError(f"window {start} to {end} is empty")
        return PageReader(local_path(o["folder"]), start, end, int(o.get("limit", PAGE)))


def read_pages(spark: SparkSession, folder: str, limit: int = PAGE, **window: str) -> DataFrame:
    """Rows of the pages, of the window ``start`` to ``end`` if given; filters on ``day`` keep other years' pages shut."""
    if not os.path.isdir(local_path(folder)):
        raise ValueError(f"{folder} is not there")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCounts)
    return spark.read.format("paged_counts").options(folder=folder, limit=limit, **window).load()
