"""Ingest of raw grouped rows, the yearly file cache, and incremental loads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of raw grouped rows; never inferred.
RAW = "day string, borough string, area string, n string"
#: Names to replace, and names that carry no place.
RENAMES = {"RICHMOND / STATEN ISLAND": "STATEN ISLAND"}
UNUSABLE = ("UNKNOWN", "")


def grouped_counts(events: DataFrame, start: str, end: str, time: str = "ts", *keys: str) -> DataFrame:
    """Events of [start, end) counted by day and keys; the range reaches the scan as a filter."""
    window = events.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))
    return window.groupBy(F.to_date(time).alias("day"), *keys).agg(F.count("*").alias("n"))


def year_windows(spark: SparkSession, start: date, end: date) -> DataFrame:
    """``year, lo, hi``: the half-open range cut at new year."""
    years = spark.range(start.year, end.year + 1).select(F.col("id").cast("int").alias("year"))
    lo, hi = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    return years.select("year", F.greatest(lo, F.lit(start)).alias("lo"), F.least(hi, F.lit(end)).alias("hi")).filter("lo < hi")


def tidy(raw: DataFrame) -> DataFrame:
    """``day, borough, area, n`` from raw rows: dates cut from timestamps, names trimmed, upper-cased and mapped, sums by key.

    Rows without a usable borough or area leave.
    """
    name = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rows = raw.select(F.to_date(F.substring("day", 1, 10)).alias("day"), name("borough").alias("borough"), name("area").alias("area"), F.col("n").cast("bigint").alias("n"))
    rows = rows.replace(RENAMES, subset=["borough"]).filter(~F.col("borough").isin(*UNUSABLE) & (F.col("area") != ""))
    return rows.groupBy("day", "borough", "area").agg(F.sum("n").alias("n"))


def write_cache(raw: DataFrame, folder: str) -> None:
    """JSON files by year; only the years in ``raw`` are replaced."""
    dated = raw.withColumn("year", F.substring("day", 1, 4).cast("int"))
    dated.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").json(folder)


def read_cache(spark: SparkSession, folder: str, start: date, end: date, first: date = date(1990, 1, 1)) -> DataFrame:
    """Raw rows of [start, end) from the yearly files; other years' folders aren't opened."""
    if end <= start or start < first:
        raise ValueError(f"window {start} to {end} is empty or begins before {first}")
    rows = spark.read.schema(RAW + ", year int").json(folder)
    day = F.to_date(F.substring("day", 1, 10))
    return rows.filter(F.col("year").between(start.year, end.year) & (day >= F.lit(start)) & (day < F.lit(end))).drop("year")


def refresh_cache(spark: SparkSession, fetch: Callable[[date, date], DataFrame], folder: str, start: date, end: date, everything: bool = False) -> list[int]:
    """Fill the yearly cache for [start, end) from ``fetch``, one year at a time, and return the years fetched.

    A year that is stored and whole inside the window isn't fetched again. A year
    that the window cuts short is never final, so it is always fetched.
    """
    if end <= start:
        raise ValueError(f"window {start} to {end} is empty")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fetched = []
    for r in year_windows(spark, start, end).orderBy("year").collect():
        whole = r["lo"] == date(r["year"], 1, 1) and r["hi"] == date(r["year"] + 1, 1, 1)
        if everything or not whole or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/year={r['year']}")):
            write_cache(fetch(r["lo"], r["hi"]), folder)
            fetched.append(r["year"])
    return fetched
