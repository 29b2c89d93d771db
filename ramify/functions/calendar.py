"""Holidays and calendar features as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: US federal holidays by rule: (name, month, day) and (name, month, weekday from Monday = 0, n; -1 the last).
DATED = (("new_year", 1, 1), ("independence", 7, 4), ("veterans", 11, 11), ("christmas", 12, 25))
RULED = (
    ("mlk", 1, 0, 3), ("washington", 2, 0, 3), ("memorial", 5, 0, -1), ("labor", 9, 0, 1), ("columbus", 10, 0, 2), ("thanksgiving", 11, 3, 4),
)
JUNETEENTH_FROM = 2021
#: First days of the regimes that change demand.
REGIMES = (("sandy", date(2012, 10, 29)), ("covid", date(2020, 3, 1)))


def regimes(days: DataFrame, marks=REGIMES) -> DataFrame:
    """``days`` (``day``) with ``regime``: the last regime that had begun, null before the first."""
    require_dates(days, "day")
    out = F.lit(None).cast("string")
    for name, first in sorted(marks, key=lambda x: x[1]):
        out = F.when(F.col("day") >= F.lit(first), F.lit(name)).otherwise(out)
    return days.withColumn("regime", out)


def require_dates(df: DataFrame, *columns: str) -> None:
    """Raise unless the columns are whole days: a timestamp or a string is never narrowed silently."""
    for name in columns:
        kind = df.schema[name].dataType.simpleString()
        if kind != "date":
            raise TypeError(f"{name} must be a date, not {kind}")


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th such weekday of a month, the last one for n = -1."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def observed(day: Column) -> Column:
    """Saturday holidays are observed on Friday, Sunday ones on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``day, holiday, observed`` of all years in the range."""
    y = F.col("year")
    named = [(n, F.make_date(y, F.lit(m), F.lit(d))) for n, m, d in DATED]
    named += [(n, nth_weekday(y, m, w, k)) for n, m, w, k in RULED]
    named += [("juneteenth", F.when(y >= JUNETEENTH_FROM, F.make_date(y, F.lit(6), F.lit(19))))]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    each = years.select(F.explode(F.array(*(F.struct(d.alias("day"), F.lit(n).alias("holiday")) for n, d in named))).alias("h"))
    return each.select("h.day", "h.holiday").filter("day is not null").withColumn("observed", observed(F.col("day")))


def features(days: DataFrame, extend_years: bool = False) -> DataFrame:
    """``day, dow, is_weekend, holiday, is_holiday, is_holiday_observed`` for distinct days.

    Holidays are made for the years of the window only; ``extend_years`` adds the
    next year, whose New Year may be observed on 31 December.
    """
    spark = days.sparkSession
    lo, hi = days.agg(F.min(F.year("day")), F.max(F.year("day"))).first()
    if lo is None:
        raise ValueError("no days")
    table = holidays(spark, lo, hi + extend_years)
    actual = table.select("day", "holiday")
    shifted = table.select(F.col("observed").alias("day")).distinct().withColumn("seen", F.lit(True))
    joined = days.select("day").join(F.broadcast(actual), "day", "left").join(F.broadcast(shifted), "day", "left")
    dow = F.weekday("day")
    return joined.select(
        "day", dow.alias("dow"), (dow >= 5).alias("is_weekend"), "holiday", F.col("holiday").isNotNull().alias("is_holiday"), F.col("seen").isNotNull().alias("is_holiday_observed")
    )
