"""Daily demand from the star schema: ordered quantity by ship date and customer nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shipped(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the customer's nation; only the joined columns are read."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("day"))
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Nation and region names. Both tables are fixed dimensions of a few dozen rows."""
    nations = read(spark, folder, "nation").join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select("n_nationkey", F.col("n_name").alias("area"), F.col("r_name").alias("borough"))


def leaf_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``day, borough, area, n``: one row per area and day. Quantities are summed by nation key before names are joined."""
    daily = _shipped(spark, folder).groupBy("day", "c_nationkey").agg(F.sum("l_quantity").alias("n"))
    return daily.join(places(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")).select("day", "borough", "area", "n")


def raw_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``day, borough, area, n`` in which an area (customer nation) meets several boroughs (supplier regions)."""
    suppliers = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    daily = (
        _shipped(spark, folder).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("day", "c_nationkey", "s_nationkey").agg(F.sum("l_quantity").alias("n"))
    )
    names = places(spark, folder)
    areas, boroughs = names.select("n_nationkey", "area"), names.select(F.col("n_nationkey").alias("supplier_key"), "borough")
    return (
        daily.join(areas, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(boroughs, F.col("s_nationkey") == F.col("supplier_key"))
        .groupBy("day", "borough", "area").agg(F.sum("n").alias("n"))
    )
