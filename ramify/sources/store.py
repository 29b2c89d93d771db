"""Forecast store: parquet by model and origin block, with a fingerprint of the run's settings."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Schedule

#: Origins in one block; a block is written at once, so an interrupted run loses one block at most.
BLOCK = 10


def output_dir() -> str:
    """``RAMIFY_OUTPUT`` at call time; blank or unset means ``output``."""
    return os.environ.get("RAMIFY_OUTPUT", "").strip() or "output"


def run_name(model: str, schedule: Schedule) -> str:
    return f"{model}-step{schedule.step}-win{schedule.train_window or 0}"


def fingerprint(model: str, schedule: Schedule, levels, nodes: list[str]) -> dict:
    """Everything that forecasts depend on: schedule, refits, window, level values and nodes."""
    return {"model": model, "schedule": asdict(schedule), "levels": [float(q) for q in levels], "nodes": sorted(nodes)}


class ForecastStore:
    """Forecasts of one run by block; opening it with other settings is refused."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        kept = self._read("settings", "value string")
        rows = kept.collect()
        text = json.dumps(settings, sort_keys=True)
        if not rows:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").parquet(f"{self.folder}/settings")
        elif rows[0][0] != text:
            old = json.loads(rows[0][0])
            raise ValueError(f"stored run differs in {sorted(k for k in old.keys() | settings.keys() if old.get(k) != settings.get(k))}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def forecasts(self) -> DataFrame:
        return self._read("forecasts", "origin int, node string, step int, q array<double>, block int")

    def seconds(self) -> DataFrame:
        return self._read("seconds", "origins int, seconds double, block int")

    def done(self) -> DataFrame:
        """Origins with a forecast for every node."""
        full = self.forecasts().groupBy("origin").agg(F.countDistinct("node").alias("n"))
        return full.filter(F.col("n") == len(self.settings["nodes"])).select("origin")

    def remaining(self, origins: DataFrame) -> DataFrame:
        return origins.join(self.done(), "origin", "left_anti")

    def complete(self, origins: DataFrame) -> bool:
        return self.remaining(origins).limit(1).count() == 0

    def run(self, origins: DataFrame, forecast: Callable[[DataFrame], DataFrame], progress: Callable[[int, int], None] | None = None) -> None:
        """Forecast the blocks of origins that aren't complete, one at a time; a block is forecast whole and replaces what is stored of it."""
        import time

        todo = sorted({r["origin"] // BLOCK for r in self.remaining(origins).select("origin").collect()})
        for done, block in enumerate(todo, 1):
            began = time.time()
            mine = origins.filter(F.floor(F.col("origin") / BLOCK) == block)
            rows = forecast(mine).select("origin", "node", "step", "q", F.lit(block).alias("block"))
            self._replace(rows, "forecasts")
            spent = self.spark.createDataFrame([(mine.count(), time.time() - began, block)], "origins int, seconds double, block int")
            self._replace(spent.coalesce(1), "seconds")
            if progress:
                progress(done, len(todo))

    def _replace(self, rows: DataFrame, name: str) -> None:
        """Overwrite the blocks that ``rows`` hold and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{self.folder}/{name}")

    def scored(self, origins: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Scores of a complete run; a partial one is refused."""
        if not self.complete(origins):
            raise ValueError("the run is not complete")
        return score(self.forecasts().drop("block").withColumn("model", F.lit(self.settings["model"])))
