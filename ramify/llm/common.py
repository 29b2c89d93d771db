"""Helpers shared by the corpus operators: checkpoints, tables, batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that Spark puts into one Arrow batch for a Python worker: each task holds it several times over, in Java and Python.
BATCH_BYTES = 4 << 20
#: Most rows in one Arrow batch: very long texts must not meet by the thousand.
BATCH_ROWS = 2000
#: Bits of the tables of wanted keys: at most 2**18 rows of 64 bits are broadcast, whatever the input.
BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes; a session setting, read when a query runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``, which all executors see.

    Only where no folder is set and driver and executors are one process, as in
    tests, a temporary one is used; a cluster without one is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, as a Parquet table: smaller than a checkpoint, and later reads take the columns they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "node") -> DataFrame:
    """The rows, written as a table, with a number for each that stays the same from then on."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def maybe_wanted(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` may be one of ``wanted``: all that are, and few others while the bit table is sparse.

    Spares the shuffle of rows that have no partner in the join after it, which
    stays exact. The table's size is fixed; a full one lets every row through.
    """
    word, bit, table = _bit_table(wanted, on)
    met = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(table), "__word")
    return met.filter(F.bit_get("__bits", "__bit") == 1).select(*rows.columns)


def maybe_wanted_mark(rows: DataFrame, wanted: DataFrame, on: str, mark: str) -> DataFrame:
    """All rows with ``mark``: false where ``on`` is none of ``wanted`` for certain."""
    word, bit, table = _bit_table(wanted, on)
    met = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(table), "__word", "left")
    return met.withColumn(mark, F.coalesce(F.bit_get("__bits", "__bit") == 1, F.lit(False))).select(*rows.columns, mark)


def _bit_table(wanted: DataFrame, on: str) -> tuple[Column, Column, DataFrame]:
    spot = F.pmod(F.xxhash64(on), F.lit(BITS))
    word, bit = F.floor(spot / 64).cast("bigint"), (spot % 64).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return word, bit, wanted.groupBy(word.alias("__word")).agg(bits.alias("__bits"))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; every executor has the same files installed."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
