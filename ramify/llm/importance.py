"""Operator 11: importance resampling towards a target distribution by hashed word runs.

Runs of one and two words are counted in buckets of their CRC-32, over all
documents and over the target's texts. A bucket's gain is the scaled logarithm of
how much more often the target has it; a document's weight is the mean gain of its
features. Gumbel noise from a hash of the id turns the highest scores into a sample
without replacement, the same whatever the partitioning.

Texts stay in Arrow buffers: words, counts and codes come from ``words``, and a
task sends one row a bucket. What the driver takes is bounded: the gains, one a
bucket, and the number of documents at each score, which is a whole number between
bounds that the logarithms of 64-bit counts set (about 110,000 values).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .words import crcs, words_of

#: Number of buckets, least words of a document in the draw, percent drawn, seed.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often all texts together hold features of each bucket that occurs."""
    small_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for codes in crcs(words_of(batch.column(0))):
                total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    partial = df.select(F.col(f"`{text}`").cast("string").alias("x")).mapInArrow(run, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: ``floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``."""
    spark = docs.sparkSession
    own, other = bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets)
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = (
        every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(other.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    )
    rows = both.collect()  # one row a bucket
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the id's SHA-256; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; a text without words has no features and weight 0."""
    small_batches(docs.sparkSession)
    gain = np.asarray(gain, np.int64)

    def run(batches):
        for batch in batches:
            words = words_of(batch.column(1))
            one, two = crcs(words)
            m = np.uint32(len(gain))
            worth = np.concatenate([[0], gain[one % m]])
            worth[1:][words.pairs()] += gain[two % m]
            total = np.diff(np.cumsum(worth)[words.first])
            counts = words.counts
            features = counts + np.maximum(counts - 1, 0)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("x"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where it isn't drawn.

    Of the N documents of ``least_words`` words or more, ``floor(percent * N / 100)``
    are drawn: the highest scores, ties to the smaller id; rows that share score
    and id follow each other. A null text counts as empty. A row without an id has
    features and a weight, but no score: it isn't drawn and doesn't count in N. No
    documents give no rows; an empty target gives every bucket a gain all the same.
    Other columns of ``docs`` don't matter.
    """
    spark = docs.sparkSession
    rows = weighted(docs, gains(docs, target, text, buckets=buckets), key, text)
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    found = scored.filter(able).groupBy("score").count().collect()  # bounded: scores are whole thousandths
    found.sort(key=lambda r: -r["score"])
    wanted, above, begins = percent * sum(r["count"] for r in found) // 100, 0, []
    for r in found:
        if above >= wanted:
            break
        begins.append((r["score"], above))
        above += r["count"]
    table = spark.createDataFrame(begins, "score bigint, above bigint")
    place = F.row_number().over(Window.partitionBy("score", "__able").orderBy("doc_id")) + F.col("above")
    ranked = (
        scored.withColumn("__able", F.coalesce(able, F.lit(False))).join(F.broadcast(table), "score", "left")
    )
    drawn = ranked.filter(F.col("__able") & F.col("above").isNotNull()).withColumn("rank", place.cast("bigint"))
    rest = ranked.filter(~(F.col("__able") & F.col("above").isNotNull())).withColumn("rank", F.lit(None).cast("bigint"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*out).unionByName(rest.select(*out))
