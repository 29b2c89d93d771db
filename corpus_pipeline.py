"""Corpus preparation in five stages; each result is written and read again by the next.

Toxicity, quality classifier, line dedup, SimHash near-dedup, best-fit packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm import linededup, packing, quality, simhash, toxicity
from ramify.llm.common import shared_folder, table

#: Fixed value: the columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic, by a lexicon learned from labelled rows that aren't held out."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, column="__score")
    return scored.filter(F.col("__score") < toxicity.TOXIC_AT).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted bad, by a rule ensemble learned from labelled rows that aren't held out."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, column="__score")
    return scored.filter(F.col("__score") >= quality.GOOD_AT).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts; every document stays, with its length counted anew."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id.

    SimHash finds the candidates, and the similarity of whole shingle sets decides.
    Documents without an id come last in their group. Repeated rows leave one row;
    rows that share an id and not their text are told apart.
    """
    return simhash.one_of_each(docs, simhash.SIMILAR).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents left into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Learned scores and packing can't be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each result to the folder that the cluster shares."""
    base = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
