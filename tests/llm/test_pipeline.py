"""The pipeline against the operators' own rules on a small folder of tables."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from ramify.llm import linededup, quality, toxicity


def test_stages_on_the_small_tables(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes, kept = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes[name] = docs.count()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes["line_dedup"] == sizes["quality"] <= sizes["toxicity"] and sizes["near_dedup"] <= sizes["line_dedup"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{data}/documents.parquet"), labels)
    assert all(toxicity.scorer(model).score(r["text"]) < toxicity.TOXIC_AT for r in kept["toxicity"].collect())
    lines = [linededup.fold(x) for r in kept["line_dedup"].collect() for x in (r["text"] or "").split("\n")]
    long = [x for x in lines if len(x) >= linededup.MIN_CHARS]
    assert len(long) == len(set(long))
    shingles = {}
    for r in kept["near_dedup"].collect():
        w = (r["text"] or "").lower().split()
        shingles[r["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    assert sum(not s for s in shingles.values()) <= 1
    near = [1 for a, x in shingles.items() for b, y in shingles.items() if a < b and x and len(x & y) >= 0.9 * len(x | y)]
    assert len(near) <= 1
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert quality.GOOD_AT == 0.3 and np.isfinite(sizes["packing"])
