"""What a Python worker holds at a time is bounded, whatever a task's share of the input."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from ramify.llm import bpe, common, toxicity
from ramify.llm.common import tokenizer_file


def test_a_batch_of_long_texts_is_a_few_megabytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = spark.range(12, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    got = texts.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in got) == 12 and max(r["size"] for r in got) <= 6 << 20


def test_many_texts_are_encoded_in_a_bounded_space():
    own, draw = bpe.BpeTokenizer(tokenizer_file()), random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(5000)]
    texts = [" ".join(draw.choices(words, k=2000)) for _ in range(350)]  # 4 million characters
    few = own.encode_many(texts[:5])
    tracemalloc.start()
    try:
        got = own.encode_many(texts)
        result = sum(map(len, got))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:5] == few and got[-1] == own.encode_packed(texts[-1])
    assert peak - result < 32 << 20


def test_terms_are_passed_on_before_they_are_many():
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgh", k=9))
    rows = [(" ".join(word() for _ in range(20)), draw.randint(0, 1)) for _ in range(400)] * 2
    batches = [pa.RecordBatch.from_pylist([{"text": x, "label": k} for x, k in rows[at : at + 100]]) for at in range(0, len(rows), 100)]
    total = {}
    for batch in toxicity.term_counts(iter(batches), held=500):
        assert batch.num_rows <= 500 + 20 * len(toxicity.STEM_LENGTHS)
        for r in batch.to_pylist():
            toxic, clean = total.get(r["term"], (0, 0))
            total[r["term"]] = toxic + r["toxic"], clean + r["clean"]
    whole = {}
    for batch in toxicity.term_counts(iter(batches), held=1 << 30):
        assert not whole
        whole = {r["term"]: (r["toxic"], r["clean"]) for r in batch.to_pylist()}
    assert total == whole and len(whole) > 5000
