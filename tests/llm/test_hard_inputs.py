"""Inputs that the given tables don't hold: unequal norms, full buckets, stories in marked elements, other partitionings, clashing columns."""

import resource

import numpy as np
import pyarrow as pa
import pytest
from ramify.llm import ann, embed_dedup, html_extract, quality, toxicity

STORY = "".join(f"<p>{('The council met on Tuesday, and after a long debate the members agreed to fund the new bridge, which opens in May. ') * 4}</p>" for _ in range(2))
TEXT = html_extract.main_text(f"<article>{STORY}</article>")


@pytest.mark.parametrize(
    "page",
    [
        '<div class="post market-share">%s</div>', '<div class="legal news">%s</div>', '<section id="social-policy">%s</section>', "<form>%s</form>",
        '<form><nav><a href="x">Home</a> <a>News</a></nav><article>%s<div class="ad">Buy now, cheap shoes!</div></article><footer>All rights</footer></form>',
        '<div class="page-banner">%s<div class="sidebar">Most read: shoes, hats.</div></div>',
    ],
)
def test_names_of_elements_do_not_hide_the_story(page):
    whole = f'<html><body><div class="menu"><a>Home</a></div>{page % STORY}<div class="ad">Buy shoes. Now!</div></body></html>'
    assert html_extract.main_text(whole) == TEXT and len(TEXT) > 900


def recall(vectors, queries, k=20):
    found = ann.build_shard(np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.arange(len(vectors)), vectors, ann.DEFAULT)
    shard = ann.Shard(found, ann.DEFAULT)
    ids, reps, _, scores = shard.nearest(np.full(len(queries), -1), queries, k)
    products = queries @ vectors.T
    hit = 0
    # queries come in order, each with its best first
    per = np.split(reps, len(queries))
    for q, own in enumerate(per):
        hit += len(set(own.tolist()) & set(np.argsort(-products[q], kind="stable")[:k].tolist()))
    assert np.allclose(scores, np.einsum("ij,ij->i", vectors[reps], np.repeat(queries, k, axis=0)))
    return hit / (k * len(queries))


@pytest.mark.parametrize("kind", ["alike", "log_normal", "outliers_3", "outliers_4", "tiny"])
def test_recall_on_unequal_norms(kind):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 64)) / 8
    if kind == "log_normal":
        vectors *= np.exp(rng.normal(size=(3000, 1)))
    if kind.startswith("outliers"):
        vectors[[5, 500, 2500]] *= 10.0 ** int(kind[-1])
    if kind == "tiny":
        vectors *= 1e-30
    assert recall(vectors, vectors[::60] + 0.0) >= 0.9


def test_a_full_bucket_of_near_copies_fits_an_executor():
    rng = np.random.default_rng(1)
    vec = rng.normal(size=384) + rng.normal(0, 0.01, (2048, 384))
    side = np.array([2] * 2048)
    rows = pa.table(
        {"bucket": pa.array(np.zeros(2048, np.int64)), "part": pa.array(np.zeros(2048, np.int64)), "side": pa.array(side, pa.int32()), "visitor": pa.array([False] * 2048),
         "rep": pa.array(np.arange(2048)), "n": pa.array(np.ones(2048, np.int64)), "vec": pa.array(vec.tolist(), pa.list_(pa.float64()))}
    )
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    list(embed_dedup._compare(embed_dedup.DEFAULT, 0.95)(iter(rows.to_batches())))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1024 * 1024


def test_links_of_planted_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + 10 * i + k, (3 * base[i] + rng.normal(0, 0.2, 24)).tolist()) for i in range(10) for k in range(5)] + [(5000 + k, (base[3] * (k + 1)).tolist()) for k in range(40)]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    ids = [i for i, _ in rows]
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.99 * (near.sum() - len(ids)) and all(got[i]["n_links"] <= near[k].sum() - 1 for k, i in enumerate(ids))
    assert all(got[1000 + 10 * i + k]["component_id"] == i for i in range(10) for k in range(5))


@pytest.fixture(scope="module")
def corpus(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_fits_are_the_same_on_any_partitioning(spark, corpus):
    docs, labels = (x.cache() for x in corpus)
    mixed = docs.repartition(7, "source", "text").sortWithinPartitions("n_chars"), labels.repartition(3)
    # near copies that share a signature: another one must not be picked
    assert toxicity.fit(docs, labels) == toxicity.fit(*mixed)
    assert quality.fit(docs, labels) == quality.fit(*mixed)


def test_quality_keeps_every_column(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", "y", 2.0, "z"), (2, None, None, "y", 1.0, "z")], "doc_id int, text string, row string, words string, score double, `statistics` string")
    model = quality.QualityModel(0.5)
    out = quality.score(rows, model, column="score")
    assert sorted(out.columns) == sorted(rows.columns) and {r["words"] for r in out.collect()} == {"y"}
    assert quality.score(rows, model, column="new").count() == 2
