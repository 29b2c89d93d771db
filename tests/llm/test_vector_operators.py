"""Brute-force tests of the vector operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from ramify.llm import ann, embed_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"
BAD = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None] * 8, 0), (9005, [], 0), (9006, [1.0, 2.0], 0)]


def rows_of(spark, seed=0, n=300):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 16))
    x[100:160] = x[5] + draw.normal(size=(60, 16)) * 0.15
    x[160:200] = x[7]
    x = x.astype(np.float32)
    good = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    return spark.createDataFrame(good + BAD, SCHEMA), x.astype(float)


def test_lattice_points_are_nearest_by_brute_force():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 8))
    roots = embed_dedup.e8_roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    near = embed_dedup.nearest_e8(x)
    best = ((x - near) ** 2).sum(axis=1)
    for r in roots:
        assert (best <= ((x - near - r) ** 2).sum(axis=1) + 1e-9).all()


def test_embedding_groups_by_brute_force(spark):
    frame, x = rows_of(spark)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while not (new := np.array([min([root[i], *root[near[i]]]) for i in range(len(x))])).tolist() == root.tolist():
        root = new
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, *_ in BAD) and len(got) == len(x) + len(BAD)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_nearest_by_brute_force(spark):
    frame, x = rows_of(spark)
    got = ann.nearest(frame, frame.filter("vec_id % 20 = 0")).toPandas()
    hits = []
    for q in range(0, len(x), 20):
        product = (x * x[q]).sum(axis=1)
        product[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -product))[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        np.testing.assert_allclose(own["score"], product[own["vec_id"]], rtol=1e-12)
        hits.append(len(set(want) & set(own["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9
    assert set(got["query_id"]) == set(range(0, len(x), 20))
    few = frame.filter("vec_id < 4")
    assert ann.nearest(few, few).groupBy("query_id").count().filter("count = 3").count() == 4
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


SHARDED = ann.HnswSettings(least_rows=40, most_rows=40, query_rows=7)


def test_shards_ties_and_repeated_rows_by_brute_force(spark):
    draw = np.random.default_rng(4)
    x = draw.integers(-2, 3, size=(260, 6)).astype(np.float32)  # small whole numbers: many equal vectors and tied scores
    x[~x.any(axis=1)] = 1
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [rows[20]] * 6 + [(40, [1.0] * 6, 0)] * 3  # a row repeated, and an id with two vectors
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("query_id", F.lit("clash")).withColumn("score", F.lit(-1)).withColumn("rep", F.lit(None).cast("int"))
    asked = frame.filter("vec_id % 20 = 0")
    got = ann.nearest(frame, asked, settings=SHARDED).toPandas()
    assert got.columns.tolist() == ["query_id", "rank", "vec_id", "score"]
    candidates = sorted({(i, tuple(v)) for i, v, _ in rows})
    hits = []
    for q in range(0, 260, 20):
        vector = min(v for i, v in candidates if i == q)
        want = sorted((-float(np.dot(v, vector)), i) for i, v in candidates if i != q)[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        scores = own["score"].tolist()
        assert scores == sorted(scores, reverse=True)
        assert all(a < b for a, b, s, t in zip(own["vec_id"], own["vec_id"][1:], scores, scores[1:], strict=False) if s == t)
        assert all(s in {float(np.dot(v, vector)) for i, v in candidates if i == k} for k, s in zip(own["vec_id"], scores, strict=True))
        hits.append(np.mean(np.array(scores) == [-s for s, _ in want]))
    assert np.mean(hits) >= 0.95


def test_recall_of_hard_vectors_over_shards():
    """Independent normal vectors, the hardest case: shards as large as they get, searched and merged."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(4000, 32))
    shards = [np.arange(k, 4000, 3) for k in range(3)]
    graphs = [ann.Hnsw(ann.lifted(x[s])) for s in shards]
    queries = x[::40]
    lifted = np.column_stack([queries, np.zeros(len(queries))])
    found = np.concatenate([s[g.search(lifted, 21)] for s, g in zip(shards, graphs, strict=True)], axis=1)
    product = queries @ x.T
    merged = np.take_along_axis(found, np.argsort(-np.take_along_axis(product, found, axis=1), axis=1)[:, :21], axis=1)
    want = np.argsort(-product, axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(merged.tolist(), want.tolist(), strict=True)]) >= 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 130])
def test_small_graphs_find_everything(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    graph = ann.Hnsw(ann.lifted(x) if n else np.zeros((0, 5)))
    found = graph.search(np.zeros((3, 5)) + 1, 70)
    assert found.shape == (3, 70)
    assert all(len({i for i in row if i >= 0}) == min(n, 70) for row in found.tolist())
