"""SimHash candidates at wide widths, and the pipeline's near-dedup against brute force over shingle sets."""

import random

import corpus_pipeline
import numpy as np
from ramify.llm import simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def pair(draw, low, high, n=200):
    """Two texts of n words whose similarity lies in the range."""
    one = [f"w{draw.randrange(10**6)}" for _ in range(n)]
    for _ in range(1000):
        two = list(one)
        for _ in range(draw.randint(1, 14)):
            two[draw.randrange(n)] = f"w{draw.randrange(10**6)}"
        if low <= jaccard(" ".join(one), " ".join(two)) < high:
            return " ".join(one), " ".join(two)
    raise AssertionError


def test_recall_at_the_widths_of_any_size(spark):
    draw, rows = random.Random(5), []
    for k in range(300):
        rows += [(2 * k + i, t) for i, t in enumerate(pair(draw, 0.8, 0.85))]
    prints = simhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), simhash.SIMILAR)
    classes = prints.withColumnRenamed("id", "rep").cache()
    for n_classes in (600, 10**7, 10**9):
        found = {tuple(sorted(r)) for r in simhash.linked(classes, simhash.SIMILAR, n_classes).collect()}
        assert sum((2 * k, 2 * k + 1) in found for k in range(300)) >= 0.96 * 300, n_classes


def test_near_stage_links_what_shingle_sets_link(spark):
    draw, rows = random.Random(6), []
    for low, high, n in ((0.8, 0.9, 40), (0.7, 0.8, 60)):
        for _ in range(n):
            rows += pair(draw, low, high)
    filler = "and " * 400
    rows += [filler + " ".join(f"w{draw.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    base = pair(draw, 0.8, 0.9)[0].split()
    rows += [" ".join(base[:-1] + [f"z{k}"]) for k in range(400)]  # a group of more than one chunk
    order = list(range(len(rows)))
    draw.shuffle(order)
    docs = spark.createDataFrame([(i, rows[k], "en", "s", 0) for i, k in enumerate(order)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    texts = [rows[k] for k in order]
    holders, root = {}, list(range(len(texts)))
    for i, t in enumerate(texts):
        for s in shingles(t):
            holders.setdefault(s, []).append(i)
    links = {(min(x), i) for i, t in enumerate(texts) for s in shingles(t) for x in [holders[s]] if min(x) < i and jaccard(texts[min(x)], t) >= 0.8}
    links |= {(j, i) for i, t in enumerate(texts) for j in {j for s in list(shingles(t)) for j in holders[s][:3]} if j < i and jaccard(texts[j], t) >= 0.8}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(links):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if top(i) == i}
    assert want <= kept  # no document is lost that is no near duplicate
    assert len(kept - want) <= 1


def test_similar_links_by_brute_force():
    draw = np.random.default_rng(7)
    sets = []
    for _ in range(30):
        base = draw.integers(0, 1 << 60, draw.integers(1, 60)).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[draw.random(len(base)) < 0.92], draw.integers(0, 1 << 60, draw.integers(0, 4)).astype(np.uint64)])) for _ in range(6)]
    side = [int(x) for x in draw.integers(0, 2, len(sets))]
    for sides in ([2] * len(sets), side):
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (sides[i] == 2 or sides[i] != sides[j]) and len(sets[i]) and len(u := np.union1d(sets[i], sets[j])) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(u)]
        got = simhash.similar_links(sets, sides, 0.8)
        assert set(got) <= set(pairs) and len(got) < len(sets)
        want, own = (simhash.forest(len(sets), np.array([p[0] for p in x]), np.array([p[1] for p in x])) for x in (pairs, got))
        assert (want == own).all()
