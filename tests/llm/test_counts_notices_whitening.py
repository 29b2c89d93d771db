"""Operators 11 to 13 against plain forms, and their edge rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ramify.llm import importance, licenses, whitening
from ramify.llm.words import crcs, gram_hashes, word_list, words_of

TEXTS = ["", None, "A b", "  The the THE, naïve-café 日本 x_y  ", "9", "é" * 200 + " " + "z" * 300 + " end", "a\x00b\x7fc", "İSTANBUL straße ÄÖ 1a2B", " w w", " " * 50]


def test_words_and_codes_equal_the_plain_form():
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("abZ é-日 \n0_") for _ in range(draw.randint(0, 400))) for _ in range(60)]
    for array in (pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts[:2])):
        words = words_of(array)
        plain = [word_list(t) for t in array.to_pylist()]
        assert words.counts.tolist() == [len(w) for w in plain]
        one, two = crcs(words)
        assert one.tolist() == [zlib.crc32(w.encode()) for ws in plain for w in ws]
        assert two.tolist() == [zlib.crc32(f"{a} {b}".encode()) for ws in plain for a, b in zip(ws, ws[1:], strict=False)]
        for k in (1, 2, 3):
            hashes, counts = gram_hashes(words, k)
            runs = [tuple(ws[i : i + k]) for ws in plain for i in range(len(ws) - k + 1)]
            assert counts.sum() == len(runs) == len(hashes)
            assert len(set(runs)) == len(set(hashes.tolist())) == len(set(zip(runs, hashes.tolist(), strict=True)))
    assert len(words_of(pa.array([], pa.string())).start) == 0


DOCS = "doc_id bigint, text string, score double, `k1` string, `the rank` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], DOCS)


def plain_resample(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def features(text):
        words = word_list(text)
        return words, [zlib.crc32(f.encode()) % buckets for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]

    own, other = Counter(), Counter()
    for _, t in rows:
        own.update(features(t)[1])
    for t in target:
        other.update(features(t)[1])
    total, wanted = sum(own.values()), sum(other.values())
    out, able = [], []
    for i, t in rows:
        words, held = features(t)
        gains = [math.floor(1000 * math.log((other[b] + 1) * (total + buckets) / ((own[b] + 1) * (wanted + buckets)))) for b in held]
        weight = sum(gains) // len(gains) if gains else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(held), weight, score, None])
        if len(words) >= least and score is not None:
            able.append(out[-1])
    for rank, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0]))[: percent * len(able) // 100], 1):
        row[4] = rank
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resampling_equals_the_plain_form(spark):
    draw = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "日本", "x1", "the"]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(120)]
    rows += [(500 + i, t) for i, t in enumerate(TEXTS)] + [(3, rows[3][1]), (3, rows[3][1]), (None, "no id " * 30), (None, None), (900, "long words " * 20_000)]
    target = ["alpha beta beta", None, "délta the the the", ""]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    for parts in (1, 5):
        got = importance.resample(docs_of(spark, rows).repartition(parts), goal)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
        assert in_order(got.collect()) == in_order(plain_resample(rows, target))
    few = importance.resample(docs_of(spark, rows), goal.limit(0), percent=100, least_words=0)
    assert in_order(few.collect()) == in_order(plain_resample(rows, [], percent=100, least=0))
    assert importance.resample(docs_of(spark, []), goal).count() == 0


def test_votes_bound_and_subsequence_by_brute_force():
    draw = random.Random(8)

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(300):
        a, b = draw.choices("abcd", k=draw.randint(1, 12)), draw.choices("abcd", k=draw.randint(0, 14))
        assert licenses.common_words(a, b) == plain(a, b)
    for n in range(3, 60):  # words taken out one by one, as far apart as can be, cost k runs each
        lost = int(0.25 * n + 1e-9)
        assert licenses.least_votes(n) == max(1, n - 2 - 3 * lost)


def notices_of(spark, rows, **more):
    return {r["doc_id"]: r for r in licenses.report(licenses.scan(docs_of(spark, rows), **more)).collect()}


def plain_base(text):
    words = word_list(text)
    found = [(i, p.label) for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.words)] == p.words]
    return len(words), found


def test_phrases_equal_the_plain_form(spark):
    draw = random.Random(2)
    parts = ["under", "the", "MIT", "License", "Apache", "version", "2", "CC", "BY", "NC", "cc-by-nc", "under the MIT license", "w"]
    rows = [(i, draw.choice([" ", "\n", ", "]).join(draw.choices(parts, k=draw.randint(0, 40)))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(2000, "under the mit license " * 3000)]
    got = notices_of(spark, rows)
    assert len(got) == len(rows)
    for i, t in rows:
        n, found = plain_base(t)
        r, at = got[i], [a for a, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and (r["score"] == 1.0 or not found)


FILL = "on the whole nothing here says what may be done with these words and so on "


def test_notices_whole_worn_and_told_apart(spark):
    permission = next(t.text for t in licenses.NOTICES if t.text.startswith("Permission is hereby granted, free"))
    worn = permission.replace("free of charge, ", "").replace("merge, publish", "merge or publish").replace("associated ", "")
    rows = [
        (1, FILL + "This work is licensed under the GNU General Public License, version 3. " + FILL),
        (2, FILL + "Licensed under CC BY-NC-SA 4.0. " + FILL),
        (3, FILL + worn + FILL),
        (4, FILL + "Released under the Beer License. " + FILL),
        (5, FILL + permission[: len(permission) // 3] + FILL),
        (6, "All rights reserved."),
        (7, FILL + "Licensed under the Apache-License version 2.0, or licensed under the GNU General Public License, version 2"),
        (8, FILL * 400 + "released under the mit license " + FILL * 400 + "Licensed under CC BY 4.0"),
        (9, FILL),
    ]
    got = notices_of(spark, rows)
    assert {i: r["labels"] for i, r in got.items()} == {
        1: "gpl-3", 2: "cc-by-nc,cc-by-nc-sa", 3: "mit", 4: "", 5: "", 6: "all-rights-reserved", 7: "apache-2,gpl-2", 8: "cc-by,mit", 9: ""
    }
    assert 0.75 <= got[3]["score"] < 1 and got[1]["score"] == 1 and got[9]["score"] == 0 and got[3]["n_base"] == 0
    spans = {r["doc_id"]: r["spans"] for r in licenses.scan(docs_of(spark, rows)).collect()}
    for i, t in rows:
        words = word_list(t)
        for s in spans[i]:
            near = max(2 * licenses.common_words(o.words, words[s["begin"] : s["end"]]) / (len(o.words) + s["end"] - s["begin"]) for o in (*licenses.PHRASES, *licenses.NOTICES) if o.label == s["label"])
            assert near == pytest.approx(s["score"])


def test_notices_of_edge_rows(spark):
    text = "under the MIT license"
    rows = [(7, text), (7, text), (7, "other"), (None, text), (None, None), (8, "")]
    got = licenses.report(licenses.scan(docs_of(spark, rows))).collect()
    assert sorted((r["doc_id"] or -1, r["n_base"], r["labels"]) for r in got) == [(-1, 0, ""), (-1, 1, "mit"), (7, 0, ""), (7, 1, "mit"), (7, 1, "mit"), (8, 0, "")]
    assert licenses.scan(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError, match="3 words"):
        licenses.scan(docs_of(spark, rows), phrases=[licenses.Template("x", "two words")])


def test_one_long_hot_notice_in_many_texts(spark):
    rows = [(i, f"{i} " + "Released under the MIT License. " * (1 + i % 3)) for i in range(400)]
    got = notices_of(spark, rows)
    assert all(got[i]["n_base"] == 1 + i % 3 and got[i]["labels"] == "mit" for i, _ in rows)


VECTORS = "vec_id bigint, embedding array<double>, n int, x string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "y") for i, v in rows], VECTORS)


def test_summaries_merge_without_loss():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 7)) @ rng.normal(size=(7, 7)) + 5
    total = None
    for part in np.split(rows, [1, 3, 60, 200]):
        total = whitening.merged(total, whitening.summary_of(part))
    centred = rows - rows.mean(axis=0)
    assert total.n == 500 and np.allclose(total.mean, rows.mean(axis=0), atol=1e-12)
    assert np.allclose((total.basis.T * total.variances) @ total.basis, centred.T @ centred / 500, rtol=1e-12, atol=1e-12)


def test_whitening_equals_the_dense_form(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) @ np.diag(np.linspace(0.2, 3, 20))
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(150)] + [(2000, base[1]), (2000, base[1]), (None, base[2])]
    rows += [(3000, None), (3001, [float("nan")] * 20), (3002, [float("inf")] + [0] * 19), (3003, [None] + [1] * 19), (3004, [0] * 20)]
    got = whitening.whitened(vectors_of(spark, rows).repartition(11)).toPandas()
    x = np.unique(np.floor(64 * np.vstack([base, np.zeros(20)])).astype(np.int64) + 1_000_000, axis=0)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert set(got["component"]) == set(range(1, 17)) and len(got) == 16 * 454 and (got["n"] == n).all()
    assert got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    sign = {}
    for i, vector in rows[:300] + [rows[-1]]:
        own = np.floor(64 * np.array(vector)).astype(np.int64) + 1_000_000
        held = got[got["vec_id"] == i].sort_values("component")
        assert (held["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s, strict=True))).all()
        for c, w, part in zip(range(16), held["whitened"], held["explained"], strict=True):
            want = (own - s / n) @ v[:, c] / np.sqrt(e[c])
            sign.setdefault(c, np.sign(want * w) or 1)
            assert w * sign[c] == pytest.approx(want, abs=1e-7) and part == pytest.approx(e[c] / e.sum(), rel=1e-9)


def test_whitening_of_edge_tables(spark):
    assert whitening.whitened(vectors_of(spark, [])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0  # one different vector: nothing varies
    line = whitening.whitened(vectors_of(spark, [(i, [i, 2 * i, 0]) for i in range(6)])).toPandas()
    assert len(line) == 6 and line["explained"].to_numpy() == pytest.approx(1) and line["identity_error"].max() < 1e-9
    both = whitening.whitened(vectors_of(spark, [(i, [i, i * i]) for i in range(5)] + [(i, [i, i * i, -i, i % 2]) for i in range(5)] + [(9, [])])).toPandas()
    assert sorted(both.groupby("component").size()) == [5, 5, 10, 10] or set(both["component"]) <= {1, 2, 3, 4}
    huge = whitening.whitened(vectors_of(spark, [(i, [1e300 * (-1) ** i, i]) for i in range(4)])).toPandas()
    assert set(huge["vec_id"]) == {0, 1, 2, 3} and np.isfinite(huge["whitened"]).all()


def test_deviation_is_exact_beyond_64_bits():
    m = whitening.Whitening(3 * 10**8, [7] * 2, np.zeros(2), np.zeros((2, 1)), [1.0])
    matrix = np.array([[1, 2], [10**9, 10**9]])
    want = [sum((m.n * int(x) - 7) ** 2 for x in row) for row in matrix]
    assert whitening._deviation(matrix, m) == [want[0], None] and want[1] >= 1 << 63


def test_rows_of_each_query_hold_their_columns(spark):
    from ramify.llm import queries

    for name, key, rows in (("op11_resample", "doc_id", 200), ("op12_licenses", "doc_id", 200), ("op13_whitening", "vec_id", None)):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert key in got.columns and (rows is None or got.count() == rows)
    base = queries.QUERIES["op12_licenses"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()}
    assert all(r["n_base"] == len(plain_base(docs[r["doc_id"]])[1]) for r in base)
