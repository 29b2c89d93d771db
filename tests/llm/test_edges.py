"""Scorers against naive forms, and rows that are null, repeated, empty, very long or oddly named."""

import random
import re
import time

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from ramify.llm import embed_dedup, linededup, packing, quality, simhash, toxicity, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def naive_features(model, text):
    """Every entry and exception tried at every place of the folded text."""
    folded = toxicity.fold(text)
    starts = [k for k in range(len(folded)) if not k or not folded[k - 1].isalnum()]
    covered = {at for k in starts for e in model.exceptions if folded.startswith(e, k) for at in range(k, k + len(e))}
    found = 0.0
    for k in starts:
        weights = [w for s, w in model.weights if folded.startswith(s, k)]
        if weights and k not in covered:
            found += max(weights)
    return np.log1p(found), np.log1p(100 * found / (text.count(" ") + text.count("\n") + 1))


def test_toxicity_features_equal_the_naive_form():
    draw = random.Random(1)
    model = toxicity.ToxicityModel((("trash", 2.0), ("trashy", 3.0), ("moron", 1.5), ("sc", 0.7)), curve=(-3.0, 3.0, 1.0))
    own = toxicity.scorer(model)
    parts = ["trash can", "trash", "tr4sh", "trashy", "oxymoron", "moron", "MОRON", "scum line", "scum", "pond", " ", "\n", ", ", "class clown"]
    for _ in range(400):
        text = " ".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert np.allclose(own.features(text), naive_features(model, text) if text else (0, 0)), text


def test_exceptions_and_long_texts_take_linear_time():
    own = toxicity.scorer(toxicity.ToxicityModel((("trash", 2.0),), curve=(-3.0, 3.0, 1.0)))
    began = time.process_time()
    assert own.features("trash can " * 200_000) == (0.0, 0.0)
    assert own.features("trash " * 200_000)[0] > 12
    assert time.process_time() - began < 10


def test_rules_as_columns_equal_rules_as_arrays(spark):
    draw = random.Random(2)
    texts = [None, "", "   ", "One line.\n\nAnother, (with) signs!", "x" * 3000] + ["".join(draw.choice("ab CD\n.,!?#1") for _ in range(draw.randint(1, 300))) for _ in range(60)]
    docs = docs_of(spark, list(enumerate(texts)))
    names = list(quality.statistics({n: F.col(n) for n in ("text", "words", "lines")}))
    cut = docs.select("doc_id", *(c.alias(n) for n, c in quality.parts(F.col("text")).items()))
    values = quality.statistics({n: F.col(n) for n in ("text", "words", "lines")})
    seen = cut.select("doc_id", *(c.alias(n) for n, c in values.items())).toPandas().sort_values("doc_id")
    x = seen[names].to_numpy(float)
    assert np.isfinite(x).all()
    for k, t in enumerate(texts):
        words, lines = (t or "").split(), [line for line in (t or "").split("\n") if line.strip(" ")]
        assert np.isclose(seen["words"].iloc[k], np.log1p(len(words))) and np.isclose(seen["lines"].iloc[k], np.log1p(len(lines)))
        assert np.isclose(seen["distinct_words"].iloc[k], len(set(words)) / max(len(words), 1))
    y = (x[:, names.index("commas")] > 0.02).astype(float)
    model = quality.fit_rules(x, y, names)
    assert model.rules
    total = np.full(len(x), model.intercept)
    for rule, weight in model.rules:
        total += weight * rule.holds(x, names)
    got = quality.score(docs.withColumn("words", F.lit("clash")), model).toPandas().sort_values("doc_id")
    assert np.allclose(got["score"], 1 / (1 + np.exp(-total))) and got["words"].eq("clash").all()


def test_near_stage_tells_rows_apart(spark):
    draw = random.Random(3)
    text = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, b), (None, c + " more"), (None, text()), (5, None), (6, ""), (7, "  "), (8, "long " * 30_000), (9, "long " * 29_000)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, docs_of(spark, rows), "").collect()]
    want = [(1, a), (2, b), (3, c), rows[7], (5, None), (8, "long " * 30_000)]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert corpus_pipeline.near_stage(spark, docs_of(spark, []), "").count() == 0


def test_rows_without_an_id_link_by_their_text(spark):
    words = [f"w{k}" for k in range(80)]
    bridge = " ".join(words)
    rows = [(None, bridge), (None, bridge), (7, bridge + " end"), (4, " ".join(["new", *words])), (None, "else here entirely now")]
    prints = {r["x"]: simhash.fingerprint(simhash.shingle_hashes(r["x"], 4, 42))[0] for r in docs_of(spark, rows).select(F.col("text").alias("x")).collect()}
    near = lambda x, y: int(prints[x] ^ prints[y]).bit_count() <= 4
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == 5
    if near(bridge, rows[2][1]) and near(bridge, rows[3][1]):
        assert sorted(str(r["component_id"]) for r in got) == ["4", "4", "4", "4", "None"]
    assert sum(r["component_id"] is None for r in got) == 1


def test_clashing_columns_stay(spark):
    docs = docs_of(spark, [(1, "a line that is long enough\nb"), (2, "a line that is long enough"), (None, None)])
    for name in ("doc", "x", "row", "gone", "new", "h", "__doc", "k"):
        docs = docs.withColumn(name, F.lit(name))
    got = linededup.dedup_lines(docs, removed="removed")
    assert got.columns == [*docs.columns, "removed"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "a line that is long enough\nb", 2: "", None: None}
    assert all(r[name] == name for r in got.collect() for name in ("doc", "x", "row", "gone", "new", "h", "__doc", "k"))
    once = simhash.one_of_each(docs)
    assert once.columns == docs.columns and once.count() == 3
    pieces = spark.createDataFrame([(k, 100 + k, "r", "g", 5) for k in range(40)], "doc_id bigint, length bigint, row string, `group` string, offset int")
    packed = packing.pack(pieces, 2048)
    assert packed.columns == ["doc_id", "length", "row", "group", "sequence_id", "offset"]
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("c")).toPandas()
    assert sums["n"].max() <= 2048 and sums["c"].sum() == 40
    twice = packing.pack(pieces.unionByName(pieces), 2048)
    assert twice.count() == 80


def test_vectors_with_clashing_columns_and_shared_ids(spark):
    x = np.random.default_rng(1).normal(size=(40, 12))
    x[30:] = x[:10] + np.random.default_rng(2).normal(size=(10, 12)) * 0.01
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5, [float(v) for v in x[20]])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for name in ("vec", "rep", "n", "low", "bucket"):
        frame = frame.withColumn(name, F.lit(name))
    got = [tuple(r) for r in embed_dedup.near_duplicates(frame).collect()]
    by_id = {}
    for i, n, component, kept in got:
        by_id.setdefault(i, []).append((n, component, kept))
    assert len(got) == 41 and by_id[35] == [(1, 5, False)] and sorted(by_id[5]) == [(1, 5, True), (1, 5, True)] and by_id[20] == [(1, 5, False)]


def test_urls_of_a_long_list_and_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://h999999.example/x"), (1, "http://h999999.example/x"), (2, "http://h5.example.org/"), (3, None)], "page_id bigint, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = [tuple(r) for r in urlfilter.judge_urls(pages, listed_hosts=(f"h{k}.example" for k in range(1_000_000))).collect()]
    assert got == [(1, "h999999.example", "/x", None, "block")] * 2 + [(2, "h5.example.org", "/", None, "allow"), (3, "", "", None, "allow")]
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_folding_lines_costs_no_pattern_at_every_space():
    draw, pattern = random.Random(6), re.compile(r"[ \t\r\x0b\f]+")
    for _ in range(3000):
        line = "".join(draw.choice("aÄßΣİ \t\r\x0b\f\x1c\xa0") for _ in range(draw.randrange(40)))
        assert linededup.fold(line) == pattern.sub(" ", line).strip(" ").lower()
    line = "some words of a line " * 50_000

    def seconds(f):
        best = float("inf")
        for _ in range(3):
            start = time.process_time()
            f(line)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(linededup.fold) < seconds(lambda x: pattern.sub(" ", x)) / 3


def test_lines_taken_out_of_a_text(monkeypatch):
    long = [f"line {k}, which is long enough to go" for k in range(3)]
    text, keys = "\n".join([long[0], "short", long[1], "short", ""]), [linededup.line_key(x) for x in long]
    assert linededup.without_lines(text, {keys[1], keys[2]}, 20) == (f"{long[0]}\nshort\nshort\n", 1)
    assert linededup.without_lines(f"{text}\n{long[0].upper()}  ", set(), 20) == (text, 1)
    assert linededup.without_lines(long[0], {keys[0]}, 20) == ("", 1)
    monkeypatch.setattr(linededup, "line_key", None)  # a text with nothing to take out isn't hashed
    assert linededup.without_lines(text, set(), 20) == (text, 0)
