"""Brute-force and round-trip tests of the text operators on small fixtures."""

import hashlib
import random
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from ramify.llm import bpe, common, html_extract, linededup, packing, quality, simhash, toxicity, urlfilter
from ramify.llm.common import tokenizer_file
from ramify.llm.components import components
from tokenizers import Tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_file())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, "  "), (4, "a <|endoftext|> b"), (5, "naïve café 👍🏽 ②"), (6, "x" * 5000), (7, "same words here today"), (8, "same words here today"), (8, "same words here today"), (None, "no id")]


def test_bpe_equals_the_library_and_round_trips(reference):
    own, draw = bpe.tokenizer(tokenizer_file()), random.Random(0)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "The", "'s", "12", "é", "!", "<|endoftext|>", " word", "日本"]
    for text in ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)]:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_digests_of_edge_rows(spark, reference):
    got = bpe.encode_digests(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = next(t for i, t in EDGE if i == r["doc_id"]) or ""
        ids = reference.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digests(docs_of(spark, [])).count() == 0
    both = bpe.decode(bpe.encode(docs_of(spark, EDGE)))
    assert all(r["decoded"] == (r["text"] or "") for r in both.collect())


def test_many_texts_at_once_merge_rare_words_as_rows(reference, monkeypatch):
    """op10's tokens: what is met once is not merged word by word, and every text gets the library's ids."""
    own, draw = bpe.BpeTokenizer(tokenizer_file()), random.Random(5)
    word = lambda: "".join(draw.choices("abcdeéñ中", k=draw.randint(1, 12))) + draw.choice(["", ",", ".\nAb", "'s", "12"])
    texts = [*(t for _, t in EDGE), "", " a  b ", "x<|endoftext|> y", *(" ".join(word() for _ in range(n)) for n in (1, 50, 4000, 4000))]
    texts = [x or "" for x in texts] + ["q" * 100 + " w"]
    queued = []
    monkeypatch.setattr(own, "merge", lambda symbols, merge=own.merge: queued.append(symbols) or merge(symbols))
    monkeypatch.setattr(bpe, "CUT_CHARACTERS", 30_000)
    monkeypatch.setattr(bpe, "REMEMBERED_CHUNKS", 500)  # forgets on the way
    for _ in range(2):
        got = [array("I", x).tolist() for x in own.encode_many(texts)]
        assert got == [reference.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(own._many) < 10_000 and max(map(len, own._many)) <= bpe.REMEMBERED_LENGTH
    assert len(queued) < 100  # of 8,000: the long word and the texts with special tokens


def test_packing_is_gapless_whole_and_near_the_bound(spark, reference):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "gamma"]) for _ in range(draw.randint(0, 3000)))) for i in range(150)] + [(900, None), (901, "")]
    got = packing.pack_documents(docs_of(spark, rows)).toPandas()
    for doc, text in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got["doc_id"] == doc].sort_values("piece")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids)
        assert (own["length"].to_numpy()[1:] == 2048).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own["start"], own["length"], own["ids_crc32"], strict=True))
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 2
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_sum_of_squares_choice_by_brute_force():
    lengths = np.random.default_rng(0).integers(1, 21, 200)
    sequence, offset = packing.sum_of_squares(lengths, 20)
    fill: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        assert o == fill.get(b, 0)
        room = [x for x in fill if fill[x] + s <= 20]
        square = lambda x: sum(v * v for v in np.bincount([20 - (fill[y] + (s if y == x else 0)) for y in fill], minlength=21)[1:].tolist())  # noqa: B023, E731
        if room:
            assert b in room and square(b) == min(square(x) for x in room)
        else:
            assert b not in fill
        fill[b] = fill.get(b, 0) + s


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_by_brute_force(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [[draw.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(160):
        own = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            own[draw.randrange(60)] = draw.choice(words)
        rows.append((i + 20, " ".join(own)))
    rows += [(i, t) for i, t in EDGE if i is not None]
    got = {r["id"]: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {i: r["fp"][0] % 2**64 for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_bit_sliced_distances():
    draw = np.random.default_rng(1)
    for words, radius in ((1, 4), (4, 42)):
        fps = np.repeat(draw.integers(0, 2**63, (6, words)).astype(np.uint64), 25, axis=0)
        for row in fps:
            for b in draw.integers(0, 64 * words, draw.integers(0, radius)):
                row[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
        planes = simhash.planes(fps)
        q, w = np.repeat(np.arange(len(fps)), len(planes)), np.tile(np.arange(len(planes)), len(fps))
        a, b = (np.concatenate(x) for x in zip(*simhash._compare(fps, planes, q, w, radius), strict=True))
        found = {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y < len(fps)}
        bits = np.unpackbits(fps.view(np.uint8), axis=1).astype(int)
        near = (np.abs(bits[:, None] - bits[None]).sum(axis=2) <= radius).nonzero()
        assert found == set(zip(*(x.tolist() for x in near), strict=True))


def test_large_buckets_are_cut_into_chunks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rows = spark.createDataFrame([(i, 7) for i in range(50)] + [(99, 8)], "rep bigint, bucket bigint")
    got = simhash.chunked(rows, 8).collect()
    met = set()
    parts = defaultdict(list)
    for r in got:
        parts[r["bucket"], r["part"]].append(r)
    for own in parts.values():
        met |= {(a["rep"], b["rep"]) for a in own for b in own if (a["side"], b["side"]) in ((2, 2), (0, 1)) and a["rep"] != b["rep"]}
    assert {tuple(sorted(p)) for p in met} == {(a, b) for a in range(50) for b in range(a + 1, 50)}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(3, 3), (1, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 540)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a == b or a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def test_line_dedup_by_brute_force(spark):
    draw = random.Random(3)
    base = ["".join(draw.choice("abcd ") for _ in range(30)) for _ in range(25)]
    rows = [(1, "A common line of plain text\nshort\nA common line of plain text"), (2, " a  COMMON line of plain text\nshort"), (3, None), (4, ""), (6, "A common line of plain texts"), (5, "x" * 4000)]
    for i in range(10, 90):
        lines = []
        for _ in range(draw.randint(1, 5)):
            line = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                e = draw.randrange(len(line))
                line[e : e + draw.choice([0, 1, 1])] = draw.choice([["x"], [], ["q"]])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    first = {}
    for i, k, f in sorted((i, k, linededup.fold(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))):
        if len(f) >= 20:
            first.setdefault(f, (i, k))
    near = {f for f, p in first.items() if any(q < p and f != g and within_one(f, g) for g, q in first.items())}
    want = {}
    for i, t in rows:
        seen, kept = set(), []
        for x in (t or "").split("\n"):
            f = linededup.fold(x)
            if len(f) >= 20:
                if f in near or f in seen or first[f][0] != i:
                    continue
                seen.add(f)
            kept.append(x)
        want[i] = None if t is None else "\n".join(kept)
    got = linededup.dedup_lines(docs_of(spark, rows), removed="removed")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and near
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "removed"]
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0


def test_bit_table_lets_all_wanted_rows_through(spark, monkeypatch):
    rows = spark.range(-500, 500).select(F.col("id").alias("doc"), F.lit("x").alias("text"))
    wanted = spark.createDataFrame([(i,) for i in range(-500, 500, 7)], "doc bigint")
    for bits in (64, 1 << 24):
        monkeypatch.setattr(common, "BITS", bits)
        got = common.maybe_wanted(rows, wanted, "doc")
        assert got.columns == ["doc", "text"] and got.join(wanted, "doc").count() == wanted.count() <= got.count()
    assert got.count() == wanted.count() and common.maybe_wanted(rows, wanted.limit(0), "doc").count() == 0


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><a href=x>menu</a></nav>
<div class="ad">Buy this, now.</div>{open}<h1>Title &amp; more</h1><p>First  paragraph, with text.<p>Second <b>bold</b> one; it goes on.<br>Line.</p>
<aside>side</aside><div class="cookie-notice">We use cookies.</div><form><label>mail</label></form>{close}<section id="comments"><article class="comment"><p>Reader says, hi.</p></article></section>
<footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>")])
def test_html_keeps_the_article_only(open_, close):
    page = PAGE.replace("{open}", open_).replace("{close}", close)
    assert html_extract.main_text(page) == "Title & more First paragraph, with text. Second bold one; it goes on. Line."


STORY = [f"Paragraph {k} of the story, which goes on for a while, names its people, and ends as it began; nothing is left out." for k in range(8)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<div class=post><h1>Head</h1>{all}</div><div><p>Short</p></div>", ["Head", *STORY]),
        ("<div class=post><h1>Head</h1>{all}</div><article><h3>Also</h3><p>Read on.</p></article>", ["Head", *STORY]),
        ("<article><h3>Also</h3><p>Read on.</p></article><section><h1>Head</h1>{all}</section>", ["Head", *STORY]),
        ("<article><h1>Head</h1>{first}</article><div>{last}</div>", ["Head", *STORY]),
        ("<article><h1>Head</h1>{most}</article><div>{end}</div><div><p>Short</p></div>", ["Head", *STORY]),
    ],
)
def test_html_content_is_chosen_by_ratios_not_by_the_article_tag(body, want):
    parts = {"all": STORY, "first": STORY[:4], "last": STORY[4:], "most": STORY[:7], "end": STORY[7:]}
    page = "<html><body><nav>menu</nav>" + body.format(**{k: paragraphs(v) for k, v in parts.items()}) + "<footer>us</footer></body></html>"
    assert html_extract.main_text(page) == " ".join(want)


def test_html_edge_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "plain &lt;text&gt;"), (3, "u", "plain &lt;text&gt;"), (4, "u", "<p>" + "word " * 20000)], "page_id bigint, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()]
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "plain <text>", 12), (3, "plain <text>", 12)] and got[4][2] == 99999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_urls_longest_rule_and_broken_urls(spark):
    urls = [
        ("https://WWW.Example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://m.example.com/fr", "m.example.com", "/fr", "com/", "allow"), ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"), ("http://notexample.com", "notexample.com", "", None, "allow"),
        ("http://x.spam-farm.example.org/a", "x.spam-farm.example.org", "/a", None, "block"), (None, "", "", None, "allow"), ("no url", "", "", None, "allow"), ("x://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0]) for k, u in enumerate(urls)], "page_id bigint, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(pages).collect()}
    assert got == {k: u[1:] for k, u in enumerate(urls)}


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s, seed=0: 5)
    (tmp_path / "f").write_bytes(urlfilter.compile_rules([("block", "a.com", "/"), ("allow", "b.com", "/")]))
    own = urlfilter.DigestArray(str(tmp_path / "f"))
    assert own.judge(["http://b.com/", "http://a.com/", "http://c.com/"])[3] == ["allow", "block", "allow"]
    with pytest.raises(ValueError):
        urlfilter.compile_rules([("block", f"{i}.com", "/") for i in range(3)], most=2)


def test_toxicity_folds_and_excepts():
    model = toxicity.ToxicityModel((("moron", 3.0), ("trash", 3.0)), curve=(-3.0, 3.0, 0.0))
    own = toxicity.scorer(model)
    assert all(own.score(x) > 0.5 for x in ("you m0r0n", "a МОRОN here", "móron", "trash talk"))
    assert all(own.score(x) < 0.5 for x in ("", "oxymoron", "a trash can", "plain text"))


def test_learned_scorers_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judged(docs, labels).join(labels, "doc_id").toPandas()
    assert ((found["predicted"] == found["quality"]).mean()) > 0.9 and found["score"].between(0, 1).all()
    tox = toxicity.judged(docs, labels).collect()
    assert len(tox) == docs.count() and all(0 <= r["score"] <= 1 for r in tox)
    share = np.mean([r["held_out"] for r in tox])
    assert 0.1 < share < 0.3


def test_scorers_on_edge_rows(spark):
    docs = docs_of(spark, EDGE)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for judged in (quality.judged, toxicity.judged):
        assert judged(docs, labels).count() == len(EDGE)
        assert judged(docs.limit(0), labels.limit(0)).count() == 0
    clash = docs.withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    assert quality.judged(clash, labels).columns == ["doc_id", "held_out", "score", "predicted"]
