"""Operator 2: toxicity by a weighted lexicon.

Texts are folded first: case, accents, look-alike letters of other scripts and
digits that stand for letters. One Aho-Corasick automaton finds all entries of
the lexicon at word starts in one pass; exception phrases cancel the entries they
cover. The weights found, and the weights for the text's length, give the score
by a logistic curve.

The lexicon is learned from a bounded sample of labelled rows: word beginnings
are counted by label on Spark, and entries are chosen one by one, each by its
likelihood ratio on the toxic texts that the entries before it explain least.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_of, small_batches
from .fitting import FIT_ROWS, held_out, labelled_sample, logistic, sigmoid

#: Lengths of the word beginnings that may become entries.
STEM_LENGTHS = range(4, 11)
#: Candidates kept for the choice, most telling first.
MOST_CANDIDATES = 4000
#: Terms that a task counts before it passes them on: some 300 bytes each, and a worker keeps what it once took.
HELD_TERMS = 1 << 15
#: Entries of the lexicon at most.
MOST_ENTRIES = 400
#: A text explained by k entries counts this to the power k for the next choice.
EXPLAINED = 0.3
#: Texts scoring at least this are predicted toxic.
TOXIC_AT = 0.5

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d",
}
#: Digits and signs that stand for letters; l, 1 and | are one letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i"}
#: Harmless phrases around words that are entries elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "class clown", "pathetic fallacy", "scum line", "pond scum", "idiot proof")

_MARKS = {c: None for c in range(0x300, 0x370)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_FOLD = str.maketrans(SUBSTITUTES | {"\n": " ", "\t": " ", "\r": " "})
_FOLD_ALL = _MARKS | {ord(k): SUBSTITUTES.get(v, v) for k, v in LOOKALIKES.items()} | _FOLD
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and digit substitutions."""
    if text.isascii():
        return text.lower().translate(_FOLD)
    return unicodedata.normalize("NFKD", text.lower()).translate(_FOLD_ALL)


@dataclass(frozen=True)
class ToxicityModel:
    """Entry weights by folded word beginning, folded exception phrases, and the curve's intercept and two slopes."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = tuple(fold(x) for x in EXCEPTIONS)
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)


class Scorer:
    """The automaton of one model."""

    def __init__(self, model: ToxicityModel):
        self.curve = model.curve
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float]] = {s: (len(s), w) for s, w in model.weights}
        for phrase in model.exceptions:
            entries[phrase] = (len(phrase), 0.0)
        for word, value in entries.items():
            self.automaton.add_word(word, value)
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + weight found) and log(1 + weight found in a hundred words)."""
        if self.empty or not text:
            return 0.0, 0.0
        folded = fold(text)
        hits, cancelled = {}, []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            if weight:
                hits[start] = max(weight, hits.get(start, 0.0))
            else:
                cancelled.append((start, end))
        if not hits:
            return 0.0, 0.0
        if cancelled:
            starts, ends = zip(*sorted(cancelled), strict=True)
            reach = list(accumulate(ends, max))
            hits = {at: w for at, w in hits.items() if not (k := bisect_right(starts, at)) or reach[k - 1] < at}
        found = sum(hits.values())
        return math.log1p(found), math.log1p(100 * found / (text.count(" ") + text.count("\n") + 1))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        return float(sigmoid(np.float64(self.curve[0] + self.curve[1] * a + self.curve[2] * b)))


@lru_cache(maxsize=4)
def scorer(model: ToxicityModel) -> Scorer:
    return Scorer(model)


@dataclass
class _Choice:
    """Candidates' toxic texts and clean counts, and how much each toxic text still counts."""

    texts: dict[str, np.ndarray]
    clean: dict[str, int]
    weight: np.ndarray
    chosen: list[tuple[str, float]] = field(default_factory=list)

    def gain(self, term: str, odds: float) -> float:
        """Log-likelihood ratio of the term against the sample's share of toxic texts."""
        a, b = float(self.weight[self.texts[term]].sum()), float(self.clean[term])
        share = a / (a + b) if a + b else 0.0
        if share <= odds:
            return 0.0
        return a * math.log(share / odds) + (b * math.log((1 - share) / (1 - odds)) if b else 0.0)

    def run(self, odds: float, bound: float) -> list[tuple[str, float]]:
        toxic = {t: len(x) for t, x in self.texts.items()}
        left = set(self.texts)
        while left and len(self.chosen) < MOST_ENTRIES:
            best = max(left, key=lambda t: (round(self.gain(t, odds), 6), len(t), t))
            if self.gain(best, odds) < bound:
                break
            left.discard(best)
            self.weight[self.texts[best]] *= EXPLAINED
            total = toxic[best] + self.clean[best]
            self.chosen.append((best, round(min(5.0, math.log((toxic[best] + 0.5) / (self.clean[best] + 0.5)) - math.log(odds / (1 - odds))), 4)))
            if total == 0:
                break
        return [(t, w) for t, w in self.chosen if w > 0.5]


def _stems(text: str) -> set[str]:
    return {w[:k] for w in set(_WORD.findall(fold(text))) for k in STEM_LENGTHS if k <= len(w)}


def term_counts(batches: Iterator[pa.RecordBatch], held: int = HELD_TERMS) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows (text, label): terms with their numbers of toxic and clean texts, to be summed; about ``held`` terms are in memory."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    for texts, marks in rows_of(batches, "text", "label"):
        for x, label in zip(texts, marks, strict=True):
            seen[label].update(_stems(x))
            if len(seen[0]) + len(seen[1]) >= held:
                yield counted()
                seen = (Counter(), Counter())
    yield counted()


def _signature(text: str) -> int:
    """The smallest hash of three words in a row: near copies mostly share it, and count once in a fit."""
    words = fold(text).split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn a model from ``labels.toxic`` of rows that aren't held out; without toxic rows, an empty lexicon."""
    small_batches(docs.sparkSession)
    sampled = labelled_sample(docs, labels, "toxic", key, rows)

    def sign(batches):
        for texts, marks in rows_of(batches, "text", "label"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(marks, pa.int32()), pa.array([_signature(x) for x in texts], pa.int64())], names=["text", "label", "signature"]
            )

    sample = checkpointed(
        sampled.mapInArrow(sign, "text string, label int, signature bigint")
        .groupBy("signature", "label").agg(F.min("text").alias("text"))  # the same one whatever the partitions
        .select("text", "label", F.xxhash64("signature", "label").alias("id"))
    )

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return ToxicityModel()
    odds = n_toxic / (n_toxic + n_clean) if n_clean else 0.5
    counts = sample.mapInArrow(term_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    telling = F.col("toxic") * F.log(share / F.lit(odds)) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / F.lit(1 - odds))).otherwise(0.0)
    candidates = (
        counts.filter((F.col("toxic") >= 2) & (share > min(0.99, 2 * odds)))
        .withColumn("telling", telling)
        .orderBy(F.desc("telling"), "term")
        .limit(MOST_CANDIDATES)
        .collect()
    )
    place = {r["term"]: k for k, r in enumerate(candidates)}

    def find(batches):
        for texts, ids in rows_of(batches, "text", "id"):
            bits = np.zeros((len(texts), len(place)), bool)
            for row, x in zip(bits, texts, strict=True):
                row[[place[t] for t in _stems(x) & place.keys()]] = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())], names=["id", "bits"])

    # a bit for each candidate and toxic text of the sample: MOST_CANDIDATES * rows / 8 bytes at most
    toxic = sample.filter("label = 1").select("text", "id").mapInArrow(find, "id bigint, bits binary").orderBy("id").collect() if place else []
    held = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in toxic), np.uint8).reshape(len(toxic), -1), axis=1) if toxic else np.zeros((0, 0), np.uint8)
    choice = _Choice({t: np.flatnonzero(held[:, k]) for t, k in place.items()}, {r["term"]: r["clean"] for r in candidates}, np.ones(len(toxic)))
    weights = tuple(choice.run(odds, bound=math.log(max(len(place), 1)) + 1))
    lexicon = ToxicityModel(weights)

    def measure(batches):
        for texts_, marks in rows_of(batches, "text", "label"):
            found = [scorer(lexicon).features(x) for x in texts_]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array(marks, pa.int32())], names=["a", "b", "label"]
            )

    seen = sample.mapInArrow(measure, "a double, b double, label int").toPandas()
    seen = seen.sort_values(["a", "b", "label"])  # sums in one order give one model
    intercept, slopes = logistic(seen[["a", "b"]].to_numpy(), seen["label"].to_numpy(), l2=1e-4)
    return ToxicityModel(weights, curve=(intercept, float(slopes[0]), float(slopes[1])))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, from 0 to 1; a null text counts as empty. No shuffle."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        own = scorer(model)
        return pa.array([own.score(x or "") for x in texts.to_pylist()], pa.float64())

    return docs.withColumn(column, scored(F.col(text)))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every document, by a model fitted on rows that aren't held out."""
    model = fit(docs, labels, key)
    rows = score(docs.select(key, "text"), model, key)
    return rows.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
