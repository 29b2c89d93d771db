"""Operator 7: fuzzy removal of repeated lines by a deletion-neighbourhood join.

A line counts as repeated when an earlier line, by document id and line number,
is equal to it or one edit away, after case and white space are folded. Lines
under ``min_chars`` characters always stay.

1. Lines travel as 128-bit hashes only. Equal lines are one class; its earliest
   document keeps it.
2. One edit changes one of three pieces of a line, so lines can only be neighbours
   if they share a key made from the other two. Classes without a shared key leave
   here; only the others' texts are fetched.
3. Those emit their deletion neighbourhood, as far as the shared key allows: the
   line itself and the line without one character, hashed with the place of the
   deletion. Equal keys join: the same deletion at the same place is a
   substitution, a deletion that equals a whole line is an insertion. In each such
   group every line is compared with the earliest one only, which loses nothing,
   as the members are all neighbours of it; the edit distance is then verified.
4. Every document drops its lines that have an earlier neighbour, and its own
   repeats.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_wanted, rows_of, small_batches, written

#: Shorter lines, after folding, are never removed.
MIN_CHARS = 20
#: Pieces of a line; one edit leaves all but one of them.
PIECES = 3
#: Lines that one batch of a worker's results holds; variants of lines, and those of one line more.
LINES, VARIANTS = 1 << 13, 1 << 14


def fold(line: str) -> str:
    """Lower case, runs of white space as one space, none at the ends.

    Plain replacements: a pattern that stops at every space takes seven times as long.
    """
    for space in "\t\r\x0b\f":
        if space in line:
            line = line.replace(space, " ")
    while "  " in line:
        line = line.replace("  ", " ")
    return line.strip(" ").lower()


def digest(data: str | bytes, seed: int = 0) -> int:
    """Unsigned 64-bit xxhash."""
    return xxhash.xxh64_intdigest(data if isinstance(data, bytes) else data.encode("utf-8", "replace"), seed)


def signed(digests: Sequence[int]) -> np.ndarray:
    """Digests as Spark's bigint has them: the same bits with a sign."""
    return np.array(digests, dtype=np.uint64).view(np.int64)


def _characters(line: str) -> str | bytes:
    """The line in a form that slices by characters; bytes, where a byte is one, are hashed at once."""
    return line.encode() if line.isascii() else line


@lru_cache(maxsize=1 << 12)
def _cuts(n: int) -> list[tuple[int, int, int]]:
    """Begin and end of what each piece key of a line of ``n`` characters leaves out, and the key's seed."""
    return [(i * m // PIECES, n - m + (i + 1) * m // PIECES, m * PIECES + i + 1) for m in (n - 1, n) for i in range(PIECES)]


def line_key(line: str) -> bytes:
    """The 128-bit hash that stands for a folded line: among 10**12 lines two share one with a chance of 10**-15."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))


def piece_keys(line: str) -> list[int]:
    """Keys shared with every line one edit away, by piece and by the shorter one's length (own - 1, own)."""
    chars = _characters(line)
    gap = b"\n" if isinstance(chars, bytes) else "\n"
    return [digest(chars[:lo] + gap + chars[hi:], seed) for lo, hi, seed in _cuts(len(chars))]


def neighbourhood(line: str, pieces: set[int]) -> list[tuple[int, int]]:
    """(key, kind) of the deletion neighbourhood in the given pieces (numbered as in ``piece_keys``).

    Kinds: 0 the line itself, 1 the line less one character, 2 the same with the
    place. Kind 0 meets kind 1 (an insertion), kind 2 meets kind 2 (a substitution).
    """
    n, chars = len(line), _characters(line)
    out = [(digest(chars), 0)]
    places: dict[int, set[int]] = {1: set(), 2: set()}
    for p in pieces:
        m, i = (n - 1, p) if p < PIECES else (n, p - PIECES)
        lo, hi = i * m // PIECES, (i + 1) * m // PIECES
        if m == n:
            places[2].update(range(lo, hi))
        else:
            places[1].update(range(lo, hi + 1))
    for kind, own in places.items():
        for e in own:
            if kind == 1 and e and chars[e] == chars[e - 1]:
                if e - 1 in own:
                    continue  # the same string as without the character before
            short = chars[:e] + chars[e + 1 :]
            out.append((digest(short) if kind == 1 else digest(short, e + 1), kind))
    return out


def _classes(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``doc, h, keys`` of every line that is long enough."""

    def run(batches):
        out: tuple[list, ...] = ([], [], [])
        for ids, texts in rows_of(batches, "doc", "x"):
            for doc, x in zip(ids, texts, strict=True):
                seen = set()
                for line in (x or "").split("\n"):
                    folded = fold(line)
                    if len(folded) >= min_chars and (h := line_key(folded)) not in seen:
                        seen.add(h)
                        out[0].append(doc)
                        out[1].append(h)
                        out[2].extend(piece_keys(folded))
                        if len(out[0]) >= LINES:
                            yield batch_of(*out)
                            out = ([], [], [])
        if out[0]:
            yield batch_of(*out)

    def batch_of(ids: list[int], hs: list[bytes], keys: list[int]) -> pa.RecordBatch:
        columns = signed(keys).reshape(-1, 2 * PIECES)
        names = ["doc", "h", *(f"k{i}" for i in range(2 * PIECES))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.binary()), *(pa.array(np.ascontiguousarray(k)) for k in columns.T)], names=names)

    schema = "doc bigint, h binary, " + ", ".join(f"k{i} bigint" for i in range(2 * PIECES))
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("x")).mapInArrow(run, schema)


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``h, pieces, doc, line_no, line`` for wanted lines ``doc, hs: array<struct<h, keys>>``; pieces are those whose keys are wanted."""

    def run(batches):
        for ids, texts, wants in rows_of(batches, "doc", "x", "hs"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, x, hs in zip(ids, texts, wants, strict=True):
                left = {w["h"]: set(w["keys"]) for w in hs}
                for k, line in enumerate((x or "").split("\n")):
                    folded = fold(line)
                    shared = left.pop(h := line_key(folded), None)
                    if shared is not None:
                        pieces = [p for p, key in enumerate(signed(piece_keys(folded)).tolist()) if key in shared]
                        for column, value in zip(out, (h, pieces, doc, k, folded), strict=True):
                            column.append(value)
                    if not left:
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())],
                names=["h", "pieces", "doc", "line_no", "line"],
            )

    wanted = checkpointed(wanted)
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("x"))
    return maybe_wanted(rows, wanted, "doc").join(wanted, "doc").mapInArrow(run, "h binary, pieces array<int>, doc bigint, line_no bigint, line string").dropDuplicates(["h"])


def _near(lines: DataFrame) -> DataFrame:
    """``h`` of the lines that have an earlier line one edit away."""

    def run(batches):
        for hs, pieces, docs, numbers, texts in rows_of(batches, "h", "pieces", "doc", "line_no", "line"):
            out: list[tuple] = []
            for h, own, doc, number, line in zip(hs, pieces, docs, numbers, texts, strict=True):
                out += [(k, kind, h, doc, number) for k, kind in neighbourhood(line, set(own))]
                if len(out) >= VARIANTS:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        variant, *rest = zip(*out, strict=True)
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(signed(variant)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=["variant", "kind", "h", "doc", "line_no"])

    variants = checkpointed(lines.mapInArrow(run, "variant bigint, kind int, h binary, doc bigint, line_no bigint"))
    place = F.struct("doc", "line_no", "h")
    # substitutions: every line of a group is one edit from the group's earliest
    same = variants.filter("kind = 2").groupBy("variant").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = variants.filter("kind = 2").join(same, "variant").filter(F.col("h") != F.col("first.h")).select("h", F.col("first.h").alias("earlier"))
    # insertions: a line less one character is a whole line; the later of the two goes
    whole = variants.filter("kind = 0").select("variant", F.col("h").alias("short"), F.struct("doc", "line_no").alias("short_at"))
    longer = variants.filter("kind = 1").select("variant", "h", F.struct("doc", "line_no").alias("at"))
    both = longer.join(whole, "variant")
    later = F.col("at") > F.col("short_at")
    pairs = pairs.union(both.select(F.when(later, F.col("h")).otherwise(F.col("short")), F.when(later, F.col("short")).otherwise(F.col("h"))))
    left, right = lines.select("h", F.col("line").alias("own")), lines.select(F.col("h").alias("earlier"), F.col("line").alias("other"))
    verified = pairs.distinct().join(left, "h").join(right, "earlier").filter(F.levenshtein("own", "other", 1).between(0, 1))
    return verified.select("h").distinct()


def without_lines(text: str, gone: set[bytes], min_chars: int) -> tuple[str, int]:
    """The text less the lines whose keys are ``gone`` and its own repeats, and the number of lines taken out."""
    folded = [fold(line) for line in text.split("\n")]
    if not gone:
        long = [line for line in folded if len(line) >= min_chars]
        if len(set(long)) == len(long):
            return text, 0
    seen, kept = set(gone), []
    for line, short in zip(text.split("\n"), folded, strict=True):
        if len(short) >= min_chars:
            h = line_key(short)
            if h in seen:
                continue
            seen.add(h)
        kept.append(line)
    return "\n".join(kept), len(folded) - len(kept)


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, fuzzy: bool = True, removed: str | None = None
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; all rows and columns stay.

    ``fuzzy=False`` removes equal lines only. ``removed`` names a column to add
    with the number of lines taken out. A null text stays null. Rows with the same
    id count as one document's; a row with a null id only loses its own repeats. A
    document of which every line repeats keeps an empty text.
    """
    small_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(2 * PIECES)]
    lines = written(_classes(docs, key, text, min_chars))
    classes = lines.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in names))
    gone = classes.filter("n > 1").select("h", "first")
    if fuzzy:
        classes = written(classes)
        gone = classes.filter("n > 1").select("h", "first")
        exploded = classes.select("h", F.explode(F.array(*names)).alias("k"))
        shared = checkpointed(exploded.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"))
        few = maybe_wanted(exploded, shared, "k").join(shared, "k").groupBy("h").agg(F.collect_set("k").alias("keys"))
        wanted = few.join(classes.select("h", F.col("first").alias("doc")), "h").groupBy("doc").agg(F.collect_list(F.struct("h", "keys")).alias("hs"))
        near = _near(checkpointed(_texts(docs, wanted, key, text)))
        gone = gone.join(near.withColumn("near", F.lit(True)), "h", "full").select("h", F.when(F.col("near"), None).otherwise(F.col("first")).alias("first"))
    dropped = (
        lines.select("doc", "h").join(gone, "h").filter(F.col("first").isNull() | (F.col("doc") != F.col("first")))
        .groupBy("doc").agg(F.collect_set("h").alias("gone"))
    )

    @F.arrow_udf("struct<text: string, removed: long>")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, removed = [], []
        for x, hs in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            kept, n = (None, 0) if x is None else without_lines(x, set(hs or ()), min_chars)
            out.append(kept)
            removed.append(n)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, pa.int64())], names=["text", "removed"])

    columns = [F.col(f"row.`{c}`") if c != text else F.col("new.text").alias(text) for c in docs.columns if c != removed]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), F.col(key).cast("bigint").alias("doc"), F.col(text).alias("x"))
    joined = rows.join(dropped, "doc", "left").select("row", without(F.col("x"), F.col("gone")).alias("new"))
    return joined.select(*columns, *([F.col("new.removed").alias(removed)] if removed else []))
