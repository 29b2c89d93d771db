"""Operator 5: SimHash near-duplicates with bit-sliced comparison.

1. Each text gets a fingerprint: a bit is set when over half of its shingle
   hashes have it. Equal fingerprints are one class from here on.
2. Candidates meet in buckets. For a small radius the bits are cut into radius +
   m blocks and every choice of m equal blocks is a table, so by the pigeonhole
   principle no pair within the radius is missed; m grows with the number of
   classes so that buckets stay small. For a wide radius the tables take random
   bits instead, and more tables where they take more bits.
3. In a bucket 64 fingerprints share a machine word: bit planes are stored
   vertically, and carry-save counters add up 64 distances at a time. A block of
   64 is given up once all of its distances exceed the radius.
4. A bucket reports a spanning forest of its links, never all pairs, and
   connected components of all forests give the groups. Large buckets are cut
   into chunks, and every pair of chunks is a task of its own.
5. Where a similarity is asked for, the groups are candidates only: the shingle
   sets of their texts meet in chunks, and pairs that reach it are the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, maybe_wanted, maybe_wanted_mark, numbered, rows_of, small_batches, written
from .components import components, forest

#: Rows of a bucket that meet in one task; larger buckets are cut into chunks of so many.
CHUNK = 2048
#: So many large buckets, of 12 bytes each, may be broadcast.
FEW_BUCKETS = 1 << 16
#: Comparisons of one fingerprint with 64 others that run side by side in numpy.
SIDE_BY_SIDE = 1 << 16
#: Comparisons whose hits are listed at a time: dense groups link all of their pairs.
LISTED = 1 << 12
#: Buckets of the pigeonhole tables should hold about so many classes at most.
BUCKET_CLASSES = 2000
#: Hashes whose bits are summed at a time.
SUMMED_HASHES = 1 << 16
#: Shingles of a candidate group that meet in one task, and the least that a text counts for: 256 texts at most.
VERIFIED_SHINGLES, LEAST_SHINGLES = 1 << 17, 1 << 9

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHashSettings:
    """``shingle`` words, a fingerprint of ``words`` x 64 bits, links at up to ``radius`` bits.

    ``tables`` and ``sampled_bits``: 0 tables means exact pigeonhole tables. Otherwise
    each of the tables compares ``sampled_bits`` random bits, and more once buckets
    would hold over ``CHUNK`` classes on average; each further bit raises the number
    of tables, so that a pair that differs in the share ``differing`` of its bits is
    found as often at any size. ``similarity``: Jaccard of the shingle sets of a link.
    """

    shingle: int = 4
    words: int = 1
    radius: int = 4
    seed: int = 42
    tables: int = 0
    sampled_bits: int = 14
    differing: float = 0.0
    similarity: float = 0.0


EXACT = SimHashSettings()
#: Five-word shingles at a Jaccard similarity of 0.8 or more: the sets' cosine is at least
#: 2J / (1 + J), so 15.2 % of the bits differ at 0.8; of 256 bits 39, with a deviation of 6,
#: and the radius lies three deviations above.
SIMILAR = SimHashSettings(shingle=5, words=4, radius=57, tables=40, sampled_bits=12, differing=0.152, similarity=0.8)



def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined word shingles, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only ASCII is lowered and split at
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter([h(joined[s:e], seed) for s, e in spans], np.uint64, len(words) - size + 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash made from a 64-bit hash."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority bits of the hashes as ``words`` unsigned 64-bit integers; zero without hashes."""
    out = np.zeros(words, np.uint64)
    if len(hashes):
        for k in range(words):
            total = np.zeros(64, np.int64)
            for at in range(0, len(hashes), SUMMED_HASHES):
                part = _mixed(hashes[at : at + SUMMED_HASHES], k)
                total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, settings: SimHashSettings = EXACT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id bigint, fp array<bigint>`` of every row; a text that is null or has no words gets zero."""
    small_batches(docs.sparkSession)

    def run(batches):
        for ids, texts in rows_of(batches, "id", "x"):
            fps = [fingerprint(shingle_hashes(x, settings.shingle, settings.seed), settings.words).view(np.int64).tolist() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["id", "fp"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("x")).mapInArrow(run, "id bigint, fp array<bigint>")


def tables_for(settings: SimHashSettings, classes: int) -> list[list[int]]:
    """The bits that must be equal in each table, for so many distinct fingerprints."""
    bits = 64 * settings.words
    if settings.tables:
        wider = max(0, int(np.ceil(np.log2(max(classes, 1) / CHUNK))) - settings.sampled_bits)
        width = min(settings.sampled_bits + wider, bits)
        equal = [math.comb(bits - round(settings.differing * bits), k) / math.comb(bits, k) for k in (settings.sampled_bits, width)]
        draw = np.random.default_rng(settings.seed)
        return [sorted(draw.choice(bits, width, replace=False).tolist()) for _ in range(math.ceil(settings.tables * equal[0] / equal[1]))]
    if settings.radius >= bits:
        return [[]]
    for m in (1, 2, 3):
        edges = np.linspace(0, bits, min(settings.radius + m, bits) + 1).astype(int)
        blocks = [list(range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        tables = [[b for block in chosen for b in block] for chosen in combinations(blocks, m)]
        if classes >> min(map(len, tables)) <= BUCKET_CLASSES or m == 3 or len(blocks) == bits:
            return tables
    return tables


def _bits(fp: Column, positions: list[int]) -> Column:
    """The chosen bits of a fingerprint, gathered by one mask a word."""
    masks: dict[int, int] = {}
    for b in positions:
        masks[b >> 6] = masks.get(b >> 6, 0) | 1 << (b & 63)
    signed = {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}
    parts = [F.get(fp, F.lit(w)).bitwiseAND(F.lit(m).cast("bigint")) for w, m in sorted(signed.items())]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def _compare(query: np.ndarray, lanes: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, lane) within the radius, a bounded number at a time.

    ``query``: fingerprints (n, words). ``lanes``: bit planes (blocks, bits), 64
    fingerprints in each machine word. ``q``, ``w``: the query and the block of each
    comparison. Distances are kept as vertical binary counters, one plane a digit.
    """
    digits = max(1, int(radius).bit_length())
    n_bits = lanes.shape[1]
    live = np.arange(len(q))
    counters = [np.zeros(len(q), np.uint64) for _ in range(digits)]
    full = np.zeros(len(q), np.uint64)
    bias = (1 << digits) - 1 - radius  # counters begin here, so that exceeding the radius overflows
    for d in range(digits):
        if bias >> d & 1:
            counters[d][:] = _ALL
    check = max(8, radius + 1)
    at_q, at_w = q, w
    for b in range(n_bits):
        own = -(query[at_q, b >> 6] >> np.uint64(b & 63) & np.uint64(1)).astype(np.int64)
        carry = lanes[at_w, b] ^ own.view(np.uint64)
        for d in range(digits):
            carry, counters[d] = counters[d] & carry, counters[d] ^ carry
        full |= carry
        if b >= check and b % 8 == 7 and b + 1 < n_bits:
            keep = full != _ALL
            if not keep.all():
                live, at_q, at_w, full = live[keep], at_q[keep], at_w[keep], full[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    break
    rows = np.flatnonzero(full != _ALL)
    for part in (rows[at : at + LISTED] for at in range(0, len(rows), LISTED)):
        hits = np.unpackbits((~full[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, lane = np.nonzero(hits)
        yield q[live[part[r]]], w[live[part[r]]] * 64 + lane


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, words): (ceil(n / 64), bits), lane i of a block at bit i.

    Unused lanes repeat the block's first fingerprint.
    """
    n, words = fps.shape
    blocks = -(-n // 64)
    padded = np.concatenate([fps, np.repeat(fps[(blocks - 1) * 64 : (blocks - 1) * 64 + 1], blocks * 64 - n, axis=0)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, words * 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(blocks, words * 64, 8).copy().view(np.uint64)[:, :, 0]


def _links(rep: np.ndarray, fps: np.ndarray, side: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest links of consecutive groups that end at ``ends``; side 0 meets side 1, or itself (side 2)."""
    start = 0
    batch: list[tuple] = []
    base_q = base_w = 0
    q_rows: list[np.ndarray] = []
    lane_rows: list[np.ndarray] = []
    lane_planes: list[np.ndarray] = []

    def flush():
        q = np.concatenate([x for x, _ in batch])
        w = np.concatenate([x for _, x in batch])
        rows, lanes = np.concatenate(q_rows), np.concatenate(lane_rows)
        touched, local = np.unique(np.concatenate([rows, lanes[lanes >= 0]]), return_inverse=True)
        at_lane = np.full(len(lanes), -1)
        at_lane[lanes >= 0] = local[len(rows) :]
        root = np.arange(len(touched))
        for a, b in _compare(fps[rows], np.concatenate(lane_planes), q, w, radius):
            b = at_lane[b]
            x, y = root[local[a[b >= 0]]], root[b[b >= 0]]
            if (new := x != y).any():
                root = forest(len(touched), x[new], y[new], root)
        moved = root != np.arange(len(touched))
        return rep[touched[moved]], rep[touched[root[moved]]]

    size = 0
    for end in ends.tolist():
        rows = np.arange(start, end)
        kind = side[start:end]
        left, right = rows[kind != 1], rows[kind != 0]
        start = end
        if not len(left) or not len(right) or len(rows) < 2:
            continue
        blocks = -(-len(right) // 64)
        lanes = np.full(blocks * 64, -1, np.int64)
        lanes[: len(right)] = right
        q = np.repeat(np.arange(len(left)), blocks) + base_q
        w = np.tile(np.arange(blocks), len(left)) + base_w
        q_rows.append(left)
        lane_rows.append(lanes)
        lane_planes.append(planes(fps[right]))
        batch.append((q, w))
        base_q, base_w, size = base_q + len(left), base_w + blocks, size + len(q)
        if size >= SIDE_BY_SIDE:
            yield flush()
            batch, q_rows, lane_rows, lane_planes, base_q, base_w, size = [], [], [], [], 0, 0, 0
    if batch:
        yield flush()


def _compare_buckets(radius: int, words: int):
    """mapInArrow over rows (bucket, part, side, rep, fp) that are sorted by bucket and part."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def ready(last: bool):
            nonlocal held
            if not held:
                return
            bucket, part, side, rep, fps = (np.concatenate([h[i] for h in held]) for i in range(5))
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            cut = len(bucket) if last else (int(change[-1]) if len(change) else 0)
            held = [] if cut == len(bucket) else [(bucket[cut:], part[cut:], side[cut:], rep[cut:], fps[cut:])]
            if cut:
                ends = np.append(change[change < cut], cut)
                for a, b in _links(rep[:cut], fps[:cut], side[:cut], ends, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            flat = get("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
            held.append((*(get(n).to_numpy(zero_copy_only=False) for n in ("bucket", "part", "side", "rep")), flat))
            rows += batch.num_rows
            if rows >= SIDE_BY_SIDE:
                yield from ready(last=False)
                rows = 0
        yield from ready(last=True)

    return run


def chunked(rows: DataFrame, chunk: int = CHUNK, weight: Column | None = None) -> DataFrame:
    """Rows (``bucket``, ``rep``, more) with ``part`` and ``side``.

    A bucket of over ``chunk`` rows, or of rows that weigh more, is dealt by hash into chunks; each
    chunk meets itself (side 2) and each other one (sides 0 and 1), in parts of their own. The
    others are one part. Where the large buckets are few they are broadcast, and the rows aren't shuffled here.
    """
    heavy = F.count("*") if weight is None else F.sum(weight)
    sizes = rows.groupBy("bucket").agg(F.least(F.count("*"), F.ceil(heavy / F.lit(chunk))).cast("int").alias("chunks"))
    large = checkpointed(sizes.filter("chunks > 1"))
    split = rows.join(F.broadcast(large) if large.count() <= FEW_BUCKETS else large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("chunks")).cast("int")
    meets = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return (
        split.withColumn("own", own)
        .withColumn("other", F.explode(meets))
        .withColumn("part", (lo * F.col("chunks") + hi).cast("bigint"))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("bigint"))
        .drop("chunks", "own", "other")
    )


def linked(classes: DataFrame, settings: SimHashSettings, n_classes: int) -> DataFrame:
    """Forest links (a, b) between classes ``rep, fp`` of distinct fingerprints."""
    keys = [_bits(F.col("fp"), t) for t in tables_for(settings, n_classes)]
    met = classes.select("*", F.posexplode(F.array(*keys)).alias("k", "v")).withColumn("bucket", F.xxhash64("k", "v")).drop("k", "v")
    rows = chunked(met).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return rows.mapInArrow(_compare_buckets(settings.radius, settings.words), "a bigint, b bigint").distinct()


def lowest(classes: DataFrame, groups: DataFrame, value: str) -> DataFrame:
    """``node`` and the least ``value`` of its component, for the linked nodes of ``classes`` (``node``, ``value``)."""
    least = groups.join(classes.select("node", value), "node").groupBy("component").agg(F.min(value).alias(value))
    return groups.join(least, "component").select("node", value)


def near_duplicates(docs: DataFrame, settings: SimHashSettings = EXACT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.
    Rows with equal fingerprints, exact copies and texts without words among them,
    are linked. Repeated rows give repeated results; an empty table gives none. A
    row whose id is null takes part by its text and gets the group's smallest id,
    which is null only where no row of the group has an id.
    """
    prints = written(fingerprints(docs, settings, key, text))
    classes = numbered(prints.groupBy("fp").agg(F.min("id").alias("low")))
    groups = components(linked(classes.select(F.col("node").alias("rep"), "fp"), settings, classes.count()))
    lows = lowest(classes, groups, "low").withColumnRenamed("low", "lower")
    named = classes.join(lows, "node", "left").select("fp", F.least("low", "lower").alias("component_id"))
    return prints.join(named, "fp", "left").select("id", "fp", "component_id")


def row_key(key: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text, nulls included."""
    told = F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(told))


def shingle_set(text: str | None, settings: SimHashSettings) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, settings.shingle, settings.seed))


def _set_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def set_prints(rows: DataFrame, settings: SimHashSettings) -> DataFrame:
    """``k, id, fp, shingles, same`` of every row ``k, id, x``: the fingerprint, size and digest of its shingle set."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            sets = [shingle_set(x, settings) for x in column("x").to_pylist()]
            fps = [fingerprint(s, settings.words).view(np.int64).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [column("k"), column("id"), pa.array(fps, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_of(s) for s in sets], pa.binary())],
                names=["k", "id", "fp", "shingles", "same"],
            )

    return rows.mapInArrow(run, "k binary, id bigint, fp array<bigint>, shingles bigint, same binary")


def similar_links(sets: list[np.ndarray], side: list[int], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least ``similarity``; side 0 meets side 1, or itself (side 2).

    Two sets so similar share one of the rarest shingles of each, of which a set
    lists all but those that it may have alone.
    """
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    listed: dict[int, list[list[int]]] = {}
    root = list(range(len(sets)))
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(sets):
        alone = math.floor(len(own) * (1 - similarity) + 1e-9) + 1
        rare = own[np.lexsort((own, counts[np.searchsorted(values, own)]))[:alone]].tolist()
        met = {j for h in rare for k, rows in enumerate(listed.get(h, ())) if side[i] == 2 or k != side[i] for j in rows}
        for j in sorted(met):
            a, b = top(i), top(j)
            if a == b or min(len(own), len(sets[j])) < similarity * max(len(own), len(sets[j])) - 1e-9:
                continue
            both = len(np.intersect1d(own, sets[j], assume_unique=True))
            if both >= similarity * (len(own) + len(sets[j]) - both) - 1e-9:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
        for h in rare:
            listed.setdefault(h, [[], []])[side[i] == 1].append(i)
    return links


def _verify(similarity: float):
    """mapInArrow over rows (bucket, part, side, rep, hashes) that are sorted by bucket and part: links (a, b)."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        found = similar_links([x for *_, x in held], [s for s, _, _ in held], similarity) if len(held) > 1 else []
        ends = [pa.array([held[pair[k]][1] for pair in found], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            buckets, parts, sides, reps, hashes = get("bucket"), get("part"), get("side"), get("rep"), get("hashes")
            for k in range(batch.num_rows):
                here = buckets[k].as_py(), parts[k].as_py()
                if here != at:
                    if held:
                        yield links(held)
                    at, held = here, []
                held.append((sides[k].as_py(), reps[k].as_py(), hashes[k].values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
        if held:
            yield links(held)

    return run


def verified(rows: DataFrame, classes: DataFrame, groups: DataFrame, settings: SimHashSettings) -> DataFrame:
    """Links (a, b) between classes of one candidate group whose shingle sets are similar enough.

    The sets come from the whole text of one row of each class. A large group is
    cut into chunks, and every pair of chunks is a task of its own.
    """
    small_batches(rows.sparkSession)
    members = checkpointed(classes.join(groups, "node").select(F.col("node").alias("rep"), "k", "shingles", F.col("component").alias("bucket")))
    parts = chunked(members.drop("k"), VERIFIED_SHINGLES, F.greatest("shingles", F.lit(LEAST_SHINGLES))).select("rep", "bucket", "part", "side")

    def run(batches):
        for reps, texts in rows_of(batches, "rep", "x"):
            sets = [shingle_set(x, settings) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "hashes"])

    wanted = members.select("k", "rep")
    texts = maybe_wanted(rows.select("k", "x"), wanted, "k").join(wanted, "k").dropDuplicates(["rep"])
    sets = texts.select("rep", "x").mapInArrow(run, "rep bigint, hashes array<bigint>")
    met = parts.join(sets, "rep").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return met.select("bucket", "part", "side", "rep", "hashes").mapInArrow(_verify(settings.similarity), "a bigint, b bigint").distinct()


def similar_rows(docs: DataFrame, settings: SimHashSettings = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, id, group`` of the rows that have a near duplicate, repeats of one row included; ``k`` as ``row_key``.

    Fingerprints choose the candidates and whole shingle sets decide. Texts with equal
    sets, those without words among them, are linked.
    """
    rows = docs.select(row_key(F.col(key), F.col(text)).alias("k"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("x"))
    prints = written(set_prints(rows, settings))
    classes = numbered(prints.groupBy("same", "shingles", "fp").agg(F.min("k").alias("k"), F.count("*").alias("n")))
    groups = components(linked(classes.select(F.col("node").alias("rep"), "fp"), settings, classes.count()))
    found = components(verified(rows, classes, groups, settings))
    named = classes.join(found, "node", "left").filter((F.col("n") > 1) | F.col("component").isNotNull())
    return prints.select("k", "id", "same").join(named.select("same", F.coalesce("component", "node").alias("group")), "same").select("k", "id", "group")


def similar_documents(docs: DataFrame, settings: SimHashSettings = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, component_id`` of the rows of ``docs`` that have a near duplicate: the smallest id of each group of them. Else as ``near_duplicates``."""
    rows = checkpointed(similar_rows(docs, settings, key, text))
    least = rows.groupBy("group").agg(F.min("id").alias("component_id"))
    return rows.join(least, "group").select("id", "component_id")


def one_of_each(docs: DataFrame, settings: SimHashSettings = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest id, null last, and of rows with one id the least ``row_key``.

    All columns stay. Rows are told apart by id and text, so a row whose id is also
    that of a removed one stays. Only rows that may go or be repeated are shuffled.
    """
    rows = checkpointed(similar_rows(docs, settings, key, text))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "k")).alias("first"))
    each = rows.groupBy("k", "group").agg(F.count("*").alias("n")).join(first, "group")
    touched = checkpointed(each.select("k", (F.col("k") == F.col("first.k")).alias("stays"), "n").filter("n > 1 or not stays"))
    columns = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), row_key(F.col(key), F.col(text)).alias("k"))
    marked = maybe_wanted_mark(keyed, touched, "k", "maybe")
    met = marked.filter("maybe").join(touched.select("k", "stays"), "k", "left").filter("coalesce(stays, true)")
    place = F.row_number().over(Window.partitionBy("k").orderBy("stays"))
    once = met.withColumn("place", F.when(F.col("stays"), place).otherwise(1)).filter("place = 1")
    return marked.filter("not maybe").select("row.*").unionByName(once.select("row.*"))
