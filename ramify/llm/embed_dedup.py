"""Operator 8: near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected at random to eight dimensions, scaled and decoded to
the nearest point of the E8 lattice; the point is the bucket. Several tables have
projections of their own. A vector is a member of its own cell and a visitor of
the nearest neighbouring cells, and is compared with the members there by cosine
in double precision, so no pair below the bound is linked.

Equal vectors are one class with a count. A pair may meet in several buckets; it
is counted in the first one only, which every task can tell by itself, so pairs
are never written out: a bucket reports counts for each vector and a spanning
forest. Large buckets are cut into chunks, each pair of chunks a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, small_batches, written
from .components import components
from .simhash import chunked, forest, lowest
from .vectors import by_length, matrix, usable, valid

#: Least cosine of a link.
COSINE = 0.95
#: Rows of a bucket that meet in one task.
CHUNK = 1024
#: Products in single rounding differ from the cosine by less than this; what is within it is computed exactly.
MARGIN = 1e-9
#: Pairs whose vectors or cells are gathered at a time: a bucket of near copies lists a million.
PAIRS = 1 << 14


@dataclass(frozen=True)
class LatticeSettings:
    """``tables``, lattice ``points`` that make a cell, ``scale`` before decoding, neighbouring cells ``visited``.

    The same at every size. Of random pairs at cosine 0.95 over 99 % are found, at
    0.98 all. Cells of two points hold few vectors that aren't alike.
    """

    tables: int = 8
    points: int = 2
    scale: float = 4.0
    visited: int = 3
    seed: int = 8


DEFAULT = LatticeSettings()


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of 1/2 or -1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole entries of an even sum: round, and where the sum is odd round the worst entry the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    off = x - near
    worst = np.abs(off).argmax(axis=1)[odd]
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the better of the whole and the half-integer coset."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@lru_cache(maxsize=8)
def _projections(settings: LatticeSettings, dim: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    draw = np.random.default_rng((settings.seed, dim))
    bases = []
    for _ in range(settings.tables * settings.points):
        g = draw.normal(size=(dim, 8))
        bases.append(np.linalg.qr(g)[0] * (8 / min(dim, 8)) ** 0.5 if dim >= 8 else g / np.linalg.norm(g, axis=0))
    mix = draw.integers(1, 2**62, 8 * settings.points + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return bases, e8_roots(), mix


def cells(unit: np.ndarray, settings: LatticeSettings) -> np.ndarray:
    """Hashes of (rows, tables, 1 + visited) cells; the first of each table is the vector's own."""
    bases, roots, mix = _projections(settings, unit.shape[1])
    b = settings.points
    scale = settings.scale * (unit.shape[1] / 64) ** 0.5  # a projection keeps 8 / dim of a squared length
    out = np.empty((len(unit), settings.tables, 1 + settings.visited), np.int64)
    rows = np.arange(len(unit))
    for t in range(settings.tables):
        own, closeness = [], []
        for k in range(b):
            y = scale * (unit @ bases[t * b + k])
            c = nearest_e8(y)
            own.append(c)
            closeness.append((y - c) @ roots.T)
        base, close = np.hstack(own), np.hstack(closeness)
        nearest = np.argsort(-close, axis=1, kind="stable")[:, : settings.visited]
        for v in range(1 + settings.visited):
            point = base.copy()
            if v:
                step = nearest[:, v - 1]
                for k in range(b):
                    here = step // len(roots) == k
                    point[here, 8 * k : 8 * k + 8] += roots[step[here] % len(roots)]
            whole = (2 * point).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                h = (whole * mix[:-1]).sum(axis=1, dtype=np.uint64) + np.uint64(t + 1) * mix[-1] + np.uint64(unit.shape[1])
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            out[rows, t, v] = h.view(np.int64)
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which each pair of cell rows (pairs, tables, 1 + visited) counts."""
    pairs = np.arange(len(a))
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    at_b = (a == own_b[:, :, None]).any(axis=2)  # a is at home in b's cell or visits it
    at_a = (b == own_a[:, :, None]).any(axis=2)
    t = (at_a | at_b).argmax(axis=1)
    x, y = own_a[pairs, t], own_b[pairs, t]
    both = at_a[pairs, t] & at_b[pairs, t]
    return np.where(both, np.minimum(x, y), np.where(at_b[pairs, t], y, x))


def _compare(settings: LatticeSettings, cosine: float):
    """mapInArrow over rows (bucket, part, side, visitor, rep, n, vec) sorted by bucket and part."""

    def group(bucket: int, side, visitor, rep, n, vec):
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right) or visitor.all():
            return None
        unit = vec / np.sqrt((vec**2).sum(axis=1))[:, None]
        near = unit[left] @ unit[right].T >= cosine - MARGIN
        near &= ~(visitor[left][:, None] & visitor[right][None, :])
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        keep = (i < j) | ((side[i] == 0) & (i != j))
        i, j = i[keep], j[keep]
        keep = rep[i] != rep[j]
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        exact = np.concatenate([(unit[i[s : s + PAIRS]] * unit[j[s : s + PAIRS]]).sum(axis=1) >= cosine for s in range(0, len(i), PAIRS)])
        i, j = i[exact], j[exact]
        if not len(i):
            return None
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        own = cells(unit[used], settings)
        a, b = at[: len(i)], at[len(i) :]
        root = forest(len(used), a, b)
        moved = np.flatnonzero(root != np.arange(len(used)))
        first = np.concatenate([_first_meeting(own[a[s : s + PAIRS]], own[b[s : s + PAIRS]]) for s in range(0, len(a), PAIRS)])
        counts = np.zeros(len(used), np.int64)
        mine = first == bucket
        np.add.at(counts, a[mine], n[j[mine]])
        np.add.at(counts, b[mine], n[i[mine]])
        some = np.flatnonzero(counts)
        return rep[used[moved]], rep[used[root[moved]]], rep[used[some]], counts[some]

    def result(found):
        a = np.concatenate([np.concatenate([f[0], f[2]]) for f in found])
        b = pa.array(np.concatenate([np.concatenate([f[1], np.zeros_like(f[2])]) for f in found]), pa.int64())
        n = np.concatenate([np.concatenate([np.zeros_like(f[0]), f[3]]) for f in found])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches):
        held: list[tuple] = []

        def ready(last: bool):
            nonlocal held
            if not held:
                return
            columns = [np.concatenate([h[k] for h in held]) for k in range(7)]
            bucket, part = columns[:2]
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            cut = len(bucket) if last else (int(change[-1]) if len(change) else 0)
            held = [] if cut == len(bucket) else [tuple(c[cut:] for c in columns)]
            start, found = 0, []
            for end in [*change[change < cut].tolist(), cut]:
                if end - start > 1 and (f := group(int(bucket[start]), *(c[start:end] for c in columns[2:]))):
                    found.append(f)
                start = end
            if found:
                yield result(found)

        waiting, dim = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            new = (*(get(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "side", "visitor", "rep", "n")), matrix(get("vec")))
            if held and new[6].shape[1] != dim:
                yield from ready(last=True)
            dim = new[6].shape[1]
            held.append(new)
            waiting += batch.num_rows
            if waiting >= 16384:
                yield from ready(last=False)
                waiting = 0
        yield from ready(last=True)

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, settings: LatticeSettings = DEFAULT) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Vectors that are null, empty or zero or hold null or non-finite components, and
    rows without an id, have no links and are their own component. Vectors of other
    lengths never link. Repeated rows count each. An empty table gives none.
    """
    small_batches(df.sparkSession)
    rows = valid(df, key, vector)
    classes = numbered(rows.groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("n")), "rep")

    def hashed(batches):
        for batch in batches:
            for reps, vec in by_length(batch.column(0), batch.column(1)):
                own = cells(vec / np.sqrt((vec**2).sum(axis=1))[:, None], settings).reshape(len(vec), -1)
                yield pa.RecordBatch.from_arrays([reps, pa.array(list(own), pa.list_(pa.int64()))], names=["rep", "cells"])

    keys = classes.select("rep", "vec").mapInArrow(hashed, "rep bigint, cells array<bigint>")
    met = written(keys.select("rep", F.posexplode("cells").alias("k", "bucket")).select("bucket", "rep", (F.col("k") % (1 + settings.visited) != 0).alias("visitor")))
    # a bucket of one, or of visitors only, has nothing to compare; vectors are fetched for what is left
    shared = met.groupBy("bucket").agg(F.count("*").alias("met"), F.bool_and("visitor").alias("visited")).filter("met > 1 and not visited").select("bucket")
    both = chunked(checkpointed(met.join(shared, "bucket")), CHUNK).join(classes.select("rep", "n", "vec"), "rep").withColumn("size", F.size("vec"))
    dealt = both.repartition("bucket", "part").sortWithinPartitions("size", "bucket", "part").select("bucket", "part", "side", "visitor", "rep", "n", "vec")
    found = checkpointed(dealt.mapInArrow(_compare(settings, cosine), "a bigint, b bigint, n bigint"))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    lows = lowest(classes.select(F.col("rep").alias("node"), "low"), components(found.filter("n = 0").select("a", "b")), "low")
    groups = lows.select(F.col("node").alias("rep"), F.col("low").alias("component"))
    named = classes.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id")
    )
    linked = rows.join(named, "vec").select(F.col("id").alias(key), "n_links", "component_id")
    alone = df.filter(F.col(key).isNull() | ~usable(F.col(vector))).select(
        F.col(key).cast("bigint").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col(key).cast("bigint").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
