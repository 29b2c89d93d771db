"""Operator 3: approximate nearest neighbours by inner product.

Equal vectors become one class. Classes are dealt into shards by hash; every
shard builds a hierarchical navigable small-world graph of its own, kept as flat
neighbour arrays, and the shards are written as a table. Each (shard, block of
queries) is a task: it reads the shard once and streams its queries through it.
The shards' results are merged by exact scores. Indexing covers every row; the
query set is a fixed share of rows.

A shard has as many rows as make one shard for each core of the cluster, within
bounds, so that queries times shards grow with the rows and not with their
square until the upper bound is reached.

Inner products become distances by one more coordinate: with R the shard's
largest norm, x gets sqrt(R^2 - |x|^2) and a query 0, so the nearest by distance
is the largest by product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written
from .vectors import element_type, matrix, valid


@dataclass(frozen=True)
class HnswSettings:
    """``links`` of a node on upper layers (twice as many at the bottom), candidates kept while building and searching.

    ``least_rows`` and ``most_rows`` of a shard; ``query_rows``: queries that one
    task sends through a shard, at most.
    """

    links: int = 16
    build: int = 96
    search: int = 160
    least_rows: int = 1024
    most_rows: int = 1 << 14
    query_rows: int = 1 << 16
    seed: int = 3


DEFAULT = HnswSettings()

#: Nodes whose neighbours are found by comparing all, before the graph carries searches.
FIRST = 64
#: Searches that run side by side, and the most marks of visited nodes that they may hold.
SIDE_BY_SIDE, VISITED = 256, 1 << 23
#: Candidates expanded at a time in each search.
EXPANDED = 4
#: Partitions that (shard, block) tasks are dealt to, or sixteen for each core.
MOST_PARTS = 4096


class Hnsw:
    """A graph over the rows of a matrix, by Euclidean distance.

    Nodes are numbered by falling level, so layer k holds the first ``sizes[k]``
    nodes. A layer is one flat array: row i has node i's neighbours, -1 where there
    are fewer. Searches run side by side, one numpy step for all of them.
    """

    def __init__(self, vectors: np.ndarray, settings: HnswSettings = DEFAULT, layers: list[np.ndarray] | None = None, order: np.ndarray | None = None):
        self.settings = settings
        n = len(vectors)
        if order is None:
            draw = np.random.default_rng((settings.seed, n))
            levels = np.minimum((-np.log(1 - draw.random(n)) / np.log(settings.links)).astype(np.int64), 8)
            order = np.argsort(-levels, kind="stable").astype(np.int32)
            sizes = [int((levels >= k).sum()) for k in range(int(levels.max()) + 1)] if n else []
        else:
            sizes = [len(x) for x in layers]
        #: Row of the matrix by node.
        self.order = order
        self.vectors = np.ascontiguousarray(vectors, np.float64)[order]  # single precision loses small vectors beside large ones
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        if layers is not None:
            self.layers = layers
            return
        self.layers = [np.full((size, settings.links * (1 if k else 2)), -1, np.int32) for k, size in enumerate(sizes)]
        for k in range(len(sizes) - 1, -1, -1):
            self._build(k)

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square, of queries (n, d) and nodes (n, m)."""
        return self.squares[nodes] - 2 * np.matmul(self.vectors[nodes], queries[:, :, None])[:, :, 0]

    def _search(self, queries: np.ndarray, starts: np.ndarray, k: int, keep: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes) of the ``keep`` nearest found on a layer among its first ``upto`` nodes, nearest first; -1 where there are fewer.

        ``starts``: nodes (n, s) to begin from, -1 for none.
        """
        n, layer = len(queries), self.layers[k]
        rows = np.arange(n)[:, None]
        visited = np.zeros((n, upto + 1), bool)  # the last column stands for -1
        visited[:, upto] = True
        beam_d, beam_i = np.full((n, keep), np.inf), np.full((n, keep), -1, np.int64)
        done = np.ones((n, keep), bool)  # expanded, or empty

        def add(at: np.ndarray, nodes: np.ndarray) -> None:
            nodes = np.where((nodes < 0) | (nodes >= upto), upto, nodes)
            nodes = np.where(visited[at[:, None], nodes], upto, nodes)
            if nodes.shape[1] > 1:  # a node may be a neighbour of several expanded ones
                nodes.sort(axis=1)
                nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = upto
            visited[at[:, None], nodes] = True
            d = self._distances(queries[at], np.minimum(nodes, upto - 1))
            d[nodes == upto] = np.inf
            all_d = np.concatenate([beam_d[at], d], axis=1)
            chosen = np.argpartition(all_d, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(all_d, chosen, axis=1)
            inner = np.argsort(best, axis=1)
            chosen = np.take_along_axis(chosen, inner, axis=1)
            beam_d[at] = np.take_along_axis(best, inner, axis=1)
            beam_i[at] = np.take_along_axis(np.concatenate([beam_i[at], np.where(nodes == upto, -1, nodes)], axis=1), chosen, axis=1)
            done[at] = np.take_along_axis(np.concatenate([done[at], nodes == upto], axis=1), chosen, axis=1)

        add(np.arange(n), starts.astype(np.int64))
        while True:
            at = np.flatnonzero(~done.all(axis=1))
            if not len(at):
                return beam_d, beam_i
            open_ = ~done[at]
            taken = open_ & (np.cumsum(open_, axis=1) <= EXPANDED)
            row, column = np.nonzero(taken)
            place = (np.cumsum(taken, axis=1) - 1)[row, column]
            nodes = np.full((len(at), EXPANDED), -1, np.int64)
            nodes[row, place] = beam_i[at][row, column]
            done[at[row], column] = True
            near = np.where(nodes[:, :, None] >= 0, layer[nodes], -1).reshape(len(at), -1)
            add(at, near.astype(np.int64))

    def _spread(self, d: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours (n, most) of candidates (n, m), nearest first, preferring those that lie closer to the node than to one chosen before."""
        n, m = nodes.shape
        own = self.vectors[np.maximum(nodes, 0)]
        squares = self.squares[np.maximum(nodes, 0)]
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
        blocked = np.full((n, m), np.inf)
        chosen, count = np.zeros((n, m), bool), np.zeros(n, np.int64)
        for j in range(m):
            take = (nodes[:, j] >= 0) & (d[:, j] < blocked[:, j]) & (count < most)
            chosen[:, j] = take
            count += take
            np.minimum(blocked, between[:, j], out=blocked, where=take[:, None])
        # the chosen first, then the nearest of the rest
        rank = np.where(chosen, 0, m) + np.arange(m) + np.where(nodes < 0, 4 * m, 0)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(nodes, order, axis=1)

    def _link(self, layer: np.ndarray, new: np.ndarray, near: np.ndarray) -> None:
        """Give nodes ``new`` their neighbours ``near`` (n, m), and those the new nodes in turn."""
        width = layer.shape[1]
        layer[new, : near.shape[1]] = near
        to, source = near.ravel(), np.repeat(new, near.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(ends), int(count.max(initial=0))), -1, np.int64)
        more[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(first, count)] = source
        degree = (layer[ends] >= 0).sum(axis=1)
        fits = degree + count <= width
        spot = np.repeat(degree, count) + np.arange(len(to)) - np.repeat(first, count)
        simple = np.repeat(fits, count)
        layer[to[simple], spot[simple]] = source[simple]
        full = np.flatnonzero(~fits)
        for at in (full[s : s + SIDE_BY_SIDE] for s in range(0, len(full), SIDE_BY_SIDE)):
            nodes = np.concatenate([layer[ends[at]].astype(np.int64), more[at]], axis=1)
            d = self._distances(self.vectors[ends[at]], np.maximum(nodes, 0)) + self.squares[ends[at]][:, None]
            d[nodes < 0] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            layer[ends[at]] = self._spread(np.take_along_axis(d, order, axis=1), np.take_along_axis(nodes, order, axis=1), width)

    def _build(self, k: int) -> None:
        layer, size, settings = self.layers[k], len(self.layers[k]), self.settings
        at = 0
        while at < size:
            stop = min(size, FIRST if not at else at + min(SIDE_BY_SIDE, max(16, at // 4)))
            new = np.arange(at, stop)
            own = self.vectors[new]
            among = self.squares[new][None, :] - 2 * own @ own.T
            among[np.arange(len(new))[:, None] <= np.arange(len(new))[None, :]] = np.inf  # each may take those before it
            keep = min(settings.build, len(new))
            close = np.argsort(among, axis=1, kind="stable")[:, :keep]
            d, nodes = np.take_along_axis(among, close, axis=1), np.where(np.isinf(np.take_along_axis(among, close, axis=1)), -1, close + at)
            if at:
                found_d, found = self._search(own, self._starts(own, k, at), k, settings.build, at)
                d, nodes = np.concatenate([found_d, d], axis=1), np.concatenate([found, nodes], axis=1)
            order = np.argsort(d, axis=1, kind="stable")[:, : settings.build]
            d, nodes = np.take_along_axis(d, order, axis=1) + self.squares[new][:, None], np.take_along_axis(nodes, order, axis=1)
            self._link(layer, new, self._spread(d, nodes, settings.links))
            at = stop

    def _starts(self, queries: np.ndarray, k: int, upto: int) -> np.ndarray:
        """Nodes to begin from on layer ``k``: the nearest found on the layers above that the layer has already."""
        starts = np.zeros((len(queries), 1), np.int64)
        for above in range(len(self.layers) - 1, k, -1):
            found = self._search(queries, starts, above, 8, min(len(self.layers[above]), upto))[1]
            starts = np.where(found < 0, found[:, :1], found)
        return np.concatenate([starts, np.zeros((len(queries), 1), np.int64)], axis=1)

    def search(self, queries: np.ndarray, keep: int) -> np.ndarray:
        """Rows of the matrix (n, keep) that are nearest to each query, nearest first, -1 where there are fewer."""
        n = len(self.vectors)
        out = np.full((len(queries), keep), -1, np.int64)
        if not n:
            return out
        side = max(1, min(SIDE_BY_SIDE, VISITED // n))
        for at in range(0, len(queries), side):
            part = np.ascontiguousarray(queries[at : at + side], np.float64)
            nodes = self._search(part, self._starts(part, 0, n), 0, max(keep, self.settings.search), n)[1][:, :keep]
            out[at : at + side] = np.where(nodes < 0, -1, self.order[nodes])
        return out


def lifted(vec: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that makes largest products nearest distances."""
    squares = (vec**2).sum(axis=1)
    return np.column_stack([vec, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))])


def build_shard(reps: np.ndarray, marks: np.ndarray, only: np.ndarray, vec: np.ndarray, settings: HnswSettings, kind: type = np.float64) -> dict:
    """A shard as flat arrays: keys, vectors (stored as ``kind``) and graph of the classes of one vector length."""
    graph = Hnsw(lifted(vec), settings)
    return {
        "dim": vec.shape[1], "size": len(vec), "reps": reps.tobytes(), "marks": marks.tobytes(), "only": only.tobytes(), "vecs": vec.astype(kind).tobytes(),
        "order": graph.order.tobytes(), "widths": [x.shape[1] for x in graph.layers], "layers": [x.tobytes() for x in graph.layers],
    }


class Shard:
    """A shard read back: exact products of the classes that its graph finds."""

    def __init__(self, row: dict, settings: HnswSettings):
        size, dim = row["size"], row["dim"]
        self.reps, self.marks, self.only = (np.frombuffer(row[c], np.int64) for c in ("reps", "marks", "only"))
        kind = np.float32 if len(row["vecs"]) == 4 * size * dim else np.float64
        self.vec = np.frombuffer(row["vecs"], kind).reshape(size, dim).astype(np.float64)
        layers = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(row["layers"], row["widths"], strict=True)]
        self.graph = Hnsw(lifted(self.vec), settings, layers, np.frombuffer(row["order"], np.int32))

    def nearest(self, ids: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
        """(query id, class by rep and mark, score) of the ``keep`` best for each query; classes that hold nothing but its own id are left out."""
        found = self.graph.search(np.column_stack([queries, np.zeros(len(queries))]), max(keep, self.graph.settings.search))
        use = (found >= 0) & (self.only[found] != ids[:, None])
        row, column = np.nonzero(use)
        score = np.full(found.shape, -np.inf)
        score[row, column] = (self.vec[found[row, column]] * queries[row]).sum(axis=1)
        # the best of all that were found, by exact products; ties to the class that comes first
        order = np.lexsort((found, -score), axis=1)[:, :keep]
        found, score, use = (np.take_along_axis(x, order, axis=1) for x in (found, score, use))
        row, column = np.nonzero(use)
        near = found[row, column]
        return ids[row], self.reps[near], self.marks[near], score[row, column]


_INDEX = "shard bigint, dim bigint, size bigint, reps binary, marks binary, only binary, vecs binary, order binary, widths array<int>, layers array<binary>"
_INDEX_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("dim", pa.int64()), ("size", pa.int64()), *((c, pa.binary()) for c in ("reps", "marks", "only", "vecs", "order")),
     ("widths", pa.list_(pa.int32())), ("layers", pa.list_(pa.binary()))]
)
#: Stands for no id: a class that holds several.
_SEVERAL = -(1 << 63)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _build(settings: HnswSettings, kind: type):
    """mapInArrow over the classes of one shard: a row for each vector length."""

    def run(batches):
        held: dict[int, list[tuple]] = {}
        shard = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = _column(batch, "shard")[0].as_py()
            keys, vecs = [_column(batch, c) for c in ("rep", "mark", "only")], _column(batch, "vec")
            dims = np.diff(vecs.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.flatnonzero(dims == dim))
                held.setdefault(dim, []).append((*(c.take(rows).to_numpy() for c in keys), matrix(vecs.take(rows))))
        for dim in sorted(held):
            reps, marks, only, vec = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.lexsort((marks, reps))
            row = {"shard": shard} | build_shard(reps[order], marks[order], only[order], vec[order], settings, kind)
            yield pa.RecordBatch.from_pylist([row], schema=_INDEX_SCHEMA)

    return run


def _search(settings: HnswSettings, keep: int):
    """mapInArrow over rows sorted by task: a shard's row, then the queries that it answers."""
    names = ("size", "dim", "reps", "marks", "only", "vecs", "order", "widths", "layers")

    def run(batches):
        at, shard = None, None
        for batch in batches:
            tasks, dims, ids = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("task", "dim", "query"))
            is_shard = _column(batch, "reps").is_valid().to_numpy(zero_copy_only=False)
            vecs = _column(batch, "asked")
            change = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(dims) != 0) | is_shard[1:]) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if lo < hi and is_shard[lo]:
                    at, shard = (tasks[lo], dims[lo]), Shard({c: _column(batch, c)[lo].as_py() for c in names}, settings)
                    lo += 1
                if lo < hi and at == (tasks[lo], dims[lo]):
                    found = shard.nearest(ids[lo:hi].astype(np.int64), matrix(vecs.slice(lo, hi - lo)), keep)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "rep", "mark", "score"])

    return run


def nearest(
    df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, settings: HnswSettings = DEFAULT
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows of ``df`` nearest to each row of ``queries``.

    Both tables have the same columns; a row is no candidate for queries of its own
    id. Scores are inner products in double precision; ties go to the smaller id.
    Vectors that are null, empty or zero or hold null or non-finite components take
    no part, and vectors of other lengths are no candidates. Rows that repeat an id
    and its vector are one candidate. A repeated query id counts once, with the
    first of its vectors in array order. Empty tables give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    rows = valid(df, key, vector).groupBy("vec", "id").agg(F.lit(1).alias("one"))
    # of equal vectors only the k + 1 smallest ids can be among a query's nearest
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    grouped = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(grouped.select(F.element_at("ids", 1).alias("rep"), F.xxhash64("vec").alias("mark"), "ids", "vec"))
    n = classes.count()
    asked = written(valid(queries, key, vector).groupBy(F.col("id").alias("query")).agg(F.min("vec").alias("asked")))
    asked_rows = asked.count()
    if not n or not asked_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    shards = -(-n // min(settings.most_rows, max(settings.least_rows, -(-n // cores))))
    only = F.when(F.size("ids") == 1, F.col("rep")).otherwise(F.lit(_SEVERAL))
    dealt = classes.select(F.pmod(F.xxhash64("rep", "mark"), F.lit(shards)).alias("shard"), "rep", "mark", only.alias("only"), "vec")
    kind = np.float32 if element_type(df, vector) == "float" else np.float64
    index = written(dealt.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_build(settings, kind), _INDEX))

    blocks = max(-(-asked_rows // settings.query_rows), -(-2 * cores // shards))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    questions = asked.select("query", "asked", F.size("asked").cast("bigint").alias("dim"), block.alias("block"), each(shards).alias("shard"))
    number = (F.col("shard") * blocks + F.col("block")).alias("task")
    answers = index.withColumn("block", each(blocks))
    both = answers.select(number, "*").drop("shard", "block").unionByName(questions.select(number, "*").drop("shard", "block"), allowMissingColumns=True)
    parts = min(shards * blocks, max(16 * cores, MOST_PARTS))
    streamed = both.repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task", "dim", F.col("reps").isNull(), "query")
    found = streamed.mapInArrow(_search(settings, k + 1), "query_id bigint, rep bigint, mark bigint, score double")

    def best(scored: DataFrame, most: int, *ties: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ties))
        return scored.withColumn("rank", place).filter(F.col("rank") <= most)

    # the best classes of all shards, then the ids that they hold
    members = best(found, k + 1, "rep", "mark").drop("rank").join(classes.select("rep", "mark", "ids"), ["rep", "mark"])
    near = members.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    return best(near, k, "vec_id").select("query_id", "rank", "vec_id", "score")
