"""Connected components of link tables: forests of partitions, then alternating large-star and small-star steps.

Each partition first folds its links into the forest that they span, which any
dealing of the links allows. What one partition holds is then done; for more,
every step is a grouped minimum and a join, so a component of any size is spread
over all tasks; nothing is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Steps after which the search gives up with an error; they grow with the log of the longest chain.
MOST_STEPS = 60
#: Links that one partition holds.
PARTITION_LINKS = 1 << 16
#: Links that a task holds while it folds them; forests of half as many leave it, and it begins anew.
HELD_LINKS = 1 << 20


def forest(n: int, x: np.ndarray, y: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest linked position for each of n positions, by hooking and pointer jumping; ``root`` holds earlier links."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not (new == (jump := new[new])).all():
            new = jump
        if (new == root).all():
            return root
        root = new


def _folded(held: int):
    """mapInArrow over links (a, b): each node with the smallest one that the task's links reach from it."""

    def fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(nodes), at[: len(a)], at[len(a) :])
        moved = root != np.arange(len(nodes))
        return nodes[moved], nodes[root[moved]]

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= held:
                parts = [fold(parts)]
                n = len(parts[0][0])
                if n > held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["a", "b"])
                    parts, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in fold(parts)], names=["a", "b"])

    return run


def _fold(links: DataFrame, held: int = HELD_LINKS) -> DataFrame:
    return links.select("a", "b").mapInArrow(_folded(held), "a bigint, b bigint")


def _pairs(links: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) of the named columns."""
    out = links.select(F.col(pairs[0][0]).alias("a"), F.col(pairs[0][1]).alias("b"))
    for x, y in pairs[1:]:
        out = out.union(links.select(F.col(x).alias("a"), F.col(y).alias("b")))
    return out


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (a, b) with a > b."""
    around = _pairs(links, ("a", "b"), ("b", "a")) if large else links
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = around.join(least, "a")
    moved = _pairs(joined.filter("b > a"), ("b", "m")) if large else _pairs(joined, ("b", "m"), ("a", "m"))
    return moved.filter("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", partition_links: int = PARTITION_LINKS) -> DataFrame:
    """``node, component`` for every linked node; the component is its smallest node.

    Direction, repeats and self-links don't matter; null ends are ignored. Nodes
    without links have no row. No links: no rows.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    least, most = F.least(x, y).alias("b"), F.greatest(x, y).alias("a")
    now = checkpointed(_fold(links.filter(x != y).select(most, least).distinct()))
    state = None
    for _ in range(MOST_STEPS):
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        small = seen[0] <= partition_links
        if small or seen == state:
            done = checkpointed(_fold(now.coalesce(1))) if small else now
            return _pairs(done, ("a", "b"), ("b", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen
        now = checkpointed(_fold(_star(_star(now, True), False)))
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
