"""MinT reconciliation with a shrunk covariance of known errors.

All nodes' errors at an origin are needed together. A task holds one step and a
block of origins, with the origins before it whose errors it may know.

No matrix of nodes by nodes is made. The shrunk covariance is a diagonal and as many
columns as errors are known; the condition that children sum to their parent links
only neighbours in the tree, so it is solved along the tree; and the columns enter
by Woodbury's identity. Work and memory grow with nodes times known errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Schedule, level_index
from .conformal import first_valid_origin, horizon_lag, ranks

RIDGE = 2e-8
#: Origins that one task reconciles.
BLOCK = 64


def shrunk_covariance(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of error rows (..., n, nodes) shrunk to its diagonal by the Schaefer-Strimmer intensity, with a small ridge."""
    n = errors.shape[-2]
    if n < 2:
        raise ValueError("errors of one origin have no covariance")
    x = errors - errors.mean(axis=-2, keepdims=True)
    across = lambda a, b: np.matmul(np.swapaxes(a, -1, -2), b)
    cov = across(x, x) / (n - 1)
    diagonal = np.diagonal(cov, axis1=-2, axis2=-1)
    if not (diagonal > 0).all():
        raise ValueError("some node is forecast with the same error each time")
    z = x / np.sqrt(diagonal)[..., None, :]
    total, squares = across(z, z), across(z**2, z**2)
    off = 1 - np.eye(errors.shape[-1])
    spread = (n / (n - 1) ** 3 * (squares - total**2 / n) * off).sum(axis=(-1, -2))  # variances of the correlations
    below = ((total / (n - 1) * off) ** 2).sum(axis=(-1, -2))
    intensity = np.clip(np.where(below > 0, spread / np.where(below > 0, below, 1.0), 1.0), 0.0, 1.0)
    kept = 1 - intensity[..., None, None] * off
    return cov * kept + RIDGE * np.eye(errors.shape[-1]), intensity


def projection(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """S (S' W^-1 S)^-1 S' W^-1 for each matrix W: the projection on coherent vectors."""
    ws = np.linalg.solve(w, np.broadcast_to(s, (*w.shape[:-2], *s.shape)))
    return s @ np.linalg.solve(s.T @ ws, np.swapaxes(ws, -1, -2))


class Tree:
    """Nodes of a hierarchy, parents before their children and leaves last, with each node's parent (-1 for the root)."""

    def __init__(self, pairs: list[tuple[str, str]]):
        above: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for node, leaf in pairs:
            above.setdefault(leaf, []).append(node)
            size[node] = size.get(node, 0) + 1
        leaves = sorted(above)
        parent: dict[str, str] = {}
        for leaf, own in above.items():
            # from the leaf up; of two that hold the same leaves, the longer path is below
            chain = [leaf, *sorted((n for n in own if n != leaf), key=lambda n: (size[n], -len(n), n))]
            parent |= dict(zip(chain, chain[1:], strict=False))
        depth: dict[str, int] = {}

        def down(node: str) -> int:
            if node not in depth:
                depth[node] = down(parent[node]) + 1 if node in parent else 0
            return depth[node]

        inner = sorted(set(size) - set(leaves), key=lambda n: (down(n), n))
        self.names, self.inner, self.leaves = inner + leaves, len(inner), len(leaves)
        at = {n: k for k, n in enumerate(self.names)}
        self.parent = np.array([at[parent[n]] if n in parent else -1 for n in self.names])
        self.below = self.parent >= 0
        # inner nodes but the root, by depth, the deepest first
        levels = np.array([down(n) for n in inner])
        self.levels = [np.flatnonzero((levels == d) & self.below[: len(inner)]) for d in range(levels.max(initial=0), 0, -1)]

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Each inner node's value less the sum of its children's (rows are nodes)."""
        out = x[: self.inner].copy()
        np.subtract.at(out, self.parent[self.below], x[self.below])
        return out

    def spread(self, y: np.ndarray) -> np.ndarray:
        """The transpose of ``gaps``."""
        out = np.zeros((len(self.names), *y.shape[1:]))
        out[: self.inner] = y
        out[self.below] -= y[self.parent[self.below]]
        return out

    def sums(self, leaves: np.ndarray) -> np.ndarray:
        """All nodes' values from those of the leaves."""
        out = np.concatenate([np.zeros((self.inner, *leaves.shape[1:])), leaves])
        np.add.at(out, self.parent[self.inner :][self.below[self.inner :]], leaves[self.below[self.inner :]])
        for level in self.levels:
            np.add.at(out, self.parent[level], out[level])
        return out

    def solve(self, d: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``x`` with ``gaps(d * spread(x)) = y``: elimination from the deepest nodes to the root and back."""
        pivot = d[: self.inner].copy()
        np.add.at(pivot, self.parent[self.below], d[self.below])
        x = y.copy()
        for level in self.levels:
            up = self.parent[level]
            np.subtract.at(pivot, up, d[level] ** 2 / pivot[level])
            np.add.at(x, up, (d[level] / pivot[level])[:, None] * x[level])
        root = np.flatnonzero(~self.below[: self.inner])
        x[root] /= pivot[root][:, None]
        for level in reversed(self.levels):
            x[level] = (x[level] + d[level][:, None] * x[self.parent[level]]) / pivot[level][:, None]
        return x


def shrinkage(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The matrix of ``shrunk_covariance`` of (n, nodes) errors as a diagonal and columns (nodes, n), and the intensity.

    Sums over all pairs of nodes come from the n by n products of the errors.
    """
    n = len(errors)
    if n < 2:
        raise ValueError("errors of one origin have no covariance")
    x = errors - errors.mean(axis=0)
    variance = (x**2).sum(axis=0) / (n - 1)
    if not (variance > 0).all():
        raise ValueError("some node is forecast with the same error each time")
    z = x / np.sqrt(variance)
    own = (z**2).sum(axis=0)
    pairs = ((z @ z.T) ** 2).sum() - (own**2).sum()
    squares = ((z**2).sum(axis=1) ** 2).sum() - (z**4).sum()
    below = pairs / (n - 1) ** 2
    intensity = float(np.clip(n / (n - 1) ** 3 * (squares - pairs / n) / below, 0.0, 1.0)) if below > 0 else 1.0
    return intensity * variance + RIDGE, np.sqrt((1 - intensity) / (n - 1)) * x.T, intensity


def coherent_paths(tree: Tree, base: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Projected base (nodes) and base plus each error (nodes, n), by the covariance of the errors; the intensity; by how much paths missed their sums.

    What the projection misses by rounding is mended from the leaves up.
    """
    d, u, intensity = shrinkage(errors)
    columns = np.column_stack([base, base[:, None] + errors.T])
    v = tree.gaps(u)
    solved = tree.solve(d, np.column_stack([tree.gaps(columns), v]))
    first, through = solved[:, : columns.shape[1]], solved[:, columns.shape[1] :]
    x = first - through @ np.linalg.solve(np.eye(v.shape[1]) + v.T @ through, v.T @ first)
    out = columns - d[:, None] * tree.spread(x) - u @ (v.T @ x)
    missed = float(np.abs(tree.gaps(out[:, 1:])).max(initial=0))
    out = tree.sums(out[tree.inner :])
    return out[:, 0], out[:, 1:], intensity, missed


def reconcile(forecasts: DataFrame, edges: DataFrame, schedule: Schedule, window: int = 52, levels=()) -> DataFrame:
    """``origin, node, step, median, q, intensity, coherence, negative``: reconciled medians and, on ``levels``, quantiles of reconciled paths.

    Rows need ``origin, node, step, point, y`` with every node. Paths are the base
    plus each known error vector, projected; neither medians nor paths are floored.
    Origins without a full window have no rows.
    """
    tree = Tree([(r["node"], r["leaf"]) for r in edges.select("node", "leaf").collect()])  # three a leaf: the hierarchy itself
    names, chosen, first = tree.names, np.array(ranks(levels, window), int), first_valid_origin(schedule, window)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        step, block = int(rows["step"].iloc[0]), int(rows["block"].iloc[0])
        lag = horizon_lag(step, schedule.step)
        wide = rows.pivot(index="origin", columns="node", values=["point", "y"]).sort_index()
        base = wide["point"][names].to_numpy(float)
        errors = wide["y"][names].to_numpy(float) - base
        origins = wide.index.to_numpy()
        own = np.flatnonzero((origins >= max(first, block * BLOCK)) & (origins < (block + 1) * BLOCK))
        out = [pd.DataFrame(columns=["origin", "node", "step", "median", "q", "intensity", "coherence", "negative"])]
        for at in own:
            median, paths, intensity, breach = coherent_paths(tree, base[at], errors[at + 1 - lag - window : at + 1 - lag])
            q = np.sort(paths, axis=1)[:, chosen]
            out.append(pd.DataFrame({"origin": origins[at], "node": names, "step": step, "median": median, "q": list(q), "intensity": intensity, "coherence": breach, "negative": (paths < 0).mean()}))
        return pd.concat(out[1:] or out)

    schema = "origin int, node string, step int, median double, q array<double>, intensity double, coherence double, negative double"
    reach = window + horizon_lag(schedule.horizon, schedule.step)  # origins that may know an origin's error
    serves = F.explode(F.sequence(F.floor(F.col("origin") / BLOCK), F.floor((F.col("origin") + reach) / BLOCK))).alias("block")
    rows = forecasts.select("origin", "node", "step", "point", "y", serves)
    return rows.groupBy("step", "block").applyInPandas(run, schema)


def shift_quantiles(q: Column, old: Column, new: Column) -> Column:
    """Quantiles moved with their median, floored at 0."""
    return F.transform(q, lambda x: F.greatest(x + (new - old), F.lit(0.0)))


def reconciled_quantiles(forecasts: DataFrame, edges: DataFrame, schedule: Schedule, levels, window: int = 52) -> DataFrame:
    """``model, origin, node, step, q``: a model's own quantiles, moved with its medians when those are reconciled.

    Rows need ``model, origin, node, step, q, y`` with every node; each model is
    reconciled by itself. Origins without a full window have no rows.
    """
    middle = F.element_at("q", level_index(levels, 0.5) + 1)
    out = None
    for model in [r["model"] for r in forecasts.select("model").distinct().orderBy("model").collect()]:
        own = forecasts.filter(F.col("model") == model).withColumn("point", middle)
        new = reconcile(own, edges, schedule, window).select("origin", "node", "step", "median")
        moved = own.join(new, ["origin", "node", "step"]).select("model", "origin", "node", "step", shift_quantiles(F.col("q"), F.col("point"), F.col("median")).alias("q"))
        out = moved if out is None else out.unionByName(moved)
    return out
