"""What the two learned scorers share: the held-out rule and the bounded labelled sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit reads at most; a share of all of them, chosen by a hash of the id.
FIT_ROWS = 16_000


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """``text, label`` of about ``rows`` labelled documents at most that aren't held out.

    The sampled labels are bounded by ``rows``, so they may be broadcast to the
    documents, which needs no shuffle of texts. Null labels and ids are left out,
    and so are ids that are labelled both ways.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).filter(
        F.col("k").isNotNull() & F.col("label").isin(0, 1) & ~held_out("k")
    )
    share = min(1.0, rows / max(known.count(), 1))
    grid = 1 << 20
    sampled = known.filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(grid)) < F.lit(int(share * grid)))
    chosen = sampled.groupBy("k").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    return docs.select(F.col(key).alias("k"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "k").select("text", "label")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, steps: int = 2000) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, p = x.shape
    if not n:
        return 0.0, np.zeros(p)
    ones = np.hstack([np.ones((n, 1)), x])
    step = 1 / (0.25 * np.linalg.norm(ones, 2) ** 2 / n + l2 + 1e-12)
    w = at = np.zeros(p + 1)
    w[0] = at[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    momentum = 1.0
    for _ in range(steps):
        slope = ones.T @ (sigmoid(ones @ at) - y) / n
        slope[1:] += l2 * at[1:]
        new = at - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        at = new + (momentum - 1) / after * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, momentum = new, after
    return float(w[0]), w[1:]
