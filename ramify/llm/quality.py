"""Operator 6: quality by a sparse ensemble of rules.

Statistics of a text are Spark columns. On a bounded sample of labelled rows
small boosted trees are grown; every path from a root to a node becomes a
conjunctive rule over the statistics, a lasso logistic regression keeps few of
the rules, and the kept ones are compiled into one Spark column expression.
Scoring runs in the JVM only, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import FIT_ROWS, held_out, labelled_sample, logistic, sigmoid

#: Boosted trees, their depth, candidate cuts for each statistic, rows in a leaf at least, and the learning rate.
TREES, DEPTH, CUTS, LEAF_ROWS, RATE = 24, 3, 48, 8, 0.4
#: Weight of the lasso.
LASSO = 8e-4
#: Documents scoring at least this are predicted good.
GOOD_AT = 0.3


def parts(text: Column) -> dict[str, Column]:
    """The text (empty for null), its words and its lines that aren't blank, which several statistics share."""
    t = F.coalesce(text, F.lit(""))
    return {"text": t, "words": F.filter(F.split(t, r"\s+"), lambda w: w != ""), "lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")}


def statistics(part: dict[str, Column]) -> dict[str, Column]:
    """Statistics of a text by name, from its ``parts``; every value is defined for an empty one."""
    t, words, lines = part["text"], part["words"], part["lines"]
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)).cast("double"), F.greatest(F.size(lines), F.lit(1)).cast("double")

    def share_of(signs: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, signs, ""))) / chars

    return {
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.replace(t, F.lit(" "))) / n_words,
        "lines": F.log1p(F.size(lines).cast("double")),
        "words_a_line": F.log1p(n_words / n_lines),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "capitals": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))) / chars,
        "other_signs": F.length(F.regexp_replace(t, r"[\p{L}\p{M}\s.,]+", "")) / chars,
        "digits": share_of("0123456789"),
        "stops": share_of("."),
        "commas": share_of(","),
        "exclamations": share_of("!?"),
        "symbols": share_of("#$%&*@^~+=<>{}[]\\"),
        "bars": share_of("|_-/"),
        "brackets": share_of("()\"';:"),
        "ends_with_stop": F.when(F.rtrim(t).rlike(r"[.!?…\"')]$"), 1.0).otherwise(0.0),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is over, cut)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, over, cut in self.conditions:
            out = out & (values[name] > cut if over else values[name] <= cut)
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, over, cut in self.conditions:
            value = x[:, names.index(name)]
            out &= value > cut if over else value <= cut
        return out


@dataclass(frozen=True)
class QualityModel:
    """The intercept and the kept rules with their weights."""

    intercept: float = 0.0
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(values), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, names: list[str]) -> list[tuple[tuple, np.ndarray, float]]:
    """Every node of one least-squares tree but the root: conditions, its rows, and (for leaves) their mean."""
    nodes = []

    def split(rows: np.ndarray, conditions: tuple, depth: int) -> None:
        best = (1e-9, None, None)
        r = residual[rows]
        base = r.sum() ** 2 / len(r)
        for k, own in enumerate(cuts):
            if not len(own):
                continue
            at = np.searchsorted(own, x[rows, k], side="left")  # value <= own[j] exactly where at <= j
            n = np.bincount(at, minlength=len(own) + 1)[:-1].cumsum()
            s = np.bincount(at, weights=r, minlength=len(own) + 1)[:-1].cumsum()
            m = len(r) - n
            ok = (n >= LEAF_ROWS) & (m >= LEAF_ROWS)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(m, 1) - base, -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], k, float(own[j]))
        _, k, cut = best
        if depth == DEPTH or k is None:
            if conditions:
                nodes.append((conditions, rows, float(r.mean())))
            return
        if conditions:
            nodes.append((conditions, rows, np.nan))
        over = x[rows, k] > cut
        split(rows[~over], (*conditions, (names[k], False, cut)), depth + 1)
        split(rows[over], (*conditions, (names[k], True, cut)), depth + 1)

    split(np.arange(len(x)), (), 0)
    return nodes


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> QualityModel:
    """Grow the trees, extract their rules and keep those that the lasso gives a weight."""
    if not len(y) or y.min() == y.max():
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.005, 0.995, CUTS))) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = sigmoid(z)
        for conditions, rows, mean in _grow(x, cuts, y - p, names):
            rules.setdefault(Rule(conditions))
            if not np.isnan(mean):
                z[rows] += RATE * mean / max(float((p[rows] * (1 - p[rows])).mean()), 0.02)
    kept = list(rules)
    if not kept:  # too few rows for a split: the labels' share alone
        return QualityModel(float(np.log(y.mean() / (1 - y.mean()))))
    held = np.column_stack([r.holds(x, names) for r in kept]).astype(float)
    intercept, weights = logistic(held, y, l1=LASSO, steps=1500)
    return QualityModel(intercept, tuple((r, round(float(w), 6)) for r, w in zip(kept, weights, strict=True) if abs(w) > 1e-4))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> QualityModel:
    """Learn from ``labels.quality`` of rows that aren't held out; only statistics of at most ``rows`` texts reach the driver."""
    sample = labelled_sample(docs, labels, "quality", key, rows)
    values = statistics({n: F.col(n) for n in parts(F.col("text"))})
    cut = sample.select("label", *(c.alias(n) for n, c in parts(F.col("text")).items()))
    seen = cut.select(*(c.alias(n) for n, c in values.items()), "label").toPandas()
    names = list(values)
    seen = seen.sort_values([*names, "label"])  # sums in one order give one model
    return fit_rules(seen[names].to_numpy(float), seen["label"].to_numpy(float), names)


def score(docs: DataFrame, model: QualityModel, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, from 0 to 1. A null text counts as empty; repeated rows stay."""
    # the row travels as one column, so that its names meet none of these
    kept = [c for c in docs.columns if c != column]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    cut = docs.select(row, *(c.alias(n) for n, c in parts(F.col(f"`{text}`")).items()))  # a projection of its own, so that a text is split once
    stats = statistics({n: F.col(n) for n in cut.columns if n != "row"})
    inner = cut.select("row", F.struct(*(c.alias(n) for n, c in stats.items())).alias("statistics"))
    return inner.select(*(F.col(f"row.`{c}`") for c in kept), model.score({n: F.col(f"statistics.{n}") for n in stats}).alias(column))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every document, by a model fitted on rows that aren't held out."""
    rows = score(docs.select(key, "text"), fit(docs, labels, key))
    return rows.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))
