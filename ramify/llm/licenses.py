"""Operator 12: license notices by diagonal voting.

Every run of ``k`` words of every text is a rolling hash; exploded, they join a
small table of the same hashes of license templates on Spark. A hit votes for the
diagonal (place in the text less place in the template) it lies on. A template that
stands in a text unchanged fills one diagonal; words put in or left out shift the
rest to a diagonal beside it, so diagonals that are near each other are merged into
one span. Spans with enough votes are verified against the text's words: exactly for
phrases, by the longest common subsequence for notices. Where verified spans of
notices overlap, the most alike decides.

Only texts with a span travel for that. One pass over all texts makes hashes and a
row for each text; the templates are a fixed list, so their table is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_wanted, rows_of, small_batches, written
from .words import gram_hashes, word_list, words_of

#: Words of a run.
K = 3
#: Notices are found at this likeness: twice the words shared in order, by the words of both.
ALIKE = 0.75
#: A row for the text itself stands before its hashes; no hash of words takes this value but by chance, which is then passed over.
_TEXT = -(1 << 63)


@dataclass(frozen=True)
class Template:
    """Words that stand for a license; ``exact`` ones must stand in the text word by word, ``needs`` are words that no likeness makes up for."""

    label: str
    text: str
    exact: bool = False
    needs: str = ""

    @property
    def words(self) -> list[str]:
        return word_list(self.text)


#: The phrases that give a base label wherever they stand.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)

#: Notices of public licenses, as their publishers word them, and common short forms.
NOTICES = (
    Template("mit", "released under the MIT License", needs="mit"),
    Template("mit", "licensed under the terms of the MIT License", needs="mit"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("apache-2", "licensed under the Apache License, Version 2.0", needs="apache"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", needs="gnu general 2"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", needs="gnu general 3"),
    Template(
        "gpl-2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        needs="general 2",
    ),
    Template(
        "gpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        needs="general 3",
    ),
    Template("lgpl", "licensed under the GNU Lesser General Public License", needs="lesser"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", needs="lesser"),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3", needs="affero 3"),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", needs="affero 3"),
    Template("mpl-2", "this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", needs="mozilla 2"),
    Template("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by", "licensed under CC BY 4.0", needs="by"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", needs="attribution"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", needs="by sa"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", needs="attribution sharealike"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", needs="by nc"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", needs="attribution noncommercial"),
    Template("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0", needs="by nc sa"),
    Template("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0", needs="by nc nd"),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0", needs="by nd"),
    Template("cc0", "released into the public domain under CC0 1.0", needs="cc0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
)


def least_votes(length: int, alike: float = ALIKE, k: int = K) -> int:
    """Runs that a notice of ``length`` words still shares with a text that has at least that share of its words in order."""
    lost = int((1 - alike) * length + 1e-9)
    return max(1, length - k + 1 - k * lost)


def common_words(template: Sequence[str], window: Sequence[str]) -> int:
    """Length of the longest common subsequence, by bits of one whole number."""
    where: dict[str, int] = {}
    for i, w in enumerate(template):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    rest = full
    for w in window:
        hit = rest & where.get(w, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(template) - rest.bit_count()


def _template_table(spark: SparkSession, templates: Sequence[Template], k: int) -> DataFrame:
    """``h, template, at``: the hash of every run of each template; its size is that of the template list."""
    rows: list[tuple[int, int, int]] = [(_TEXT, -1, 0)]
    for number, t in enumerate(templates):
        if len(t.words) < k:
            raise ValueError(f"a template needs {k} words or more: {t.text!r}")
        hashes, _ = gram_hashes(words_of(pa.array([t.text])), k)
        rows += [(int(h), number, at) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "h bigint, template int, at int")


def _hits(docs: DataFrame, templates: Sequence[Template], k: int) -> DataFrame:
    """One row for each text (``template`` -1) and one for each run that a template has, with both places."""

    def run(batches):
        for batch in batches:
            words = words_of(batch.column(3))
            hashes, counts = gram_hashes(words, k)
            ends = np.cumsum(counts)
            # the text's own row stands first in its list
            flat = np.insert(hashes, ends - counts, np.full(len(counts), _TEXT))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(words.counts), lists], names=["doc_id", "k1", "k2", "n_words", "hs"]
            )

    listed = docs.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, hs array<bigint>")
    runs = listed.select("doc_id", "k1", "k2", "n_words", F.posexplode("hs").alias("place", "h"))
    met = runs.join(F.broadcast(_template_table(docs.sparkSession, templates, k)), "h")
    # place 0 is the text's own row; a run of words with the same hash isn't one
    return met.filter((F.col("template") >= 0) == (F.col("place") > 0)).drop("h")


def _spans(hits: DataFrame, templates: Sequence[Template], alike: float, k: int) -> DataFrame:
    """``k1, k2, template, begin, end``: places of the text that have votes enough, ``end`` exclusive."""
    runs = [len(t.words) - k + 1 for t in templates]
    sizes = hits.sparkSession.createDataFrame(
        [(i, t.exact, runs[i] if t.exact else least_votes(len(t.words), alike, k), len(t.words), int((1 - alike) * len(t.words) + 1e-9)) for i, t in enumerate(templates)],
        "template int, exact boolean, least int, size int, slack int",
    )
    votes = hits.filter("template >= 0").withColumn("place", F.col("place") - 1)
    diagonals = (
        votes.groupBy("k1", "k2", "template", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.size(F.collect_set("at")).alias("votes"), F.min("place").alias("begin"), (F.max("place") + k).alias("end"))
        .join(F.broadcast(sizes), "template")
    )
    in_order = Window.partitionBy("k1", "k2", "template").orderBy("begin", "diagonal")
    apart = F.coalesce(
        F.col("exact")
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(in_order)) > F.col("slack"))
        | (F.col("begin") > F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) + F.col("slack")),
        F.lit(True),
    )
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(in_order))
    return (
        merged.groupBy("k1", "k2", "template", "span")
        .agg(F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("least").alias("least"))
        .filter("votes >= least").select("k1", "k2", "template", "begin", "end")
    )


_SPAN = "struct<label: string, exact: boolean, begin: bigint, end: bigint, score: double>"


def _verified(texts: DataFrame, templates: Sequence[Template], alike: float) -> DataFrame:
    """``k1, k2, spans`` of texts joined with their ``found`` spans: those that hold, none of them overlapped by a better notice."""
    parts, needed = [t.words for t in templates], [set(word_list(t.needs)) for t in templates]

    def notices(words: list[str], found: list[dict]) -> list[dict]:
        held = []
        for s in found:
            own, slack = parts[s["template"]], int((1 - alike) * len(parts[s["template"]]) + 1e-9)
            # the ends of the notice may have lost their runs; look as far as it could reach
            begin, end = max(s["begin"] - slack, 0), min(s["end"] + slack, len(words))
            common = common_words(own, words[begin:end])
            while begin < s["begin"] and common_words(own, words[begin + 1 : end]) == common:
                begin += 1
            while end > s["end"] and common_words(own, words[begin : end - 1]) == common:
                end -= 1
            score = 2 * common / (len(own) + end - begin)  # words put in count against it as words left out
            if score >= alike and needed[s["template"]] <= set(words[begin:end]):
                held.append({"label": templates[s["template"]].label, "exact": False, "begin": begin, "end": end, "score": score})
        best = sorted(held, key=lambda s: (-s["score"], s["begin"] - s["end"], s["begin"], s["label"]))
        out: list[dict] = []
        for s in best:
            if not any(s["begin"] < o["end"] and o["begin"] < s["end"] for o in out):
                out.append(s)
        return out

    def run(batches):
        for k1s, k2s, texts, lists in rows_of(batches, "k1", "k2", "x", "found"):
            out = []
            for text, found in zip(texts, lists, strict=True):
                words = word_list(text)
                places = {(s["template"], s["begin"]) for s in found if templates[s["template"]].exact}
                spans = [
                    {"label": templates[t].label, "exact": True, "begin": b, "end": b + len(parts[t]), "score": 1.0}
                    for t, b in sorted(places) if words[b : b + len(parts[t])] == parts[t]
                ]
                spans += notices(words, [s for s in found if not templates[s["template"]].exact])
                out.append(sorted(spans, key=lambda s: (s["begin"], s["end"], s["label"], s["exact"])))
            fields = [("label", pa.string()), ("exact", pa.bool_()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array(out, pa.list_(pa.struct(fields)))], names=["k1", "k2", "spans"]
            )

    return texts.mapInArrow(run, f"k1 bigint, k2 bigint, spans array<{_SPAN}>")


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES,
    alike: float = ALIKE, k: int = K,
) -> DataFrame:
    """``doc_id, n_words, spans`` of every row of ``docs``: verified places of phrases and notices, in the order of the text.

    A span holds its label, whether a phrase gave it, its first word, the word after
    its last and its likeness to the template. A null or empty text has
    no words and no spans. Rows that repeat an id are judged each by their own text;
    null ids stay null. No rows give no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    templates = [*phrases, *notices]
    x, own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{key}`").cast("bigint")
    rows = docs.select(own.alias("doc_id"), F.xxhash64(own, x).alias("k1"), F.xxhash64(x, F.lit(1), own).alias("k2"), x.alias("x"))
    hits = written(_hits(rows, templates, k))
    spans = _spans(hits, templates, alike, k).groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "begin", "end")).alias("found"))
    spans = written(spans)
    texts = maybe_wanted(rows.select("k1", "k2", "x"), spans, "k1").dropDuplicates(["k1", "k2"]).join(spans, ["k1", "k2"])
    verified = _verified(texts, templates, alike)
    every = hits.filter("template < 0").select("doc_id", "k1", "k2", "n_words")
    return every.join(verified, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """``scan``'s rows as ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The score is the likeness of the best span: 1 for a phrase, 0 without any.
    """
    base = F.filter("spans", lambda s: s["exact"])
    begins = F.transform(base, lambda s: s["begin"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(begins).alias("first_word"), F.array_max(begins).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
