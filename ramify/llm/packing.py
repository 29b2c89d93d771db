"""Operator 10: best-fit packing of token sequences by the sum-of-squares rule.

Documents are cut into pieces of at most ``capacity`` tokens. A piece that fills
a sequence stands alone. The others are dealt evenly into groups of bounded size
(by a hash of their row number, so no key can be hot); each group is packed by
itself, largest piece first. A piece goes into the open sequence for which the
sum over gaps of squared numbers of open sequences becomes smallest, and into a
new one only where none has room. A group leaves one or two sequences partly
empty, so the loss against one global packing is about one in a thousand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import checkpointed, rows_of, small_batches, tokenizer_file

#: Tokens in a sequence.
CAPACITY = 2048
#: Pieces in a packing group, about: bounds a task's memory and time.
GROUP_PIECES = 8192

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def piece_bounds(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens; only the first may be short."""
    first = n % capacity or capacity
    yield 0, min(first, n)
    for start in range(first, n, capacity):
        yield start, capacity


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for lengths in packing order.

    With N(g) open sequences of gap g, putting length s into gap g changes the
    sum of squares by 2 N(g-s) - 2 N(g) + 2, where a full sequence counts nothing.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.int64(1) << 60
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        change = 2 * count[: capacity - s + 1] + 1
        change[0] = 0
        change -= 2 * count[s:] - 1
        change[count[s:] == 0] = never
        rest = int(change.argmin())
        if change[rest] == never:
            rest, gap, own = capacity - s, capacity, used
            used += 1
        else:
            gap = rest + s
            own = open_by_gap[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = own, capacity - gap
        if rest:
            count[rest] += 1
            open_by_gap[rest].append(own)
    return sequence, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Tokenise each text, append ``end_id`` and cut: one row per piece. A null text is empty."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_file()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        model = tokenizer(path)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, packed in zip(ids, model.encode_many([x or "" for x in texts]), strict=True):
                packed += end
                for k, (start, length) in enumerate(piece_bounds(len(packed) >> 2, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(out)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece a sequence and an offset.

    Rows need ``length``; all of their columns stay, but for a ``sequence_id`` or
    ``offset`` that they had. Repeated rows are packed as
    often as they occur. An empty table gives an empty one. ``sequence_id`` is
    negative for a piece that fills its sequence.
    """
    row, group = (next(n for k in range(len(cut.columns) + 1) if (n := f"{name}{k or ''}") not in cut.columns) for name in ("row", "group"))
    numbered = checkpointed(cut).withColumn(row, F.monotonically_increasing_id())
    short = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", row], ascending=[False, True], kind="stable")
        sequence, rows["offset"] = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = rows[group].to_numpy() << 32 | sequence
        return rows[columns]

    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    columns = [*kept, "sequence_id", "offset"]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id bigint, offset bigint"
    packed = (
        short.withColumn(group, F.pmod(F.xxhash64(row), F.lit(groups)))
        .groupBy(group)
        .applyInPandas(run, schema)
    )
    alone = numbered.filter(F.col("length") >= capacity).select(
        *(F.col(f"`{c}`") for c in kept), (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack documents; columns as in ``PACKED``."""
    return pack(pieces(docs, capacity, end_id, path), capacity)
