"""What the two vector operators share: valid vectors and classes of equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that isn't null, empty or zero and holds finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def element_type(df: DataFrame, vector: str) -> str:
    """The type in which components are kept: float stays float, everything else becomes double."""
    return "float" if df.schema[vector].dataType.elementType.simpleString() == "float" else "double"


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec`` of the rows that take part; negative zeros become zeros, so that equal vectors are equal keys."""
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    kind = element_type(df, vector)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("vec"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def by_length(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and matrix for each length of vector in an Arrow column."""
    lengths = pc.list_value_length(vectors)
    for n in pc.unique(lengths).to_pylist():
        chosen = pc.equal(lengths, n)
        yield keys.filter(chosen), matrix(vectors.filter(chosen))
