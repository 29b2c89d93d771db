"""Connected components against a union-find over all links, folded in one partition and by star steps."""

import random

import numpy as np
import pyarrow as pa
import pytest
from ramify.llm.components import _folded, components

LINKS = "a bigint, b bigint"


def naive(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def graph():
    draw = random.Random(3)
    chain = [(k, k + 1) for k in range(0, 120)]
    hub = [(500 + k, 1000) for k in range(200)]
    loose = [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(150)]
    links = chain + hub + loose + [(7, 7), (None, 3), (4, None), (1, 0), (0, 1)]
    draw.shuffle(links)
    return links


@pytest.mark.parametrize("partition_links", [1 << 16, 20])
def test_equal_to_union_find(spark, partition_links):
    links = graph()
    found = components(spark.createDataFrame(links, LINKS).repartition(4), partition_links=partition_links).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == naive(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], LINKS)).count() == 0
    assert components(spark.createDataFrame([(5, 5), (None, None)], LINKS)).count() == 0


def test_a_full_task_gives_its_forest_away_and_keeps_every_link():
    links = [(a, b) for a, b in graph() if a is not None and b is not None and a != b]
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in part], "b": [b for _, b in part]}, pa.schema([("a", pa.int64()), ("b", pa.int64())])) for part in np.array_split(np.array(links), 30)]
    for held in (16, 1 << 20):
        out = [(a, b) for batch in _folded(held)(iter(batches)) for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)]
        assert all(a > b for a, b in out)
        assert naive(out) == naive(links)
    assert list(_folded(8)(iter([]))) == []
