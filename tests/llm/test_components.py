from __future__ import annotations

import random

import pytest

from corpusmill.llm.common import maybe_among
from corpusmill.llm.components import connected


def plain(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {i: root(i) for i in label}


def chain(n):
    return [(i + 1, i) for i in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 5), (5, 3)], chain(60), [(0, i) for i in range(1, 80)], [(99, i) for i in range(80)], [(-5, 7), (7, 2**62), (3, -(2**62))], chain(20) + [(100 + a, 100 + b) for a, b in chain(9)] + [(9, 105)]])
def test_shapes(spark, edges):
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])


def test_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((50, 30), (80, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == plain([e for e in edges if e[0] != e[1]])


def test_maybe_among_keeps_every_key(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) as h", "id as map_bits")
    keys = rows.where("map_bits % 7 = 0").select("h")
    got = {r.map_bits for r in maybe_among(rows, keys, "h").collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 2500
    assert maybe_among(rows, keys, "h").columns == rows.columns
    assert maybe_among(rows, keys.limit(0), "h").count() == 0
