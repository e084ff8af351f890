"""Exact counts and places against all orderings, and orderings of graphs beyond a long."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from test_orderings import draw, with_graphs

from cotflow.operators import exact_orderings, orderings
from pyspark.sql import functions as F


def random_edges(draws, n, share):
    order = draws.sample(range(n), n)
    return [(order[i], order[j]) for i in range(n) for j in range(i + 1, n) if draws.random() < share]


def every(n, edges):
    return [p for p in itertools.permutations(range(n)) if all(p.index(a) < p.index(b) for a, b in edges)]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.6])
def test_small_graphs(share):
    draws = random.Random(int(share * 10))
    for _ in range(40):
        n = draws.randint(1, 6)
        edges = random_edges(draws, n, share)
        found = every(n, edges)
        assert exact_orderings.count(n, edges) == len(found)
        places = [{p.index(v) for p in found} for v in range(n)]
        assert exact_orderings.bounds(n, edges) == [(min(s), max(s)) for s in places]


def test_large_graphs():
    chain = [(i, i + 1) for i in range(499)]
    assert exact_orderings.count(500, chain) == 1
    assert exact_orderings.bounds(500, chain) == [(i, i) for i in range(500)]
    assert exact_orderings.count(500, []) == math.factorial(500)
    assert exact_orderings.count(300, [(i, i + 1) for i in range(299) if i % 3 != 2]) == math.factorial(300) // 6**100
    tree = [(i // 2 - 1, i - 1) for i in range(2, 128)]
    sizes = [sum((j + 1) >> s == i + 1 for j in range(127) for s in range(8)) for i in range(127)]
    assert exact_orderings.count(127, tree) == math.factorial(127) // math.prod(sizes)
    assert exact_orderings.count(127, [(b, a) for a, b in tree]) == exact_orderings.count(127, tree)
    grid = [(4 * i + j, 4 * (i + d) + j + e) for i in range(5) for j in range(4) for d, e in ((1, 0), (0, 1)) if i + d < 5 and j + e < 4]
    # Standard fillings of a 5 x 4 rectangle, by hook lengths.
    assert exact_orderings.count(20, grid) == math.factorial(20) // math.prod(4 - j + 5 - i - 1 for i in range(5) for j in range(4))
    assert exact_orderings.count(20, grid, max_sets=10) is None
    # An edge that others imply changes nothing.
    assert exact_orderings.count(20, grid + [(0, 19)]) == exact_orderings.count(20, grid)


def test_cycles_and_nothing():
    assert exact_orderings.count(3, [(0, 1), (1, 0)]) == 0 and exact_orderings.bounds(3, [(0, 1), (1, 0)]) == []
    assert exact_orderings.count(1, [(0, 0)]) == 0 and exact_orderings.count(0, []) == 1 and exact_orderings.bounds(0, []) == []


def test_operators(spark):
    graphs = with_graphs(spark, [("a", 4, [(1, 2), (3, 4)]), ("loop", 2, [(1, 2), (2, 1)])])
    none = graphs.limit(1).select(F.lit("none").alias("example_id"), F.when(F.lit(False), F.col("graph")).alias("graph"))
    rows = graphs.select("example_id", "graph").unionByName(none)
    assert {tuple(r) for r in exact_orderings.count_orderings(rows).collect()} == {("a", "6"), ("loop", "0"), ("none", None)}
    assert {tuple(r) for r in exact_orderings.position_bounds(rows).collect()} == {
        ("a", "s1", 0, 2), ("a", "s2", 1, 3), ("a", "s3", 0, 2), ("a", "s4", 1, 3),
    }


def smallest(n, edges, cap):
    """The first orderings, by going on with the smallest ready node first."""
    out = []

    def walk(path, left):
        if len(out) == cap:
            return
        if not left:
            out.append(path)
        for v in sorted(left):
            if not any(b == v and a in left for a, b in edges):
                walk([*path, v], left - {v})

    walk([], frozenset(range(n)))
    return out


@pytest.mark.parametrize("n", [63, 64, 124, 125, 200])
def test_wide_graphs(spark, n):
    draws = random.Random(n)
    edges = [(i // 2 - 1, i - 1) for i in range(2, n + 1)] + [(a, b) for a in range(n) for b in range(a + 1, n) if draws.random() < 0.02]
    named = [(a + 1, b + 1) for a, b in edges]
    found = with_graphs(spark, [("wide", n, named), ("loop", n, [*named, (n, 1)]), ("self", n, [*named, (3, 3)]), ("free", n, [(1, 2)])])
    row = {
        r["example_id"]: r
        for r in found.select(
            "example_id", orderings.enumerate_orderings(F.col("graph"), 60).alias("o"),
            orderings.count_orderings(F.col("graph"), 500).alias("count"),
            F.when(F.col("example_id").isin("wide", "free"), orderings.sample_orderings(F.col("graph"), F.col("example_id"), 6, 1)).alias("s"),
        ).collect()
    }
    assert row["wide"]["o"] == smallest(n, edges, 60) and row["wide"]["count"] == 500
    assert row["free"]["o"] == smallest(n, [(0, 1)], 60) and row["free"]["count"] == 500
    assert row["loop"]["o"] == [] and row["self"]["o"] == []
    assert row["wide"]["s"] == draw(1, "wide", n, named, 6)
    assert row["free"]["s"] == draw(1, "free", n, [(1, 2)], 6)
