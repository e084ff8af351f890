"""Graphs and orderings against brute force and typed-in cases."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotflow import schemas
from cotflow.operators import analysis, graphs, order_batches, orderings

RESULT = f"example_id string, nodes {schemas.NODES}, edges {schemas.EDGES}, success boolean"


def record(name, n, edges, success=True):
    nodes = [(f"s{i}", f"text {i}") for i in range(1, n + 1)]
    return (name, nodes, [[f"s{x}" for x in e] for e in edges], success)


GOLDEN = {
    # name: nodes, edges, error, label, ratio, orderings found by a full run
    "two_chains": (5, [(1, 2), (3, 4), (2, 5), (4, 5)], None, "MEDIUM", 1.0, 6),
    "chain": (5, [(1, 2), (2, 3), (3, 4), (4, 5)], None, "MEDIUM", 1.0, 1),
    "two_cycle": (3, [(1, 2), (2, 1)], graphs.CYCLIC, None, None, None),
    "self_loop": (2, [(1, 1)], graphs.CYCLIC, None, None, None),
    "no_edges": (3, [], graphs.INVALID_INPUT, None, None, None),
    "no_nodes": (0, [(1, 2)], graphs.INVALID_INPUT, None, None, None),
    "only_bad_edges": (3, [(1,), (1, 9)], None, "VERY HIGH", 0.0, 6),
    "three_ends": (2, [(1, 2, 1)], None, "VERY HIGH", 0.0, 2),
    "twice": (2, [(1, 2), (1, 2)], None, "MEDIUM", 1.0, 1),
    "dense": (4, [(a, b) for a in range(1, 5) for b in range(a + 1, 5)], None, "LOW", 2.0, 1),
    "sparse": (4, [(1, 2), (3, 4)], None, "HIGH", 0.67, 6),
    "one_node": (1, [(1, 9)], None, "VERY HIGH", 0.0, 1),
    "tie": (9, [(i, i + 1) for i in range(1, 9)] + [(1, 3)], None, "MEDIUM", 1.12, 1),
    "four_to_one": (6, [(1, 5), (2, 5), (3, 5), (4, 5), (5, 6)], None, "MEDIUM", 1.0, 24),
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [record(name, g[0], g[1]) for name, g in GOLDEN.items()]
    rows.append(record("failed", 2, [(1, 2)], success=False))
    df = spark.createDataFrame(rows, RESULT)
    return {r["example_id"]: r for r in orderings.reasoning_paths(df).collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_graphs(golden, name):
    _, _, error, label, ratio, total = GOLDEN[name]
    got = golden[name]
    assert got["error"] == error
    assert got["total_paths"] == total
    if error is None:
        assert got["complexity_estimate"]["complexity"] == label
        assert got["complexity_estimate"]["constraint_ratio"] == ratio
        assert got["method"] == ("sampling" if label in graphs.SAMPLED_LEVELS else "exhaustive")
    else:
        assert got["method"] is None and got["orderings"] is None


def test_failed_result_is_invalid(golden):
    assert golden["failed"]["error"] == graphs.INVALID_INPUT


def test_duplicate_node_keeps_first_place_and_last_text(spark):
    nodes = [("a", "one"), ("b", "two"), ("a", "three")]
    df = spark.createDataFrame([("x", nodes, [["b", "a"]], True)], RESULT)
    row = orderings.path_rows(orderings.reasoning_paths(df)).collect()
    assert [(r["sequence"], r["texts"]) for r in row] == [(["b", "a"], ["two", "three"])]


def random_graphs(count, seed, sizes=range(1, 7)):
    rng = random.Random(seed)
    found = []
    for i in range(count):
        n = rng.choice(list(sizes))
        order = list(range(1, n + 1))
        rng.shuffle(order)
        edges = [
            (order[a], order[b])
            for a in range(n)
            for b in range(a + 1, n)
            if rng.random() < 0.35
        ]
        found.append((f"g{i}", n, edges))
    return found


def brute(n, edges):
    def respects(p):
        place = {v: i for i, v in enumerate(p)}
        return all(place[a - 1] < place[b - 1] for a, b in edges)

    return [list(p) for p in itertools.permutations(range(n)) if respects(p)]


def with_graphs(spark, cases, partitions=3):
    # One bad edge keeps records without dependencies valid.
    rows = [record(name, n, edges + [(1,)]) for name, n, edges in cases]
    df = spark.createDataFrame(rows, RESULT).repartition(partitions)
    return graphs.with_graph(df)


@pytest.mark.parametrize("cap", [1, 5, 10000])
def test_enumeration_is_the_smallest_orderings(spark, cap):
    cases = random_graphs(40, cap)
    found = with_graphs(spark, cases).select(
        "example_id", orderings.enumerate_orderings(F.col("graph"), cap).alias("o")
    )
    got = {r["example_id"]: r["o"] for r in found.collect()}
    for name, n, edges in cases:
        assert got[name] == brute(n, edges)[:cap]


def draw(seed, name, n, edges, samples):
    """The sampling rule, one attempt after the other."""
    before = [{a - 1 for a, b in edges if b - 1 == v} for v in range(n)]
    found = []
    for attempt in range(1, 5 * samples + 1):
        digest = hashlib.md5(f"{seed}|{name}|{attempt}".encode()).hexdigest()
        state = int(digest[:8], 16) % 2147483646 + 1
        path = []
        while len(path) < n:
            ready = [v for v in range(n) if v not in path and before[v] <= set(path)]
            path.append(ready[state % len(ready)])
            state = state * 48271 % 2147483647
        if path not in found:
            found.append(path)
        if len(found) == samples:
            break
    return found


@pytest.mark.parametrize("samples", [1, 4, 50])
def test_sampling_rule(spark, samples):
    cases = random_graphs(30, samples)
    found = with_graphs(spark, cases).select(
        "example_id",
        orderings.sample_orderings(F.col("graph"), F.col("example_id"), samples, 9).alias("o"),
    )
    got = {r["example_id"]: r["o"] for r in found.collect()}
    for name, n, edges in cases:
        assert got[name] == draw(9, name, n, edges, samples)
        assert all(p in brute(n, edges) for p in got[name])


def test_full_run_against_brute_force(spark):
    cases = random_graphs(25, 77)
    rows = [record(name, n, edges + [(1,)]) for name, n, edges in cases]
    paths = orderings.reasoning_paths(spark.createDataFrame(rows, RESULT).repartition(4), seed=3)
    got = {r["example_id"]: r for r in paths.collect()}
    for name, n, edges in cases:
        row = got[name]
        if row["method"] == "sampling":
            assert row["orderings"] == draw(3, name, n, edges, 500)
        else:
            assert row["orderings"] == brute(n, edges)[:1000]
        assert row["total_paths"] == len(row["orderings"])


def test_sampling_is_spread_like_stepwise_choice(spark):
    """Two chains of two: first ordering drawn is each of the six with the expected share."""
    cases = [(f"g{i}", 4, [(1, 2), (3, 4)]) for i in range(2000)]
    found = with_graphs(spark, cases).select(
        F.element_at(orderings.sample_orderings(F.col("graph"), F.col("example_id"), 1, 0), 1)
        .cast("string").alias("o")
    )
    shares = {r["o"]: r["count"] / 2000 for r in found.groupBy("o").count().collect()}
    assert len(shares) == 6
    assert sum(abs(s - 0.25) < 0.03 for s in shares.values()) == 2
    assert sum(abs(s - 0.125) < 0.03 for s in shares.values()) == 4


def test_graphs_beyond_a_long(spark):
    """A chain of 70 nodes with one free node at its end: the free node can go anywhere."""
    n = 71
    chain = [(i, i + 1) for i in range(1, n - 1)]
    found = with_graphs(spark, [("wide", n, chain), ("loop", n, chain + [(n - 1, 1)])])
    row = {
        r["example_id"]: r
        for r in found.select(
            "example_id",
            orderings.is_acyclic(F.col("graph")).alias("acyclic"),
            orderings.enumerate_orderings(F.col("graph"), 100).alias("o"),
            F.when(
                orderings.is_acyclic(F.col("graph")),
                orderings.sample_orderings(F.col("graph"), F.col("example_id"), 20, 1),
            ).alias("s"),
        ).collect()
    }
    assert row["loop"]["acyclic"] is False and row["loop"]["o"] == []
    rest = list(range(n - 1))
    want = [rest[:i] + [n - 1] + rest[i:] for i in range(n - 1, -1, -1)]
    assert row["wide"]["o"] == want
    assert row["wide"]["s"] == draw(1, "wide", n, chain, 20)


def test_same_result_on_any_partitioning(spark):
    cases = random_graphs(30, 5)
    rows = [record(name, n, edges + [(1,)]) for name, n, edges in cases]
    df = spark.createDataFrame(rows, RESULT)
    runs = [
        sorted(map(str, orderings.reasoning_paths(df.repartition(p), True).collect()))
        for p in (1, 7)
    ]
    assert runs[0] == runs[1]


PATHS = (
    "example_ord int, example_id string, error string, complexity_estimate struct<complexity:string>, "
    "method string, total_paths int, node_ids array<string>, node_texts array<string>, "
    "orderings array<array<int>>"
)


def test_position_reports(spark):
    def row(i, ids, found, error=None):
        return (i, f"e{i}", error, ("HIGH",), "sampling", len(found), ids, ids, found)

    rows = [
        row(0, ["a", "b", "c", "d"], [[0, 1, 2, 3], [0, 2, 1, 3]]),
        row(1, ["b", "a", "x"], [[0, 1, 2], [1, 0, 2]]),
        row(2, ["a"], [[0]]),
        row(3, ["q"], []),
        (4, "e4", "Invalid input", None, None, None, None, None, None),
    ]
    paths = spark.createDataFrame(rows, PATHS)
    positions = analysis.step_positions(paths)
    assert positions.count() == 7
    flexibility = analysis.step_flexibility(positions)
    classes = {r["step"]: (r["always_first"], r["always_last"], r["flexible"]) for r in flexibility.collect()}
    assert classes == {
        "a": (1, 0, 1), "b": (0, 0, 2), "c": (0, 0, 1), "d": (0, 1, 0), "x": (0, 1, 0),
    }
    listed = analysis.top_steps(flexibility).orderBy("class", "rank").collect()
    assert [(r["class"], r["step"], r["examples"]) for r in listed] == [
        ("always_first", "a", 1), ("always_last", "d", 1), ("always_last", "x", 1),
        ("flexible", "b", 2), ("flexible", "c", 1), ("flexible", "a", 1),
    ]
    buckets = {r["bucket"]: r["examples"] for r in analysis.path_count_distribution(paths).collect()}
    # A count of zero lands in the second class.
    assert buckets == {"single_path": 1, "2-10_paths": 3}
    stats = analysis.flexibility_stats(paths).first()
    assert (stats[0], stats[1], stats[2]) == (2, 5 / 4, 2)


def test_reports_on_nothing(spark):
    paths = spark.createDataFrame([], PATHS)
    assert tuple(analysis.flexibility_stats(paths).first()) == (0, 0.0, 0)
    assert tuple(analysis.path_run_summary(paths).first()) == (0, 0, 0)
    assert analysis.alt_cot_overview(paths).first()["avg_paths"] is None


@pytest.mark.parametrize("cells", [1, 64, order_batches.CELLS])
def test_batches_give_every_graph_once_in_bounded_parts(monkeypatch, cells):
    """Caps, samples and duplicate or null keys of one batch, whatever is held at a time."""
    monkeypatch.setattr(order_batches, "CELLS", cells)
    cases = [*random_graphs(25, 3, range(1, 7)), ("free", 14, [(i, i + 1) for i in range(1, 11)])]
    nodes = np.array([0] + [n for _, n, _ in cases])
    edges = [[]] + [[(a - 1) * n + b - 1 for a, b in found] for _, n, found in cases]
    sample = np.arange(len(nodes)) % 3 == 1
    caps = np.where(np.arange(len(nodes)) % 2, 7, 100)
    keys = [None] + [None if i == 4 else f"g{i % 20}" for i in range(len(cases))]
    rounds = orderings._rounds(4 * orderings.ATTEMPTS_PER_SAMPLE)
    got = {}
    for at, found in order_batches.orderings_of(nodes, pa.array(edges, pa.list_(pa.int64())), caps, sample, keys, 4, 9, rounds):
        if cells == 1 and not sample[at[0]]:
            assert len(at) == 1
        assert not set(at.tolist()) & set(got)
        got |= dict(zip(at.tolist(), found.to_pylist(), strict=True))
    assert sorted(got) == list(range(1, len(nodes)))
    for i, (_, n, wanted) in enumerate(cases, 1):
        if sample[i]:
            assert got[i] == draw(9, keys[i], n, wanted, 4)
        elif n < 7:
            assert got[i] == brute(n, wanted)[: caps[i]]
        else:
            assert len(got[i]) == caps[i] and got[i] == sorted(got[i])


def in_order(n, edges, cap):
    """The smallest orderings by depth-first search."""
    before = [{a - 1 for a, b in edges if b - 1 == v} for v in range(n)]
    found, path = [], []

    def go():
        if len(path) == n:
            found.append(list(path))
        for v in range(n):
            if len(found) < cap and v not in path and before[v] <= set(path):
                path.append(v)
                go()
                path.pop()

    go()
    return found


@pytest.mark.parametrize("n", [12, 40, 70, 150])
def test_tails_of_all_lengths_give_the_smallest_orderings(spark, n):
    """Few free steps at the start, in the middle or at the end, so that short tails do not suffice."""
    chain = [(i, i + 1) for i in range(1, n)]
    cases = [
        ("chain", n, chain),
        ("free_start", n, [e for e in chain if e[0] > 2]),
        ("free_end", n, [e for e in chain if e[0] < n - 6]),
        ("halves", n, [e for e in chain if e[0] != n // 2]),
        ("thirds", n, [(i, i + 3) for i in range(1, n - 2)]),
    ]
    found = with_graphs(spark, cases).select("example_id", orderings.enumerate_orderings(F.col("graph"), 30).alias("o"))
    got = {r["example_id"]: r["o"] for r in found.collect()}
    for name, _, edges in cases:
        assert got[name] == in_order(n, edges, 30)


def test_graphs_listed_in_order_need_no_slots(spark):
    nodes = [("s1", "a"), ("s2", "b"), ("s3", "c")]
    rows = [
        ("forward", True, nodes, [["s1", "s2"], ["s1", "s3"], ["s2", "s3"]]), ("loop", True, nodes, [["s1", "s1"]]),
        ("back", True, nodes, [["s3", "s1"], ["s1", "s2"]]), ("cycle", True, nodes, [["s1", "s2"], ["s2", "s1"]]),
        ("none", True, nodes, [["s1", "s9"]]), ("bad", False, nodes, [["s1", "s2"]]),
    ]
    df = spark.createDataFrame(rows, "example_id string, success boolean, nodes array<struct<id:string,text:string>>, edges array<array<string>>")
    lean = graphs.with_graph(df, lean=True).where("graph IS NOT NULL AND graph.slots IS NULL")
    assert {r["example_id"] for r in lean.collect()} == {"forward", "none"}
    found = {r["example_id"]: (r["error"], r["orderings"]) for r in orderings.reasoning_paths(df, for_cots=True).collect()}
    assert found["forward"] == (None, [[0, 1, 2]]) and found["back"] == (None, [[2, 0, 1]])
    assert len(found["none"][1]) == 6 and found["none"][0] is None
    assert {found[e][0] for e in ("loop", "cycle")} == {graphs.CYCLIC} and found["bad"][0] == graphs.INVALID_INPUT


def test_first_orderings_of_a_batch(spark):
    """The batch form against the expression over one row, which it replaces, for graphs of all widths."""
    draws, rows = random.Random(8), []
    for i in range(60):
        n = (1, 2, 5, 9, 14, 30, 70)[i % 7]
        order = draws.sample(range(n), n)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if draws.random() < 3 / n or (i % 3 == 0 and b == a + 1 and a % 9 != 4)]
        edges = [(order[a], order[b]) for a, b in pairs] + ([(order[-1], order[0]), (order[0], order[-1])] if i % 10 == 9 and n > 1 else [])
        rows.append((f"e{i}", [(f"s{v}", "t") for v in range(n)], [[f"s{a}", f"s{b}"] for a, b in edges] or [["s0", "s0"]], True))
    made = graphs.with_graph(spark.createDataFrame(rows, f"example_id string, nodes {schemas.NODES}, edges {schemas.EDGES}, success boolean")).repartition(2).cache()
    for cap in (1, 40):
        batch = orderings.enumerate_orderings(F.col("graph"), cap)
        by_row = orderings.enumerate_orderings(F.col("graph"), cap, orderings._by_size)
        found = made.select("example_id", batch.alias("batch"), by_row.alias("by_row"))
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        got = found.collect()
        assert all(r["batch"] == r["by_row"] for r in got) and max(len(r["batch"]) for r in got) == cap
        assert cap == 1 or any(1 < len(r["batch"]) < cap for r in got)
    made.unpersist()


@pytest.mark.parametrize("nodes", [3, 70])
def test_first_orderings_by_search(nodes):
    """Two steps that change places at either end of a chain: tails of all lengths have too few orderings."""
    chain = [(v, v + 1) for v in range(nodes - 1) if v not in (0, nodes - 2)]
    ends = [] if nodes < 4 else [(0, 2), (nodes - 3, nodes - 1)]
    codes = np.array([a * nodes + b for a, b in chain + ends], np.int64)
    found = order_batches.first_orderings([nodes, nodes, None], [codes, np.append(codes, 1 * nodes + 1), codes[:0]], [9, 9, 9])
    assert len(found[1]) == len(found[2]) == 0
    if nodes > 3:
        swapped = [{tuple(p[:2]), tuple(p[-2:])} for p in found[0].tolist()]
        assert len(found[0]) == 4 and found[0].tolist() == sorted(found[0].tolist())
        assert {frozenset(s) for s in swapped} == {frozenset([a, b]) for a in ((0, 1), (1, 0)) for b in ((68, 69), (69, 68))}
