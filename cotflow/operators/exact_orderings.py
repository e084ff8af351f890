"""Exact facts about all orderings of a step graph, without listing them.

``position_bounds`` closes the order: a step comes no earlier than after all its ancestors and no
later than before all its descendants, and some ordering reaches either place. ``count_orderings``
counts down-sets, the sets of steps that may have been placed: a set is reached in as many ways as
the sets it came from together. Parts of a graph that no edge joins are counted one by one and
interleaved freely, and parts where every step has one direct cause at most, or one direct effect
at most, have a product formula.

Both are exact for any number of steps: sets are Python integers used as bits, and counts are
integers of any size, given as text. What one record takes grows with the edges for the bounds, and
for the count with the number of down-sets of its largest part, which ``MAX_SETS`` bounds: beyond
it the count is null and not a guess.

Cyclic graphs have neither: they give no bounds and a count of 0. A null graph gives a null count.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_SETS = 200_000


def ancestors(n: int, edges: list[tuple[int, int]]) -> list[int] | None:
    """Per node the bits of all nodes before it; None for a cyclic graph."""
    after, open_causes = [[] for _ in range(n)], [0] * n
    for a, b in edges:
        after[a].append(b)
        open_causes[b] += 1
    known, queue, done = [0] * n, [v for v in range(n) if not open_causes[v]], 0
    while queue:
        v = queue.pop()
        done += 1
        for w in after[v]:
            known[w] |= known[v] | 1 << v
            open_causes[w] -= 1
            if not open_causes[w]:
                queue.append(w)
    return known if done == n else None


def bounds(n: int, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(earliest, latest) place of every node, from 0; empty for a cyclic graph."""
    before = ancestors(n, edges)
    if before is None:
        return []
    behind = ancestors(n, [(b, a) for a, b in edges])
    return [(before[v].bit_count(), n - 1 - behind[v].bit_count()) for v in range(n)]


def _parts(n: int, before: list[int]) -> list[list[int]]:
    """The nodes of every connected part."""
    joined = list(before)
    for v in range(n):
        for u in range(n):
            if before[v] >> u & 1:
                joined[u] |= 1 << v
    parts, seen = [], 0
    for v in range(n):
        if seen >> v & 1:
            continue
        part, todo = 1 << v, [v]
        while todo:
            fresh = joined[todo.pop()] & ~part
            part |= fresh
            todo += [u for u in range(n) if fresh >> u & 1]
        seen |= part
        parts.append([u for u in range(n) if part >> u & 1])
    return parts


def _direct(nodes: list[int], before: list[int]) -> dict[int, list[int]]:
    """The causes of every node that no other cause of it comes after."""
    direct = {}
    for v in nodes:
        causes = [u for u in nodes if before[v] >> u & 1]
        direct[v] = [u for u in causes if not any(before[w] >> u & 1 for w in causes)]
    return direct


def _count_part(nodes: list[int], before: list[int], max_sets: int) -> int | None:
    direct = _direct(nodes, before)
    effects: dict[int, int] = {}
    for causes in direct.values():
        for u in causes:
            effects[u] = effects.get(u, 0) + 1
    sizes = None
    if all(len(c) <= 1 for c in direct.values()):
        sizes = [1 + sum(before[w] >> v & 1 for w in nodes) for v in nodes]
    elif all(e <= 1 for e in effects.values()):
        sizes = [1 + before[v].bit_count() for v in nodes]
    if sizes is not None:
        return math.factorial(len(nodes)) // math.prod(sizes)
    ways, total = {0: 1}, 0
    for _ in nodes:
        grown: dict[int, int] = {}
        for placed, count in ways.items():
            for v in nodes:
                if not placed >> v & 1 and before[v] & ~placed == 0:
                    key = placed | 1 << v
                    grown[key] = grown.get(key, 0) + count
        ways, total = grown, total + len(grown)
        if total > max_sets:
            return None
    return sum(ways.values())


def count(n: int, edges: list[tuple[int, int]], max_sets: int = MAX_SETS) -> int | None:
    before = ancestors(n, edges)
    if before is None:
        return 0
    total, placed = 1, 0
    for part in _parts(n, before):
        ways = _count_part(part, before, max_sets)
        if ways is None:
            return None
        placed += len(part)
        total *= ways * math.comb(placed, len(part))
    return total


def _graphs(batch: pa.RecordBatch):
    for n, codes in zip(batch.column("n").to_pylist(), batch.column("codes").to_pylist(), strict=True):
        yield None if n is None else (n, [divmod(c, n) for c in codes])


def _flat(graphs: DataFrame, keys: list[str]) -> DataFrame:
    return graphs.select(*keys, F.size("graph.ids").alias("n"), F.col("graph.codes").alias("codes"), F.col("graph.ids").alias("ids"))


def position_bounds(graphs: DataFrame) -> DataFrame:
    """(example_id, step, earliest, latest) for every step of acyclic graphs (example_id, graph)."""

    def run(batches):
        for batch in batches:
            rows = [bounds(*g) if g else [] for g in _graphs(batch)]
            ends = [pa.array([[b[k] for b in row] for row in rows], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("example_id"), batch.column("ids"), *ends], names=["example_id", "ids", "earliest", "latest"])

    found = _flat(graphs.where(F.col("graph").isNotNull()), ["example_id"]).mapInArrow(
        run, "example_id string, ids array<string>, earliest array<int>, latest array<int>"
    )
    rows = found.where(F.size("earliest") > 0).select("example_id", F.explode(F.arrays_zip("ids", "earliest", "latest")).alias("s"))
    return rows.select("example_id", F.col("s.ids").alias("step"), "s.earliest", "s.latest")


def count_orderings(graphs: DataFrame, max_sets: int = MAX_SETS) -> DataFrame:
    """(example_id, total_orderings): the exact count as text, for graphs (example_id, graph)."""

    def run(batches):
        for batch in batches:
            found = [count(*g, max_sets) if g else None for g in _graphs(batch)]
            texts = pa.array([None if c is None else str(c) for c in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("example_id"), texts], names=["example_id", "total_orderings"])

    return _flat(graphs, ["example_id"]).mapInArrow(run, "example_id string, total_orderings string")
