"""Orderings of many small graphs at once, for the graphs of one Arrow batch in numpy.

The graphs of a batch with equally many nodes are handled together: a level of the enumeration, or a
step of the random draws, is a few array operations over all their prefixes. Results are those of
``enumerate_orderings`` and ``sample_orderings``. Spark deals out the rows; a task holds some
``CELLS`` cells of prefixes at a time, or the orderings of one graph, and gives its rows in such parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cotflow.functions.hashing import MODULUS, MULTIPLIER

# Cells (prefixes x nodes) in work at a time.
CELLS = 1 << 20
# Nodes of the first tail that is arranged, and bits of a set of nodes.
TAIL, BITS = 8, 62

Found = tuple[np.ndarray, np.ndarray]


def predecessors(nodes: int, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Per graph and node the bits of its predecessors, from edges coded as src * nodes + dst."""
    before = np.zeros((len(lengths), nodes), np.uint64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    np.bitwise_or.at(before, (rows, codes % nodes), np.uint64(1) << (codes // nodes).astype(np.uint64))
    return before


def _ready(placed: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per prefix and node: is the node not placed, and are all its predecessors?"""
    bits = np.uint64(1) << np.arange(before.shape[1], dtype=np.uint64)
    return (placed[:, None] & (before | bits)) == before


def _within(rows: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its row; rows ascend."""
    first = np.searchsorted(rows, rows, "left")
    return np.arange(len(rows)) - first


def enumerated(before: np.ndarray, caps: np.ndarray) -> Iterator[Found]:
    """(row, ordering) of the first ``caps`` orderings per graph, rows ascending, in parts of whole
    graphs: prefixes that grow beyond CELLS are divided between two parts, down to one graph."""
    graphs, nodes = before.shape
    waiting = [(np.arange(graphs), np.zeros(graphs, np.uint64), np.zeros((graphs, 0), np.uint8))]
    while waiting:
        rows, placed, paths = waiting.pop()
        if len(rows) * nodes > CELLS and rows[0] != rows[-1]:
            middle = rows[len(rows) // 2]
            cut = np.searchsorted(rows, middle if middle > rows[0] else middle + 1)
            waiting += [(rows[cut:], placed[cut:], paths[cut:]), (rows[:cut], placed[:cut], paths[:cut])]
            continue
        if paths.shape[1] == nodes:
            yield rows, paths
            continue
        parent, node = np.nonzero(_ready(placed, before[rows]))
        kept = _within(rows[parent]) < caps[rows[parent]]
        parent, node = parent[kept], node[kept]
        placed = placed[parent] | (np.uint64(1) << node.astype(np.uint64))
        waiting.append((rows[parent], placed, np.concatenate([paths[parent], node.astype(np.uint8)[:, None]], axis=1)))


def _start_states(prefixes: list[bytes], rows: np.ndarray, attempts: np.ndarray) -> np.ndarray:
    """The generator states of ``start_state(seed, key, attempt)``; a prefix is 'seed|key|'."""
    ends = {int(a): str(a).encode() for a in np.unique(attempts)}
    digests = b"".join(
        [hashlib.md5(prefixes[r] + ends[a]).digest()[:4] for r, a in zip(rows.tolist(), attempts.tolist(), strict=True)]
    )
    return np.frombuffer(digests, ">u4").astype(np.int64) % (MODULUS - 1) + 1


def _drawn(before: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """One random ordering per row of ``before``: a uniform choice among the ready nodes per step."""
    placed = np.zeros(len(before), np.uint64)
    paths = np.zeros(before.shape, np.uint8)
    for step in range(before.shape[1]):
        counts = np.cumsum(_ready(placed, before), axis=1, dtype=np.uint8)
        chosen = (rng % counts[:, -1] + 1).astype(np.uint8)
        node = np.argmax(counts == chosen[:, None], axis=1)
        paths[:, step] = node
        placed |= np.uint64(1) << node.astype(np.uint64)
        rng = rng * MULTIPLIER % MODULUS
    return paths


def _first_of_equals(rows: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Indices, ascending, of the entries whose (row, ordering) stands nowhere before."""
    nodes = paths.shape[1]
    width = max(1, int(nodes - 1).bit_length())
    if nodes * width + int(rows.max(initial=0)).bit_length() <= 63:
        keys = rows.astype(np.int64)
        for step in range(nodes):
            keys = (keys << width) | paths[:, step]
    else:
        joined = np.concatenate([rows.astype(">u4").view(np.uint8).reshape(-1, 4), paths], axis=1)
        keys = np.ascontiguousarray(joined).view(f"V{nodes + 4}").ravel()
    return np.sort(np.unique(keys, return_index=True)[1])


def sampled(before: np.ndarray, prefixes: list[bytes], n: int, rounds: list[tuple[int, int]]) -> Found:
    """(row, ordering) of the first n distinct orderings among the attempts of ``rounds`` per graph.

    A graph leaves the rounds once n distinct orderings are found, or all that it has.
    """
    graphs = len(before)
    goal = np.zeros(graphs, np.int64)
    for found, _ in enumerated(before, np.full(graphs, n)):
        goal += np.bincount(found, minlength=graphs)
    rows, paths = np.zeros(0, np.int64), np.zeros((0, before.shape[1]), np.uint8)
    for low, high in rounds:
        active = np.flatnonzero(np.bincount(rows, minlength=graphs) < goal)
        if not len(active):
            break
        drawn_rows = np.repeat(active, high - low + 1)
        attempts = np.tile(np.arange(low, high + 1), len(active))
        drawn = _drawn(before[drawn_rows], _start_states(prefixes, drawn_rows, attempts))
        rows, paths = np.concatenate([rows, drawn_rows]), np.concatenate([paths, drawn])
        kept = _first_of_equals(rows, paths)
        rows, paths = rows[kept], paths[kept]
    order = np.argsort(rows, kind="stable")
    rows, paths = rows[order], paths[order]
    kept = _within(rows) < n
    return rows[kept], paths[kept]


def _listed(rows: np.ndarray, paths: np.ndarray, graphs: np.ndarray) -> pa.Array:
    """The orderings of each graph as a list<list<int>> array."""
    ends = np.searchsorted(rows, np.append(graphs, graphs[-1] + 1)).astype(np.int32)
    starts = np.arange(len(paths) + 1, dtype=np.int32) * paths.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.ListArray.from_arrays(pa.array(starts), pa.array(paths.astype(np.int32).ravel())))


def _prefix(seed: int, key: str | None) -> bytes:
    return (f"{seed}|" if key is None else f"{seed}|{key}|").encode()


def orderings_of(
    nodes: np.ndarray, edges: pa.Array, caps: np.ndarray, sample: np.ndarray, keys: list[str | None], n: int, seed: int,
    rounds: list[tuple[int, int]],
) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(graphs, their orderings) in parts that hold every graph with nodes once.

    ``edges`` lists the codes per graph. Sampled graphs draw n orderings with seed and key, the
    others list their first ``caps``. No graph has a cycle.
    """
    ends, codes = edges.offsets.to_numpy(), edges.values.to_numpy(zero_copy_only=False)
    for count in np.unique(nodes[nodes > 0]).tolist():
        for drawn in (False, True):
            of_size = np.flatnonzero((nodes == count) & (sample == drawn))
            each = max(1, CELLS // (2 * n * count)) if drawn else max(1, len(of_size))
            for i in range(0, len(of_size), each):
                part = of_size[i : i + each]
                at = np.concatenate([np.arange(ends[g], ends[g + 1]) for g in part])
                before = predecessors(count, ends[part + 1] - ends[part], codes[at])
                if drawn:
                    found = [sampled(before, [_prefix(seed, keys[g]) for g in part], n, rounds)]
                else:
                    found = enumerated(before, caps[part])
                for rows, paths in found:
                    graphs = np.unique(rows)
                    yield part[graphs], _listed(rows, paths, graphs)


def add_orderings(n: int, seed: int, rounds: list[tuple[int, int]], batches):
    """Batches whose last five columns, nodes, edges, cap, sample and key, give way to ``orderings``.

    Rows come in any order; those with 0 nodes have null for orderings.
    """
    for batch in batches:
        nodes, edges, caps, sample, keys = batch.columns[-5:]
        kept = batch.select(range(batch.num_columns - 5))
        schema = kept.schema.append(pa.field("orderings", pa.list_(pa.list_(pa.int32()))))
        nodes = nodes.to_numpy(zero_copy_only=False)
        none = pa.array(np.flatnonzero(nodes == 0))
        if len(none):
            yield pa.RecordBatch.from_arrays([*kept.take(none).columns, pa.nulls(len(none), schema[-1].type)], schema=schema)
        parts = orderings_of(
            nodes, edges, caps.to_numpy(zero_copy_only=False), sample.to_numpy(zero_copy_only=False), keys.to_pylist(), n, seed, rounds
        )
        for graphs, found in parts:
            yield pa.RecordBatch.from_arrays([*kept.take(pa.array(graphs)).columns, found], schema=schema)


def _smallest(nodes: int, src: list[int], dst: list[int]) -> list[int] | None:
    """The smallest ordering of a graph; None if it has a cycle."""
    open_edges, after = [0] * nodes, [[] for _ in range(nodes)]
    for a, b in zip(src, dst, strict=True):
        open_edges[b] += 1
        after[a].append(b)
    ready = [v for v in range(nodes) if not open_edges[v]]
    path = []
    while ready:
        path.append(v := heapq.heappop(ready))
        for w in after[v]:
            open_edges[w] -= 1
            if not open_edges[w]:
                heapq.heappush(ready, w)
    return path if len(path) == nodes else None


def _searched(nodes: int, src: list[int], dst: list[int], cap: int) -> np.ndarray:
    """The first ``cap`` orderings of one acyclic graph of any size, one after the other."""
    before, after = [0] * nodes, [[] for _ in range(nodes)]
    for a, b in zip(src, dst, strict=True):
        before[b] |= 1 << a
        after[a].append(b)
    found, path = [], []
    steps = [([v for v in range(nodes) if not before[v]], 0, 0)]
    while steps:
        ready, i, placed = steps.pop()
        if i < len(ready):
            steps.append((ready, i + 1, placed))
            v = ready[i]
            path.append(v)
            placed |= 1 << v
            unlocked = [w for w in after[v] if not before[w] & ~placed]
            steps.append((sorted([*ready[:i], *ready[i + 1 :], *unlocked]), 0, placed))
            continue
        if len(path) == nodes:
            found.append(path[:])
            if len(found) >= cap:
                break
        if path:
            path.pop()
    return np.array(found, np.int64).reshape(len(found), nodes)


def _behind(firsts: list[np.ndarray], edges: list[tuple[np.ndarray, np.ndarray]], caps: np.ndarray, tail: int) -> list[np.ndarray]:
    """Per graph the first ``caps`` ways to arrange the last ``tail`` nodes of its smallest ordering."""
    ends = np.stack([np.sort(first[len(first) - tail :]) for first in firsts])
    local = np.full((len(firsts), max(map(len, firsts))), -1)
    np.put_along_axis(local, ends, np.arange(tail)[None, :], axis=1)
    rows = np.repeat(np.arange(len(firsts)), [len(src) for src, _ in edges])
    src, dst = (local[rows, np.concatenate([e[k] for e in edges])] for k in (0, 1))
    among = (src >= 0) & (dst >= 0)
    rows, src, dst = rows[among], src[among], dst[among]
    if tail > BITS:
        parts = [rows == g for g in range(len(firsts))]
        return [ends[g][_searched(tail, src[of].tolist(), dst[of].tolist(), caps[g])] for g, of in enumerate(parts)]
    before = np.zeros((len(firsts), tail), np.uint64)
    np.bitwise_or.at(before, (rows, dst), np.uint64(1) << src.astype(np.uint64))
    found = [ends[:0]] * len(firsts)
    for of, paths in enumerated(before, caps):
        graphs, starts = np.unique(of, return_index=True)
        for g, part in zip(graphs.tolist(), np.split(paths, starts[1:]), strict=True):
            found[g] = ends[g][part]
    return found


def first_orderings(nodes: list[int | None], codes: list[np.ndarray], caps: list[int]) -> list[np.ndarray]:
    """Per graph its first ``caps`` orderings, an array with a row for each; none for a graph with a cycle.

    Orderings that begin like the smallest one come before all others. So the last TAIL nodes of it alone
    are arranged first, of all graphs together, then twice as many of those that have too few that way.
    """
    found = [np.zeros((0, n or 0), np.int64) for n in nodes]
    edges, firsts = {}, {}
    for g, n in enumerate(nodes):
        if not n:
            # A graph without nodes has one empty ordering.
            found[g] = np.zeros((min(1, caps[g]) if n == 0 else 0, 0), np.int64)
            continue
        src, dst = codes[g] // n, codes[g] % n
        first = _smallest(n, src.tolist(), dst.tolist())
        if first is not None and caps[g] > 0:
            edges[g], firsts[g] = (src, dst), np.array(first)
    tail, waiting = TAIL, list(firsts)
    while waiting:
        for size in {min(tail, nodes[g]) for g in waiting}:
            part = [g for g in waiting if min(tail, nodes[g]) == size]
            # Wide graphs take a row of their own length, so they are not put beside others.
            for of in ([g] for g in part) if tail > BITS else [part]:
                arranged = _behind([firsts[g] for g in of], [edges[g] for g in of], np.array([caps[g] for g in of]), size)
                for g, ways in zip(of, arranged, strict=True):
                    head = firsts[g][: nodes[g] - size]
                    found[g] = np.concatenate([np.broadcast_to(head, (len(ways), len(head))), ways], axis=1)
        waiting = [g for g in waiting if len(found[g]) < caps[g] and tail < nodes[g]]
        tail *= 2
    return found


def _as_lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    inner = np.concatenate([[0], np.cumsum(np.repeat([f.shape[1] for f in found], [len(f) for f in found]))])
    values = np.concatenate([f.astype(np.int32).ravel() for f in found])
    listed = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)


def listed_first(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The orderings for arrays of node counts, edge codes and caps, in order of the graphs and in parts
    of whole graphs that hold some CELLS cells at most."""
    for counts, edges, caps in batches:
        nodes, caps = counts.to_pylist(), caps.to_pylist()
        cells = np.cumsum([(n or 0) * cap for n, cap in zip(nodes, caps, strict=True)])
        cuts = np.flatnonzero(np.diff(cells // CELLS)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(nodes)], strict=True):
            codes = [np.array(edges[i].as_py() or [], np.int64) for i in range(start, stop)]
            yield _as_lists(first_orderings(nodes[start:stop], codes, caps[start:stop]))
