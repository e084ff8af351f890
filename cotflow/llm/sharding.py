"""Histogram sort: shards of near equal bytes along one key order.

Rows are ordered by (digest of the text, id), so equal texts lie side by side. Splitters are found
by probing: one pass counts the exact bytes below every candidate key, and the interval around
each wanted boundary shrinks until a probe meets the tolerance. A boundary that falls into a group
of equal texts too heavy for the tolerance is refined along the ids of that group. Then the rows
are exchanged once and numbered within their shard.

Driver state is a few probes per splitter, never rows: an interval's rows are looked at only when
FEW are left in it. Large shards are numbered in several pieces, whose counts are added up.

Defined results: a null text has no bytes; a null id sorts first and stays null. Rows equal in text
and id share a key, so no splitter parts them and their order among themselves is open. An empty
table gives no rows. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cotflow.llm.batches import arrow_schema
from cotflow.llm.frames import staged

ROW_BYTES = 16  # counted for a row besides its text
TOLERANCE = 0.002  # of a shard's bytes
PROBES = 15  # per splitter and pass
FEW = 64
PIECE_ROWS = 1_000_000
MOST_PIECES = 25  # per shard; larger pieces are sorted with spills
LOWEST, HIGHEST = -(2**63), 2**63 - 1

KEY = ("__shard_key", "__shard_id")


@dataclass
class Plan:
    """Splitters in order: shard s holds the keys from splitter s - 1 up to splitter s.

    ``pieces`` cuts every shard further, only so that no task numbers a whole large shard.
    """

    splitters: list[tuple[int, int]]
    pieces: list[list[tuple[int, int]]]


def key_columns(doc_id: Column, text: Column) -> dict[str, Column]:
    return {
        KEY[0]: F.xxhash64(F.coalesce(text, F.lit(""))),
        KEY[1]: F.coalesce(doc_id.cast("long"), F.lit(LOWEST)),
    }


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES).cast("long")


def _below(rows: DataFrame, column: str, size: str, probes: dict[int, list[int]], group: str | None) -> dict[int, list[tuple[int, int]]]:
    """For every group and probe: exact (bytes, rows) of the group's keys below the probe."""
    groups = sorted(probes)
    numbers = {g: i for i, g in enumerate(groups)}
    edges = [np.array(probes[g], np.int64) for g in groups]
    width = max(len(e) for e in edges) + 1
    schema = "cell int, bytes long, n long"

    def count(batches):
        sums, n = np.zeros(len(groups) * width, np.int64), np.zeros(len(groups) * width, np.int64)
        for batch in batches:
            keys, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            owner = batch.column(2).to_numpy(zero_copy_only=False) if group else None
            for g, own in enumerate(edges):
                mine = slice(None) if owner is None else owner == groups[g]
                cells = np.searchsorted(own, keys[mine], "right")
                sums[g * width : (g + 1) * width] += np.bincount(cells, sizes[mine], width).astype(np.int64)
                n[g * width : (g + 1) * width] += np.bincount(cells, minlength=width)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(sums[used]), pa.array(n[used])], schema=arrow_schema(schema)
        )

    narrow = rows.select(column, size, *([group] if group else []))
    if group:
        narrow = narrow.where(F.col(group).isin(groups))
    cells = narrow.mapInArrow(count, schema).groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    sums, n = np.zeros((len(groups), width), np.int64), np.zeros((len(groups), width), np.int64)
    for r in cells.collect():
        sums[r["cell"] // width, r["cell"] % width] = r["bytes"]
        n[r["cell"] // width, r["cell"] % width] = r["n"]
    bytes_below, rows_below = np.cumsum(sums, axis=1), np.cumsum(n, axis=1)
    return {
        g: [(int(bytes_below[i, j]), int(rows_below[i, j])) for j in range(len(probes[g]))]
        for g, i in numbers.items()
    }


@dataclass
class _Search:
    """One splitter: bytes below ``low`` and ``high`` are known and enclose the target."""

    target: int
    tolerance: float
    group: int
    low: int
    high: int
    below_low: int
    below_high: int
    rows_inside: int
    found: int | None = None
    below_found: int = 0

    def probes(self) -> list[int]:
        """Evenly spaced keys strictly between low and high."""
        span = self.high - self.low
        return sorted({self.low + max(1, span * i // (PROBES + 1)) for i in range(1, PROBES + 1)} - {self.low, self.high})


def _search(rows: DataFrame, column: str, size: str, searches: list[_Search], group: str | None) -> None:
    """Narrow every search until a probe meets its tolerance or neighbouring keys enclose it."""
    rows_below = {(s.group, s.low): 0 for s in searches} | {(s.group, s.high): s.rows_inside for s in searches}
    while open_ := [s for s in searches if s.found is None and s.high - s.low > 1 and s.rows_inside > FEW]:
        wanted: dict[int, set[int]] = {}
        for s in open_:
            wanted.setdefault(s.group, set()).update(s.probes())
        probes = {g: sorted(p) for g, p in wanted.items()}
        counted = _below(rows, column, size, probes, group)
        for s in open_:
            for probe, (below, n) in zip(probes[s.group], counted[s.group], strict=True):
                rows_below[s.group, probe] = n
                if not s.low < probe < s.high:
                    continue
                if abs(below - s.target) <= s.tolerance and (
                    s.found is None or abs(below - s.target) < abs(s.below_found - s.target)
                ):
                    s.found, s.below_found = probe, below
                if below <= s.target:
                    s.low, s.below_low = probe, below
                else:
                    s.high, s.below_high = probe, below
                    break
            s.rows_inside = rows_below[s.group, s.high] - rows_below[s.group, s.low]


def plan_shards(rows: DataFrame, size: str, shards: int, tolerance: float = TOLERANCE) -> Plan:
    """Splitters for rows that have the KEY columns and a size column; several passes over it."""
    total = rows.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return Plan([(HIGHEST, HIGHEST)] * (shards - 1), [[] for _ in range(shards)])
    pieces = min(MOST_PIECES, -(-total["n"] // (shards * PIECE_ROWS)))
    share = total["bytes"] / (shards * pieces)
    searches = [
        # Where a piece ends inside its shard matters little.
        _Search(
            round(share * i), share * (0.2 if i % pieces else tolerance * pieces), 0,
            LOWEST, HIGHEST, 0, total["bytes"], total["n"],
        )
        for i in range(1, shards * pieces)
    ]
    _search(rows, KEY[0], size, searches, None)
    splitters: list[tuple[int, int] | None] = [(s.found, LOWEST) if s.found is not None else None for s in searches]

    # Few rows left between the probes: look at their keys.
    few = [i for i, s in enumerate(searches) if s.found is None and s.rows_inside <= FEW]
    if few:
        near = reduce(lambda a, b: a | b, [F.col(KEY[0]).between(searches[i].low, searches[i].high - 1) for i in few])
        seen = sorted((r[KEY[0]], r[KEY[1]], r[size]) for r in rows.where(near).select(*KEY, size).collect())
        for i in few:
            s = searches[i]
            splitters[i] = _closest(
                [(k, d, n) for k, d, n in seen if s.low <= k < s.high], s.below_low, s.target, (s.high, LOWEST), s.tolerance
            )

    # The rest lie inside groups of equal texts: refine along the ids.
    heavy = [i for i, x in enumerate(splitters) if x is None]
    if heavy:
        inner = [
            _Search(
                searches[i].target - searches[i].below_low, searches[i].tolerance, searches[i].low, LOWEST, HIGHEST,
                0, searches[i].below_high - searches[i].below_low, searches[i].rows_inside,
            )
            for i in heavy
        ]
        _search(rows, KEY[1], size, inner, KEY[0])
        for i, s in zip(heavy, inner, strict=True):
            if s.found is not None:
                splitters[i] = (s.group, s.found)
                continue
            if s.rows_inside > FEW:  # one id repeated: cannot be split
                ahead = s.target - s.below_low <= s.below_high - s.target
                splitters[i] = (s.group, s.low if ahead else s.high)
                continue
            left = rows.where((F.col(KEY[0]) == s.group) & F.col(KEY[1]).between(s.low, s.high - 1)).select(*KEY, size)
            seen = sorted((r[KEY[0]], r[KEY[1]], r[size]) for r in left.collect())
            splitters[i] = _closest(seen, s.below_low, s.target, (s.group, s.high), 0.0)
    splitters = [*splitters, (HIGHEST, HIGHEST)]
    return Plan(
        [max(splitters[: i + 1]) for i in range(pieces - 1, len(splitters) - 1, pieces)],
        [sorted(splitters[i : i + pieces - 1]) for i in range(0, len(splitters), pieces)],
    )


def _closest(rows, below: int, target: int, end: tuple[int, int], tolerance: float) -> tuple[int, int]:
    """The key at which the bytes below are nearest to the target; whole groups if tolerable."""
    ways = []
    for i, (key, doc_id, size) in enumerate(rows):
        if i == 0 or rows[i - 1][:2] != (key, doc_id):
            between = i == 0 or rows[i - 1][0] != key
            ways.append((abs(below - target), (key, LOWEST) if between else (key, doc_id), between))
        below += size
    ways.append((abs(below - target), end, True))
    whole = min((w for w in ways if w[2]), key=lambda w: w[0])
    return (whole if whole[0] <= tolerance else min(ways, key=lambda w: w[0]))[1]


def _rank(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters lie at or below the row's key."""
    key, doc_id = (F.col(c) for c in KEY)
    passed = [
        ((key > k) | ((key == k) & (doc_id >= d))).cast("int") if d > LOWEST else (key >= k).cast("int")
        for k, d in splitters
    ]
    return reduce(lambda a, b: a + b, passed, F.lit(0))


def apply_plan(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows with shard and slot; one exchange. The KEY columns are dropped."""
    placed = rows.withColumn("shard", _rank(plan.splitters))
    order = Window.partitionBy("shard", "__shard_piece").orderBy(*KEY)
    if not any(plan.pieces):
        placed = placed.withColumn("__shard_piece", F.lit(0))
        numbered = placed.withColumn("slot", F.row_number().over(order).cast("long") - 1)
        return numbered.drop(*KEY, "__shard_piece")
    cuts = F.array(*[F.array(*[F.struct(F.lit(k), F.lit(d)) for k, d in part]) for part in plan.pieces])
    passed = F.filter(F.get(cuts, F.col("shard")), lambda c: c <= F.struct(*[F.col(k) for k in KEY]))
    placed = placed.withColumn("__shard_piece", F.size(passed))
    counts = placed.groupBy("shard", "__shard_piece").count().collect()
    before: dict[int, int] = {}
    offsets = []
    for shard, part, count in sorted(map(tuple, counts)):
        offsets.append((shard, part, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + count
    # At most MOST_PIECES rows per shard.
    known = rows.sparkSession.createDataFrame(offsets, "shard int, __shard_piece int, __shard_before long")
    return (
        placed.withColumn("__shard_slot", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(known), ["shard", "__shard_piece"])
        .withColumn("slot", F.col("__shard_slot") + F.col("__shard_before"))
        .drop(*KEY, "__shard_piece", "__shard_slot", "__shard_before")
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table that is probed: key, size and checksum of every row, stored once."""
    text = docs[text_col]
    return staged(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            row_bytes(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            *[c.alias(name) for name, c in key_columns(docs[id_col], text).items()],
        ),
        "shard-keys",
    )


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs, all columns, with shard and slot."""
    plan = plan_shards(keyed(docs, id_col, text_col), "size", shards, tolerance)
    docs = docs.drop("shard", "slot")
    return apply_plan(docs.withColumns(key_columns(docs[id_col], docs[text_col])), plan)
