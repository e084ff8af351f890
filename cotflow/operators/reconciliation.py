"""Differences between id sets of dataset files from small tables, without moving the ids.

Every file becomes an invertible Bloom table: an id falls into one cell of each of three parts,
and a cell holds how many rows fell into it with the sums of their id hashes. Tables of parts of a
file add up, so one aggregate with a partial step before its exchange moves cells only. The table
of a file less that of the reference file holds nothing but the ids whose row counts differ; a cell
that holds one such id gives it away, and taking it out of its other cells bares the next. The
hashes found this way pick the few rows that are then compared exactly.

A difference too large for the table leaves cells behind. Those files, and only those, are compared
by the aggregate over ids of ``consistency.id_differences``.

Defined results: the same rows as ``id_differences``. Null ids take no part, repeated ids count
once, a named file without rows lacks every id of the reference file, an unknown reference file is
an error, and an empty table has no differences. Two ids count as one only if both of their 64-bit
hashes agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cotflow.operators.consistency import file_names, id_differences
from cotflow.session import stage_path

PARTS = 3
SUMS = ("low", "high", "low2", "high2", "check")
PEELED = "file string, key long, left boolean"
LOW = 0xFFFFFFFF
BROADCAST_KEYS = 1_000_000  # key hashes of 8 bytes that are copied to every task


def id_cells(rows: DataFrame, cell_bits: int) -> DataFrame:
    """(file, cell, n, sums): the tables of all files, cells without rows left out.

    Hashes are summed by halves of 32 bits, which a long holds for two billion rows of a cell.
    """
    keyed = rows.where(F.col("id").isNotNull()).select(
        "file", F.xxhash64("id").alias("key"), F.xxhash64("id", F.lit("second")).alias("key2")
    )
    places = F.array(
        *[
            F.shiftrightunsigned("key", part * cell_bits).bitwiseAND((1 << cell_bits) - 1)
            + (part << cell_bits)
            for part in range(PARTS)
        ]
    )
    celled = keyed.select(
        "file",
        F.explode(places.cast("array<int>")).alias("cell"),
        F.col("key").bitwiseAND(LOW).alias("low"),
        F.shiftrightunsigned("key", 32).alias("high"),
        F.col("key2").bitwiseAND(LOW).alias("low2"),
        F.shiftrightunsigned("key2", 32).alias("high2"),
        F.crc32(F.col("key").cast("string").cast("binary")).alias("check"),
    )
    return celled.groupBy("file", "cell").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS]
    )


def cells_beyond(cells: DataFrame, others: list[str], reference: str) -> DataFrame:
    """Per other file its table less the reference file's; cells that cancel are left out."""
    names = F.array(*[F.lit(f) for f in others]).cast("array<string>")
    values = ("n", *SUMS)
    taken = cells.where(F.col("file") == reference).select(
        F.explode(names).alias("file"), "cell", *[(-F.col(c)).alias(c) for c in values]
    )
    own = cells.where(F.col("file").isin(others))
    summed = own.unionByName(taken).groupBy("file", "cell").agg(*[F.sum(c).alias(c) for c in values])
    nothing = F.lit(True)
    for c in values:
        nothing = nothing & (F.col(c) == 0)
    return summed.where(~nothing)


def _single(values: list[int], cell: int, cell_bits: int) -> tuple[int, ...] | None:
    """The hashes of a cell that holds copies of one id, otherwise None."""
    n = values[0]
    if n == 0 or any(v % n for v in values[1:]):
        return None
    low, high, low2, high2, check = (v // n for v in values[1:])
    if not all(0 <= v <= LOW for v in (low, high, low2, high2)):
        return None
    key = high << 32 | low
    if cell not in _places(key, cell_bits) or zlib.crc32(str(_signed(key)).encode()) != check:
        return None
    return low, high, low2, high2, check


def _places(key: int, cell_bits: int) -> list[int]:
    mask = (1 << cell_bits) - 1
    return [(key >> part * cell_bits & mask) + (part << cell_bits) for part in range(PARTS)]


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def peel(cells: Iterable[tuple[int, ...]], cell_bits: int) -> tuple[list[int], bool]:
    """The hashes of (cell, n, sums) rows of one file, and whether anything is left over."""
    table = {row[0]: list(row[1:]) for row in cells}
    found: set[int] = set()
    waiting = list(table)
    while waiting:
        cell = waiting.pop()
        values = table.get(cell)
        single = values and _single(values, cell, cell_bits)
        if not single:
            continue
        key = single[1] << 32 | single[0]
        if key in found:  # no id can be bared twice: the cells do not belong together
            break
        found.add(key)
        n = values[0]
        for place in _places(key, cell_bits):
            rest = table.setdefault(place, [0] * (1 + len(SUMS)))
            rest[0] -= n
            for i, hashed in enumerate(single, 1):
                rest[i] -= n * hashed
            if any(rest):
                waiting.append(place)
            else:
                del table[place]
    return [_signed(k) for k in found], bool(table)


def peeled_keys(beyond: DataFrame, cell_bits: int) -> DataFrame:
    """(file, key, left): id hashes whose row counts differ; one row with ``left`` where peeling
    stopped. A group is one file's table, at most 3 * 2^cell_bits rows."""

    def peel_file(cells: pd.DataFrame) -> pd.DataFrame:
        rows = cells[["cell", "n", *SUMS]].itertuples(index=False, name=None)
        keys, left = peel(rows, cell_bits)
        out = pd.DataFrame({"key": pd.array([*keys, *[None] * left], "Int64")})
        out["file"] = cells["file"].iloc[0]
        out["left"] = [False] * len(keys) + [True] * left
        return out[["file", "key", "left"]]

    return beyond.groupBy("file").applyInPandas(peel_file, PEELED)


def reconcile_ids(
    rows: DataFrame,
    files: list[str] | None = None,
    reference_file: str | None = None,
    cell_bits: tuple[int, ...] = (11, 15),
) -> DataFrame:
    """(file, side, id) as ``id_differences`` gives them; ``file`` and ``id`` are read from rows.

    A table of 3 * 2^b cells gives up some 2.4 * 2^b differing ids per file. Files with more go on
    to the next size in ``cell_bits``, and after the last to the comparison of all their ids. What
    peeling found is stored, so that the path of every file is known before ids are compared.
    """
    if not all(1 <= bits <= 21 for bits in cell_bits):
        raise ValueError("cell_bits must be 1 to 21: three places are cut from one hash")
    names = sorted(files) if files is not None else file_names(rows)
    if reference_file is not None and names and reference_file not in names:
        raise ValueError(f"no dataset file {reference_file!r}")
    reference = reference_file or (names[0] if names else "")
    unsolved = others = [f for f in names if f != reference]
    spark = rows.sparkSession
    named = rows.select("file", "id")
    keys = spark.createDataFrame([], "key long")
    for bits in cell_bits:
        if not unsolved:
            break
        path = stage_path(spark, "reconciled")
        cells = id_cells(named.where(F.col("file").isin([reference, *unsolved])), bits)
        peeled_keys(cells_beyond(cells, unsolved, reference), bits).write.parquet(path)
        peeled = spark.read.schema(PEELED).parquet(path)
        left = {r["file"] for r in peeled.where("left").select("file").distinct().collect()}
        solved = [f for f in unsolved if f not in left]
        keys = keys.unionByName(peeled.where(F.col("file").isin(solved)).select("key"))
        unsolved = [f for f in unsolved if f in left]

    # Differing counts may be those of repeated rows: presence is compared on the ids themselves.
    keys = keys.distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    solved = [reference, *[f for f in others if f not in unsolved]]
    suspects = named.where(F.col("file").isin(solved)).join(
        keys, F.xxhash64(named["id"]) == F.col("key"), "left_semi"
    )
    found = id_differences(suspects, solved, reference)
    if unsolved:
        rest = named.where(F.col("file").isin([reference, *unsolved]))
        found = found.unionByName(id_differences(rest, [reference, *unsolved], reference))
    return found
