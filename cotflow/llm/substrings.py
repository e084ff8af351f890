"""Substring deduplication: a count-min prefilter, then exact groups of what it lets through.

A window is WINDOW consecutive words of one document. A word is removed when it lies in a window
whose word sequence also starts earlier: in a document with a smaller id, or earlier in the same.

1. Documents are packed into units and stored once, bucketed by unit, so that every later step
   reads its unit in place and only small messages are exchanged. Units grow with the table
   (``unit_size``), so that messages, one per unit and range of hashes, stay in proportion to it.
2. Every unit sketches its windows: DEPTH rows of hash cells with counts that stop at two. Sketches
   are sent cell range by cell range, merged, and each unit learns which of its cells hold two or
   more windows of the whole table. A window whose cells all do is estimated repeated. Estimates
   are never below the true counts, so no repeated window is lost; a false alarm costs one message.
3. Each unit sends the first of every estimated-repeated window (128-bit hash, id, place) to the
   window's group, which finds the earliest start exactly and answers who is not the first.
4. Each unit cuts its words.

Within a unit equal windows are merged before anything is sent, so a group of copies, a frequent
line or a hot source costs one message per unit. Message sizes follow the number of windows; every
group of messages holds a bounded hash range.

Defined results: a null text has no words and stays null; texts shorter than a window are never
cut; a null id counts as the smallest; of rows with the same id one counts as earlier, the one
met first in the stored units. The empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cotflow.llm.batches import Texts, arrow_schema, blocks, covered, prefix_sums, window_hashes, window_starts
from cotflow.llm.frames import shuffle_parts
from cotflow.session import stage_path, stage_table

WINDOW = 20
UNIT_BYTES, MAX_UNIT_BYTES = 1_000_000, 8_000_000  # text; a task needs some thirty times a unit
UNITS = 1000  # as many as a table has before its units grow
BUCKET_BYTES = 64_000_000  # text per bucket of stored units
MAX_BUCKETS = 100_000  # what Spark allows unless told otherwise
DEPTH = 2
CELLS_PER_WINDOW = 8  # and row; more cells, fewer false alarms, longer messages
RANGE_CELLS = 2_000_000  # messages are grouped by ranges of about so many used cells
NO_ID = -(2**63)

UNIT = "unit long, windows long, ids binary, known binary, offsets binary, body binary, others binary"
MESSAGE = "unit long, part long, payload binary"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, each split into byte planes, which compress well."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(payload: bytes, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n = len(raw) // sum(widths)
    out, at = [], 0
    for width, kind in zip(widths, types, strict=True):
        planes = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def _gaps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from 0."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


@dataclass
class Unit:
    """The documents of a unit, in order of id and then of arrival."""

    number: int
    ids: np.ndarray
    known: np.ndarray  # 0: id was null, 1: usual, 2: text was null
    texts: Texts

    @classmethod
    def of(cls, row: dict) -> Unit:
        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        return cls(
            row["unit"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8),
            Texts.of_bytes(body, np.frombuffer(row["offsets"], np.int64)),
        )

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per window: first word, row, and two hashes; in order of (id, place)."""
        t = self.texts
        starts, rows = window_starts(t.first_word[:-1], t.n_words, size)
        if not len(starts):
            none = np.zeros(0, np.uint64)
            return starts, rows, none, none
        words = t.word_hashes()
        return starts, rows, window_hashes(words, starts, size), window_hashes(words, starts, size, 1)


ID, TEXT = "__unit_id", "__unit_text"


def units(docs: DataFrame, size: int, unit_bytes: int, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """Rows of UNIT; a unit's texts are compressed together, and so are the other columns."""

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        for part, texts in blocks(batches, TEXT, unit_bytes):
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            text = part.column(1).fill_null("").take(pa.array(order))
            ordered = Texts(text)
            known = np.where(part.column(0).is_valid().to_numpy(zero_copy_only=False), 1, 0)
            known = np.where(part.column(1).is_valid().to_numpy(zero_copy_only=False), known, known + 2)
            body = zstandard.ZstdCompressor(level=3).compress(ordered.data.tobytes())
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "unit": number,
                        "windows": int(np.maximum(texts.n_words - size + 1, 0).sum()),
                        "ids": ids[order].astype(np.int64).tobytes(),
                        "known": known[order].astype(np.uint8).tobytes(),
                        "offsets": ordered.offsets.astype(np.int64).tobytes(),
                        "body": body,
                        "others": _as_bytes(part.select(others).take(pa.array(order))) if others else None,
                    }
                ],
                schema=arrow_schema(UNIT),
            )
            number += 1

    columns = [docs[id_col].cast("long").alias(ID), docs[text_col].alias(TEXT), *[docs[c] for c in others]]
    return docs.select(*columns).mapInArrow(build, UNIT)


def _as_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _as_batch(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)) as reader:
        return reader.read_next_batch()


def unit_size(n_bytes: int) -> int:
    """Bytes of text per unit in a table of n_bytes."""
    return min(MAX_UNIT_BYTES, max(UNIT_BYTES, n_bytes // UNITS))


def bucket_count(n_bytes: int, least: int) -> int:
    return min(MAX_BUCKETS, max(least, math.ceil(n_bytes / BUCKET_BYTES)))


def _bucketed(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    """rows stored in the shared folder in n buckets by unit."""
    name = stage_table(spark, "substring_units")
    (
        rows.repartition(n, "unit").write.format("parquet").option("compression", "none")
        .option("path", stage_path(spark, name)).bucketBy(n, "unit").saveAsTable(name)
    )
    return spark.table(name)


@dataclass(frozen=True)
class Shape:
    """Cells per sketch row and how rows are dealt in ranges: both powers of two."""

    window: int
    cell_bits: int
    part_bits: int

    @classmethod
    def of(cls, n_windows: int, window: int) -> Shape:
        cells = max(10, math.ceil(math.log2(max(1, n_windows) * CELLS_PER_WINDOW)))
        parts = max(0, math.ceil(math.log2(max(1, n_windows * DEPTH / RANGE_CELLS))))
        return cls(window, cells, min(parts, cells))

    def cells(self, first: np.ndarray, second: np.ndarray, row: int) -> np.ndarray:
        mixed = first if row == 0 else second if row == 1 else first + np.uint64(row) * second
        return mixed >> np.uint64(64 - self.cell_bits)

    def part(self, cells: np.ndarray) -> np.ndarray:
        return (cells >> np.uint64(self.cell_bits - self.part_bits)).astype(np.int64)


def _messages(unit: int, parts: np.ndarray, first_part: int, pack_range) -> list[dict]:
    """One message per part; ``parts`` ascends."""
    edges = np.flatnonzero(np.diff(parts, prepend=-1, append=2**62))
    return [
        {"unit": unit, "part": first_part + int(parts[a]), "payload": pack_range(a, b)}
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(schema))


def sketch_messages(unit: Unit, shape: Shape) -> list[dict]:
    """Part numbers of sketch row r start at r << part_bits. Payload: cell gaps, counts up to two."""
    _, _, first, second = unit.windows(shape.window)
    out = []
    for row in range(DEPTH):
        cells, counts = np.unique(shape.cells(first, second, row), return_counts=True)
        twice = (counts > 1).astype(np.uint8)

        def payload(a, b, cells=cells, twice=twice):
            return _with_flags(cells[a:b], twice[a:b])

        out += _messages(unit.number, shape.part(cells), row << shape.part_bits, payload)
    return out


def _with_flags(cells: np.ndarray, flags: np.ndarray) -> bytes:
    """Cells and one flag each, the flag as the lowest bit of the gap."""
    return pack(_gaps(cells) * np.uint64(2) + flags.astype(np.uint64))


def _cells_and_flags(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    (coded,) = unpack(payload, np.uint64)
    return np.cumsum(coded >> np.uint64(1)), (coded & np.uint64(1)).astype(np.uint8)


def merge_sketches(table: pa.Table) -> pa.Table:
    """Merged counts of one range of cells; to each unit a bit per cell: two or more windows."""
    got = [_cells_and_flags(p) for p in table.column("payload").to_pylist()]
    cells = np.concatenate([c for c, _ in got])
    counts = np.concatenate([f for _, f in got]) + np.uint8(1)
    distinct, at = np.unique(cells, return_inverse=True)
    repeated = np.bincount(at, counts) > 1
    answers, place = [], 0
    for own, _ in got:
        answers.append(np.packbits(repeated[at[place : place + len(own)]]).tobytes())
        place += len(own)
    return pa.table([table.column("unit"), table.column("part"), pa.array(answers, pa.binary())], schema=arrow_schema(MESSAGE))


def estimated_repeated(unit: Unit, shape: Shape, answers: dict[int, bytes], first, second) -> np.ndarray:
    """Which windows every sketch row counts twice or more."""
    out = np.ones(len(first), bool)
    for row in range(DEPTH):
        cells, at = np.unique(shape.cells(first, second, row), return_inverse=True)
        parts = shape.part(cells)
        edges = np.flatnonzero(np.diff(parts, prepend=-1, append=2**62))
        bits = np.zeros(len(cells), bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            answer = answers[(row << shape.part_bits) + int(parts[a])]
            bits[a:b] = np.unpackbits(np.frombuffer(answer, np.uint8), count=b - a)
        out &= bits[at]
    return out


def _first_of_equal(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in order: the index of the first equal item of each, and which are firsts."""
    order = np.lexsort((np.arange(len(first)), second, first))
    head = np.ones(len(order), bool)
    head[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    firsts = order[head]
    leader = np.empty(len(order), np.int64)
    leader[order] = np.repeat(firsts, np.diff(np.append(np.flatnonzero(head), len(order))))
    return leader, leader == np.arange(len(order))


def window_messages(unit: Unit, shape: Shape, answers: dict[int, bytes]) -> list[dict]:
    """Firsts of the estimated-repeated windows: hashes, id, place; by ranges of the first hash."""
    starts, rows, first, second = unit.windows(shape.window)
    at = np.flatnonzero(estimated_repeated(unit, shape, answers, first, second))
    at = at[_first_of_equal(first[at], second[at])[1]]
    parts = shape.part(shape.cells(first[at], second[at], 0))
    order = np.lexsort((at, parts))
    at, parts = at[order], parts[order]

    def payload(a, b):
        own = at[a:b]
        places = starts[own] - unit.texts.first_word[rows[own]]
        return pack(first[own], second[own], unit.ids[rows[own]], places, own)

    return _messages(unit.number, parts, 0, payload)


def find_earliest(table: pa.Table) -> pa.Table:
    """Exact groups of one hash range; to each unit the windows that are not the earliest."""
    got = [unpack(p, np.uint64, np.uint64, np.int64, np.int64, np.int64) for p in table.column("payload").to_pylist()]
    first, second, ids, places = (np.concatenate([g[i] for g in got]) for i in range(4))
    units_of = np.repeat(table.column("unit").to_numpy(), [len(g[0]) for g in got])
    order = np.lexsort((units_of, places, ids, second, first))
    same = np.zeros(len(order), bool)
    same[1:] = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    heads = np.flatnonzero(~same)
    later = np.ones(len(order), bool)
    later[order[heads]] = False
    answers, place = [], 0
    for g in got:
        own = later[place : place + len(g[4])]
        place += len(own)
        answers.append(pack(_gaps(np.sort(g[4][own]))))
    return pa.table([table.column("unit"), table.column("part"), pa.array(answers, pa.binary())], schema=arrow_schema(MESSAGE))


def removed_words(unit: Unit, shape: Shape, answers: list[bytes]) -> np.ndarray:
    """Which words of the unit are covered by a window that starts earlier somewhere."""
    starts, _, first, second = unit.windows(shape.window)
    later = np.zeros(len(starts), bool)
    for payload in answers:
        (gaps,) = unpack(payload, np.int64)
        later[np.cumsum(gaps)] = True
    leader, leads = _first_of_equal(first, second)
    # A window that is not the unit's first of its kind starts earlier in the unit.
    return covered(starts[~leads | later[leader]], shape.window, len(unit.texts.starts))


def _kept_words(texts: Texts, removed: np.ndarray, row: int) -> bytes:
    a, b = texts.first_word[row], texts.first_word[row + 1]
    if not removed[a:b].any():
        return b" ".join(texts.data[texts.offsets[row] : texts.offsets[row + 1]].tobytes().split())
    data = texts.data
    return b" ".join(data[s:e].tobytes() for s, e in zip(texts.starts[a:b][~removed[a:b]], texts.ends[a:b][~removed[a:b]], strict=True))


def _kept_text(texts: Texts, removed: np.ndarray, row: int) -> str:
    """The text without its removed words; a run of them goes with the gap that follows it."""
    a, b = texts.first_word[row], texts.first_word[row + 1]
    begin, end = int(texts.offsets[row]), int(texts.offsets[row + 1])
    cut = removed[a:b]
    if not cut.any():
        return texts.text(row)
    heads = np.flatnonzero(cut & ~np.concatenate([[False], cut[:-1]]))
    tails = np.flatnonzero(cut & ~np.concatenate([cut[1:], [False]])) + 1
    parts, at = [], begin
    for head, tail in zip(heads, tails, strict=True):
        parts.append(texts.data[at : texts.starts[a + head]].tobytes())
        at = int(texts.starts[a + tail]) if a + tail < b else end
    parts.append(texts.data[at:end].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def stored_units(
    docs: DataFrame, window: int, unit_bytes: int | None, id_col: str, text_col: str, others: list[str]
) -> tuple[DataFrame, Shape]:
    """The units, in buckets, and the shape of their sketches; both follow the size of the texts."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    made = units(docs, window, unit_bytes or unit_size(n_bytes), id_col, text_col, others)
    stored = _bucketed(spark, made, bucket_count(n_bytes, shuffle_parts(spark)))
    return stored, Shape.of(stored.agg(F.sum("windows")).first()[0] or 0, window)


def sketched(stored: DataFrame, shape: Shape) -> DataFrame:
    """The sketch messages of all units."""

    def sketches(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(sketch_messages(Unit.of(row), shape), MESSAGE)

    return stored.drop("others").mapInArrow(sketches, MESSAGE)


def _searched(docs: DataFrame, window: int, unit_bytes: int | None, id_col: str, text_col: str, others: list[str]) -> tuple[DataFrame, DataFrame, Shape]:
    """The stored units, and per unit the messages that name its windows which start earlier elsewhere."""
    stored, shape = stored_units(docs, window, unit_bytes, id_col, text_col, others)
    lean = stored.drop("others")
    counted = sketched(stored, shape).groupBy("part").applyInArrow(merge_sketches, MESSAGE)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            answers = dict(zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True))
            out += window_messages(Unit.of(row), shape, answers)
        return pa.Table.from_batches([_batch(out, MESSAGE)])

    sent = lean.groupBy("unit").cogroup(counted.groupBy("unit")).applyInArrow(candidates, MESSAGE)
    return stored, sent.groupBy("part").applyInArrow(find_earliest, MESSAGE), shape


def _removed(unit: Unit, shape: Shape, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the unit's removed words, and how many each text loses."""
    removed = removed_words(unit, shape, right.column("payload").to_pylist())
    sums = prefix_sums(removed)
    return removed, sums[unit.texts.first_word[1:]] - sums[unit.texts.first_word[:-1]]


def deduplicated(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int | None = None,
    digest: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, and the kept text or its digest.

    The digest is the SHA-256 of the kept words joined by one space.
    """
    stored, later, shape = _searched(docs, window, unit_bytes, id_col, text_col, [])
    result = DIGEST if digest else KEPT

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            unit = Unit.of(row)
            removed, gone = _removed(unit, shape, right)
            for i in range(unit.texts.n):
                found = {
                    "doc_id": int(unit.ids[i]) if unit.known[i] & 1 else None,
                    "n_words": int(unit.texts.n_words[i]),
                    "n_removed": int(gone[i]),
                }
                if digest:
                    found["kept_sha256"] = hashlib.sha256(_kept_words(unit.texts, removed, i)).hexdigest()
                else:
                    found["kept_text"] = _kept_text(unit.texts, removed, i) if unit.known[i] < 2 else None
                out.append(found)
        return pa.Table.from_batches([_batch(out, result)])

    return stored.drop("others").groupBy("unit").cogroup(later.groupBy("unit")).applyInArrow(cut, result)


def cut_repeated(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int | None = None
) -> DataFrame:
    """docs, all columns, with repeated words taken out of the texts; texts that lose none stay
    byte for byte. The other columns travel with the unit, so nothing is joined."""
    others = [c for c in docs.columns if c != text_col]
    stored, later, shape = _searched(docs, window, unit_bytes, id_col, text_col, others)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            unit = Unit.of(row)
            removed, _ = _removed(unit, shape, right)
            kept = [_kept_text(unit.texts, removed, i) if unit.known[i] < 2 else None for i in range(unit.texts.n)]
            columns = _as_batch(row["others"])
            tables.append(pa.Table.from_batches([columns]).append_column(text_col, pa.array(kept, pa.string())))
        return pa.concat_tables(tables)

    schema = docs.select(*others, text_col).schema
    return stored.groupBy("unit").cogroup(later.groupBy("unit")).applyInArrow(cut, schema).select(*docs.columns)
