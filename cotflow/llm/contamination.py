"""Benchmark items inside documents: size-partitioned MinHash containment search.

Shingles are five consecutive words in lower case; an item of one to four words has its whole word
sequence as its only shingle. An item is in a document when at least THRESHOLD of its distinct
shingles are.

Containment of a short item in a long document is a tiny Jaccard similarity, so the sketch of a
document grows with it: documents are partitioned by their number of shingles into powers of two,
and partition p has 2**(p + 1) registers of a one-permutation MinHash. An item has a sketch of its
own for every partition. Both share a register's value when the smallest hash there is a common
shingle; one such register makes a candidate. A shingle is its register's smallest with a chance
of at least 0.78, so an item that shares SAFE shingles is missed with one in 10**6. Items with
fewer (SHORT) are looked up by all their shingles, the limit of ever more registers. Candidates are
verified by exact containment, on words, not hashes.

Defined results: null and empty items and documents match nothing. Equal items and repeated rows
each give rows of their own. A null id is kept in the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cotflow.llm.batches import Texts, arrow_schema, blocks, mix, window_hashes, window_starts
from cotflow.llm.frames import id_and_text, staged

SHINGLE = 5
THRESHOLD = 0.8
SAFE = 9
SHORT = math.ceil(SAFE / THRESHOLD)  # items with fewer shingles
# Up to so many bytes of items every task gets a copy of them; beyond, sketches are joined.
BROADCAST_BYTES = 8 << 20
# Beyond, shingles of documents meet a Bloom filter of the items' before they are exchanged: at most
# so many words of 64 bits. Fuller filters let more shingles pass, none is lost.
FILTER_WORDS = 1 << 21
RESULT = "doc_id long, item_id long, containment double"
SKETCH = "size_class int, hash long"


def shingle_hashes(texts: Texts, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of the given sizes; a size is part of its hash."""
    hashes = texts.word_hashes() if len(texts.starts) else np.zeros(0, np.uint64)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes:
        starts, owner = window_starts(texts.first_word[:-1], texts.n_words, size)
        if len(starts):
            rows.append(owner)
            found.append(mix(window_hashes(hashes, starts, size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(found)


def size_class(n_shingles: np.ndarray) -> np.ndarray:
    """p such that 2**(p - 1) < n <= 2**p."""
    return np.ceil(np.log2(np.maximum(n_shingles, 1))).astype(np.int64)


def sketch(rows: np.ndarray, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of every filled register; ``classes`` has the partition of each row."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    register = hashes >> (63 - classes[rows]).astype(np.uint64)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (register[1:] != register[:-1])
    return rows[first], hashes[first]


def item_size(words: list[str]) -> int:
    return min(SHINGLE, len(words))


def word_shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def words_of(text: str | None) -> list[str]:
    """Words as the sketches see them."""
    raw = pc.utf8_lower(pa.scalar(text or "")).as_py().encode()
    return [w.decode() for w in raw.split()]


@dataclass
class Item:
    item_id: int | None
    size: int
    shingles: set[tuple[str, ...]]


class Items:
    """The benchmark in memory: per document partition, which hash belongs to which items."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.items: list[Item] = []
        texts = []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            words = words_of(text)
            if words:
                size = item_size(words)
                self.items.append(Item(item_id, size, word_shingles(words, size)))
                texts.append(text)
        self.sizes = sorted({item.size for item in self.items})
        self.texts = texts
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_tables": {}}

    def table(self, size_class: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the items' sketches in a partition, and whose they are."""
        if size_class not in self._tables:
            owners, hashes = item_sketches(self.texts, size_class)
            order = np.argsort(hashes, kind="stable")
            self._tables[size_class] = hashes[order], owners[order]
        return self._tables[size_class]

    def find(self, texts: Texts) -> list[tuple[int, int, float]]:
        """(row, item number, containment) of every verified match, in order."""
        if not self.items:
            return []
        rows, hashes = shingle_hashes(texts, self.sizes)
        classes = size_class(np.bincount(rows, minlength=texts.n))
        kept = sketch(rows, hashes, classes)
        candidates = set()
        for exact, (at, found) in ((False, kept), (True, (rows, hashes))):
            for p in np.unique(classes) if not exact else [-1]:
                table, owners = self.table(int(p))
                if not len(table):
                    continue
                mine = slice(None) if exact else classes[at] == p
                own_rows, own = at[mine], found[mine]
                place = np.minimum(np.searchsorted(table, own), len(table) - 1)
                hits = np.flatnonzero(table[place] == own)
                ends = np.searchsorted(table, own[hits], "right")
                for row, low, high in zip(own_rows[hits], place[hits], ends, strict=True):
                    candidates.update((int(row), int(owner)) for owner in owners[low:high])
        out = []
        row, words = -1, []
        for at, number in sorted(candidates):
            if at != row:
                row, words = at, [w.decode() for w in texts.text(at).encode().split()]
            share = containment(self.items[number], words)
            if share >= THRESHOLD:
                out.append((at, number, share))
        return out


def containment(item: Item, words: list[str]) -> float:
    return len(item.shingles & word_shingles(words, item.size)) / len(item.shingles)


def item_sketches(texts: list[str], size_class: int) -> tuple[np.ndarray, np.ndarray]:
    """(item number, hash): long items in a partition's registers, or (at -1) all of the short."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if texts:
        block = Texts(pc.utf8_lower(pa.array(texts)))
        for size in range(1, SHINGLE + 1):
            own = np.minimum(block.n_words, SHINGLE) == size
            rows, found = shingle_hashes(block, [size])
            rows, found = rows[own[rows]], found[own[rows]]
            if not len(rows):
                continue
            distinct = np.bincount(np.unique(np.stack([rows, found.view(np.int64)]), axis=1)[0], minlength=block.n)
            short = distinct[rows] < SHORT
            if size_class < 0:
                owners.append(rows[short])
                hashes.append(found[short])
            else:
                at, kept = sketch(rows[~short], found[~short], np.full(block.n, size_class))
                owners.append(at)
                hashes.append(kept)
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    if not len(owner):
        return owner, found
    pairs = np.unique(np.stack([owner, found.view(np.int64)]), axis=1)
    return pairs[0], np.ascontiguousarray(pairs[1]).view(np.uint64)


def small_items(items: DataFrame, item_id: str, text_col: str) -> Items | None:
    """The items in memory if their size, measured first, allows it."""
    size = items.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count("*").alias("n")).first()
    if (size["bytes"] or 0) + 64 * size["n"] > BROADCAST_BYTES:
        return None
    rows = items.select(items[item_id].cast("long").alias("item_id"), items[text_col].alias("text")).collect()
    return Items([(r["item_id"], r["text"]) for r in rows])


def contained_items(
    docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"
) -> DataFrame:
    """One row per document row and item it contains, with the columns of RESULT."""
    known = small_items(items, item_id, item_text)
    rows = id_and_text(docs, id_col, text_col)
    if known is None:
        return _joined(rows, items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("text")))
    schema = arrow_schema(RESULT)

    def search(batches):
        for part, texts in blocks(batches, "text", lower=True):
            found = known.find(texts)
            ids = part.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"doc_id": ids[r], "item_id": known.items[i].item_id, "containment": c} for r, i, c in found],
                schema=schema,
            )

    return rows.mapInArrow(search, RESULT)


def filter_places(classes: np.ndarray, hashes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of every (size class, hash), and its three bits there."""
    mixed = mix(hashes ^ mix(classes.astype(np.int64).view(np.uint64) + np.uint64(2)))
    one, six = np.uint64(1), np.uint64(63)
    mask = one << (mixed >> np.uint64(58)) | one << (mixed >> np.uint64(52) & six) | one << (mixed >> np.uint64(46) & six)
    return (mixed & np.uint64(n_words - 1)).astype(np.int64), mask


def item_filter(sketches: DataFrame) -> np.ndarray:
    """A Bloom filter of SKETCH rows, some sixteen bits for each as long as FILTER_WORDS allows."""
    n_words = min(FILTER_WORDS, 1 << max(10, math.ceil(math.log2(sketches.count() / 4 + 1))))

    def places(batches):
        for batch in batches:
            classes, hashes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            words, mask = filter_places(classes, hashes.view(np.uint64), n_words)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(mask.view(np.int64))], names=["word", "mask"])

    placed = sketches.select("size_class", "hash").mapInArrow(places, "word long, mask long")
    merged = placed.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(n_words, np.uint64)
    out[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    return out


def passes(bloom: np.ndarray, classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    words, mask = filter_places(classes, hashes, len(bloom))
    return bloom[words] & mask == mask


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same search when the items are too many to copy: sketches meet in a join."""
    n_words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    lengths = items.select(F.least(n_words, F.lit(SHORT + SHINGLE)).alias("n")).where("n > 0").distinct()
    lengths = [r["n"] for r in lengths.collect()]
    sizes = sorted({min(n, SHINGLE) for n in lengths})
    right = staged(items.mapInArrow(_item_rows, f"item_id long, {SKETCH}").distinct(), "contamination-items")
    short = not right.where("size_class = -1").isEmpty()
    bloom = item_filter(right)

    def doc_sketches(batches):
        for part, texts in blocks(batches, "text", lower=True):
            rows, hashes = shingle_hashes(texts, sizes)
            classes = size_class(np.bincount(rows, minlength=texts.n))
            at, kept = sketch(rows, hashes, classes)
            known = passes(bloom, classes[at], kept)
            yield _rows(part, at[known], classes[at[known]], kept[known])
            if short:
                every = np.full(len(rows), -1)
                known = passes(bloom, every, hashes)
                yield _rows(part, rows[known], every[known], hashes[known])

    left = docs.mapInArrow(doc_sketches, f"doc_id long, {SKETCH}").distinct()
    pairs = left.join(right, ["size_class", "hash"]).select("doc_id", "item_id").distinct()
    texts = docs.select(F.col("doc_id").alias("of_doc"), "text")
    items = items.select(F.col("item_id").alias("of_item"), F.col("text").alias("item_text"))
    both = (
        pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("of_doc")))
        .join(items, F.col("item_id").eqNullSafe(F.col("of_item")))
        .select("doc_id", "item_id", "text", "item_text")
    )

    def verify(batches):
        for batch in batches:
            out = []
            for doc_id, number, text, item_text in zip(*batch.to_pydict().values(), strict=True):
                own = words_of(item_text)
                item = Item(number, item_size(own), word_shingles(own, item_size(own))) if own else None
                share = containment(item, words_of(text)) if item else 0.0
                if share >= THRESHOLD:
                    out.append({"doc_id": doc_id, "item_id": number, "containment": share})
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema(RESULT))

    return both.mapInArrow(verify, RESULT)


def _item_rows(batches):
    """Sketches of the items for every partition that a table of documents can have."""
    for part, _ in blocks(batches, "text"):
        texts = [t or "" for t in part.column(1).to_pylist()]
        for p in range(-1, 40):
            at, hashes = item_sketches(texts, p)
            yield _rows(part, at, np.full(len(at), p), hashes, "item_id")


def _rows(part: pa.RecordBatch, at: np.ndarray, classes: np.ndarray, hashes: np.ndarray, name: str = "doc_id") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(at)), pa.array(classes, pa.int32()), pa.array(hashes.view(np.int64))],
        schema=arrow_schema(f"{name} long, {SKETCH}"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """The rows of docs that contain no item, all columns as they are."""
    known = small_items(items, item_id, item_text)
    if known is None:
        # Whether a row goes depends on its text alone, so texts are searched and dropped by a key
        # of their own: ids may be null or repeated.
        key = F.sha2(docs[text_col].cast("binary"), 256)
        texts = docs.where(docs[text_col].isNotNull()).select(key.alias("__key"), docs[text_col].alias("text")).distinct()
        numbered = staged(texts.withColumn("doc_id", F.monotonically_increasing_id()), "contamination-texts")
        found = contained_items(numbered, items, "doc_id", "text", item_id, item_text).select("doc_id").distinct()
        bad = numbered.join(found, "doc_id", "left_semi").select("__key")
        return docs.join(bad, key == F.col("__key"), "left_anti")

    def keep(batches):
        for part, texts in blocks(batches, text_col, lower=True):
            bad = {row for row, _, _ in known.find(texts)}
            yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

    return docs.mapInArrow(keep, docs.schema)
