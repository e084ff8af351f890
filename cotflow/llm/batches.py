"""Vectorised views of the texts in an Arrow batch: rows, words, lines, hashes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. All hashes are polynomials
over the ring of 64-bit integers, taken from prefix sums, and mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows are handled in blocks of about so many bytes of text, whatever the batch size: a block's
# arrays take some thirty times that.
BLOCK_BYTES = 1_000_000

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n at least, modulo 2**64; kept for later blocks."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 2**64))
        forth, back = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        forth[0] = back[0] = 1
        known = np.cumprod(forth), np.cumprod(back)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[int(base)] = known
    return known


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base=_BASE) -> np.ndarray:
    """A hash of codes[start:end] for every span."""
    forth, back = powers(base, len(codes) + 1)
    sums = prefix_sums(codes * forth[: len(codes)])
    return mix((sums[ends] - sums[starts]) * back[starts])


class Texts:
    """The texts of some rows, with their words; a null text counts as an empty one."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        first = column.offset
        bounds = np.frombuffer(offsets, np.int64)[first : first + len(column) + 1]
        if data is None or not len(column):
            self._set(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        else:
            self._set(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0])

    @classmethod
    def of_bytes(cls, data: np.ndarray, offsets: np.ndarray) -> Texts:
        out = cls.__new__(cls)
        out._set(data, offsets)
        return out

    def _set(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1
        inside = ~GAP[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        begin[heads] = inside[heads]
        end[tails] = inside[tails]
        self.inside = inside
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        # Words of row i: first_word[i] to first_word[i + 1].
        self.first_word = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first_word)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(BYTE_CODES[self.data], self.starts, self.ends)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = prefix_sums(flags)
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def window_starts(first_word: np.ndarray, n_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of every window of ``size`` words that lies in one row."""
    counts = np.maximum(n_words - size + 1, 0)
    rows = np.repeat(np.arange(len(n_words)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first_word[rows] + within, rows


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    codes = mix(hashes ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) if salt else hashes
    base = np.uint64(int(_WORD_BASE) + 8 * salt)
    return span_hashes(codes, starts, starts + size, base)


def blocks(batches, column: str, limit: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about ``limit`` bytes of text each, a long text alone."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(row, stop - row)
            text = part.column(at)
            yield part, Texts(pc.utf8_lower(text) if lower else text)
            row = stop
        give_back()


def give_back() -> None:
    """Return what a batch needed to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trimmer():
    """glibc keeps small freed pieces unless it is asked; other C libraries have no such call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return None


_TRIM = _trimmer()


def repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, hash) items in order: which have an equal one anywhere, and which an earlier one."""
    key = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    any_equal, earlier = np.empty(len(key), bool), np.empty(len(key), bool)
    any_equal[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return any_equal, earlier


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words that begins at one of the starts."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def arrow_schema(spark_schema: str, like: dict[str, pa.DataType] | None = None) -> pa.Schema:
    """The Arrow form of a flat schema such as ``doc_id long, score double``."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()),
        "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
        "array<long>": pa.list_(pa.int64()),
    }
    fields = [part.strip().rsplit(" ", 1) for part in spark_schema.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])
