"""Packing tokenised documents into sequences by minimum bin slack.

Documents longer than a sequence are cut into full sequences and a remainder. Remainders wait in a
window; a bitset subset-sum dynamic program picks the multiset of remaining lengths that fills a
sequence closest to its capacity, and the chosen counts are traced back through the bitsets. The
longest remainder is always part of the choice, so none waits for ever. When the window's best
choice leaves slack, more documents are awaited; at the end of a partition the last sequences are
filled by cutting documents, and the very last tokens go into sequences of power-of-two lengths,
which need no padding. So no sequence is padded.

Each task packs its own partition as it streams by: no shuffle, and memory is one window.

Defined results: a null text has no tokens besides the closing one; an empty table gives no
pieces; a null id stays null; repeated rows are packed each on its own. Columns besides id and
text are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cotflow.llm.batches import arrow_schema, give_back
from cotflow.llm.frames import id_and_text

CAPACITY = 2048
WINDOW = 4096  # remainders that wait at most, besides those being packed
END_ID = 1
REMEMBERED = 300_000  # tokenised words per task, and as many parts of words

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Results of a function of one string; emptied when full."""

    def __init__(self, fn):
        self.fn = fn

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[key] = self.fn(key)
        return found


class Encoder:
    """Token ids as little-endian unsigned 32-bit integers.

    The tokenizer lowers case, drops white space and never merges across it or across the bounds
    of PARTS, so the ids of a text are those of its words, and of their parts, both of which are
    remembered. That holds for PLAIN texts; any other text (marks that combine, rare spaces,
    letters whose lower case depends on context, the strings of special tokens) is given to the
    tokenizer as it is.
    """

    PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u024f]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # The split that the tokenizer's own file states, and its letters for bytes.
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        shape = stated["pre_tokenizer"].get("pretokenizers", [{}])
        self.by_word = [x.get("type") for x in shape] == ["Split", "ByteLevel"]
        if self.by_word:
            self.parts = regex.compile(shape[0]["pattern"]["Regex"])
        self.bytes = ByteLetters()
        self.words, self.pieces = _Memo(self._word), _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.merge(self.bytes(piece))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        return b"".join([self.pieces[p] for p in self.parts.findall(word)])

    def forget(self) -> None:
        """Empty the memories; the worker may run other work next."""
        self.words.clear()
        self.pieces.clear()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t or "") for t in texts]

    def encode(self, text: str) -> bytes:
        if self.by_word and "<|" not in text and self.PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class ByteLetters:
    """Writes every UTF-8 byte as one printable letter, as byte-level vocabularies do."""

    def __init__(self):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __call__(self, text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, as the vocabulary takes long to load."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens),
            Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens),
        )


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest one included, whose sum is nearest below capacity.

    Bit s of a bitset says that sum s can be reached. A length with count c is added as groups of
    1, 2, 4, ... copies; the bitset after every group is kept for tracing back. Stops as soon as
    the capacity itself is reached.
    """
    first = max(counts)
    left = capacity - first
    mask = (1 << (left + 1)) - 1
    reached = [1]
    groups: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        copies = min(counts[length] - (length == first), left // length)
        group = 1
        while copies > 0 and not reached[-1] >> left & 1:
            group = min(group, copies)
            copies -= group
            groups.append((length, group))
            reached.append((reached[-1] | reached[-1] << length * group) & mask)
            group *= 2
    total = reached[-1].bit_length() - 1
    chosen = defaultdict(int, {first: 1})
    for (length, group), before in zip(reversed(groups), reversed(reached[:-1]), strict=True):
        if not before >> total & 1:
            chosen[length] += group
            total -= length * group
    return dict(chosen)


class Packer:
    """Takes documents one by one, gives sequences (lists of pieces)."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.waiting: dict[int, deque[Piece]] = {}
        self.n = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        piece = Piece(doc_id, 0, ids, len(ids) // 4)
        while len(piece) >= self.capacity:
            full, piece = piece.cut(self.capacity)
            yield [full]
        if len(piece):
            self.waiting.setdefault(len(piece), deque()).append(piece)
            self.n += 1
        if self.n >= self.window:
            yield from self._pack(self.window // 8)

    def _take(self, length: int) -> Piece:
        pieces = self.waiting[length]
        piece = pieces.popleft()
        if not pieces:
            del self.waiting[length]
        self.n -= 1
        return piece

    def _pack(self, keep: int) -> Iterator[list[Piece]]:
        """Full sequences from the waiting remainders, until few wait or none can be filled.

        Below an eighth of the window a choice may fail that a fuller window allows.
        """
        while self.n > keep:
            counts = {length: len(pieces) for length, pieces in self.waiting.items()}
            chosen = fullest(counts, self.capacity)
            if sum(length * n for length, n in chosen.items()) < self.capacity:
                if self.n < self.window:
                    return
                yield self._filled(chosen)
                continue
            for _ in range(min(counts[length] // n for length, n in chosen.items())):
                yield [self._take(length) for length, n in chosen.items() for _ in range(n)]

    def _filled(self, chosen: dict[int, int]) -> list[Piece]:
        """The chosen remainders and a cut from another one, if any is left, to fill the gap."""
        sequence = [self._take(length) for length, n in chosen.items() for _ in range(n)]
        gap = self.capacity - sum(map(len, sequence))
        while gap and self.waiting:
            piece = self._take(max(self.waiting))
            if len(piece) > gap:
                piece, rest = piece.cut(gap)
                self.waiting.setdefault(len(rest), deque()).append(rest)
                self.n += 1
            sequence.append(piece)
            gap -= len(piece)
        return sequence

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._pack(0)
        while self.waiting:
            counts = {length: len(pieces) for length, pieces in self.waiting.items()}
            sequence = self._filled(fullest(counts, self.capacity))
            if sum(map(len, sequence)) == self.capacity:
                yield sequence
            else:
                yield from _in_powers(sequence)


def _in_powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences of power-of-two lengths, longest first."""
    rest = deque(pieces)
    total = sum(map(len, pieces))
    while total:
        room = 1 << total.bit_length() - 1
        total -= room
        sequence = []
        while room:
            piece = rest.popleft()
            if len(piece) > room:
                piece, after = piece.cut(room)
                rest.appendleft(after)
            sequence.append(piece)
            room -= len(piece)
        yield sequence


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece, with the columns of PIECES, and ``ids`` if asked for.

    ``offset`` is the piece's place in its sequence. Sequence ids are the partition's number and a
    running number.
    """
    path = tokenizer or default_tokenizer()
    shape = PIECES + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(shape)
    end = np.array([end_id], "<u4").tobytes()

    def columns(number: int, sequences: list[list[Piece]]) -> pa.RecordBatch:
        rows = []
        for sequence in sequences:
            offset = 0
            for p in sequence:
                row = (p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset)
                rows.append((*row, np.frombuffer(p.ids, "<i4")) if with_ids else row)
                offset += len(p)
            number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )

    def run(batches):
        encode, packer = encoder(path), Packer(capacity)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                done = [
                    sequence
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True)
                    for sequence in packer.add(doc_id, ids + end)
                ]
                if done:
                    yield columns(number, done)
                    number += len(done)
            give_back()
        done = list(packer.finish())
        if done:
            yield columns(number, done)
        encode.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, shape)
