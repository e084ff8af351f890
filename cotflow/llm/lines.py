"""Statistics of texts and of their lines, for a whole block of rows at once."""

from __future__ import annotations

import re

import numpy as np

from cotflow.llm.batches import (
    BYTE_CODES, Texts, covered, prefix_sums, repeats, span_hashes, window_hashes, window_starts,
)


def _bytes(chars: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars.encode())] = True
    return flags


SYMBOL = _bytes("#*$%&|<>")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
DIGIT = _bytes("0123456789")
STOP = _bytes(".!?:;")
LOUD = _bytes("!?")
BAR = _bytes("|")
HIGH = np.arange(256) >= 128
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
# Wording of notices around a text rather than of the text.
NOTICES = re.compile(
    rb"(?i)copyright|\(c\) \d|all rights reserved|licensed under|terms of (?:use|service)|"
    rb"privacy policy|cookie|sign up|log ?in|subscribe|click here|share this|read more|javascript"
)


class Lines:
    """The \\n-separated lines of the rows; an empty text has one empty line."""

    def __init__(self, texts: Texts):
        self.texts = t = texts
        breaks = np.flatnonzero(t.data == 10)
        rows = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, breaks, "right") - 1])
        places = np.concatenate([t.offsets[:-1], breaks + 1])
        order = np.lexsort((places, rows))
        self.rows, self.starts = rows[order], places[order]
        self.n = len(self.starts)
        last = np.ones(self.n, bool)
        last[:-1] = self.rows[1:] != self.rows[:-1]
        self.ends = np.empty(self.n, np.int64)
        self.ends[:-1] = self.starts[1:] - 1
        self.ends[last] = t.offsets[1:][self.rows[last]]
        self.first_word = np.searchsorted(t.starts, self.starts)
        self.n_words = np.searchsorted(t.starts, self.ends) - self.first_word
        self.first_line = np.searchsorted(self.rows, np.arange(t.n + 1))
        hashes = span_hashes(BYTE_CODES[t.data], self.starts, self.ends)
        worded = self.n_words > 0
        self.repeated, self.earlier = np.zeros(self.n, bool), np.zeros(self.n, bool)
        self.repeated[worded], self.earlier[worded] = repeats(self.rows[worded], hashes[worded])

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes per line."""
        sums = prefix_sums(flags)
        return sums[self.ends] - sums[self.starts]

    def count_words(self, flags: np.ndarray) -> np.ndarray:
        sums = prefix_sums(flags)
        return sums[self.first_word + self.n_words] - sums[self.first_word]


def repeated_words(texts: Texts) -> np.ndarray:
    """Which words lie in a three-word window found twice or more in their text."""
    n = len(texts.starts)
    if not n:
        return np.zeros(0, bool)
    starts, rows = window_starts(texts.first_word[:-1], texts.n_words, 3)
    twice, _ = repeats(rows, window_hashes(texts.word_hashes(), starts, 3))
    return covered(starts[twice], 3, n)


def per_row(texts: Texts, flags: np.ndarray) -> np.ndarray:
    """Flagged words per row."""
    sums = prefix_sums(flags)
    return sums[texts.first_word[1:]] - sums[texts.first_word[:-1]]


# What a line shows, one bit each.
LINE_SIGNS = (
    "always", "no word", "one or two words", "three to seven words", "over forty words",
    "some symbols", "a symbol per word", "mostly capitals", "many digits", "many marks",
    "a mark per word", "bars between words", "long words", "short words", "ends like a sentence",
    "starts with a capital", "repeated line", "half repeated", "wholly repeated", "first line",
    "last line", "a notice",
)


def line_signs(lines: Lines, again: np.ndarray) -> np.ndarray:
    """A bit mask of LINE_SIGNS per line; ``again`` flags the repeated words."""
    t, data = lines.texts, lines.texts.data
    words = lines.n_words
    n = np.maximum(words, 1)
    capitals, small = lines.count(UPPER[data]), lines.count(LOWER[data] | HIGH[data])
    digits, symbols = lines.count(DIGIT[data]), lines.count(SYMBOL[data])
    loud, bars = lines.count(LOUD[data]), lines.count(BAR[data])
    size = lines.count(t.inside)
    repeated = lines.count_words(again)
    head, tail = np.zeros(lines.n, np.uint8), np.zeros(lines.n, np.uint8)
    some = words > 0
    head[some] = data[t.starts[lines.first_word[some]]]
    tail[some] = data[t.ends[lines.first_word[some] + words[some] - 1] - 1]
    first = np.zeros(lines.n, bool)
    first[lines.first_line[:-1]] = True
    last = np.zeros(lines.n, bool)
    last[lines.first_line[1:] - 1] = True
    notice = np.zeros(lines.n, bool)
    found = [m.start() for m in NOTICES.finditer(data)]
    if found:
        notice[np.searchsorted(lines.starts, found, "right") - 1] = True
    signs = (
        np.ones(lines.n, bool), words == 0, (words > 0) & (words < 3), (words >= 3) & (words < 8), words > 40,
        10 * symbols >= n, 2 * symbols >= n, capitals > np.maximum(small, 2), 5 * digits > np.maximum(size, 5), 5 * loud >= n,
        5 * loud >= 4 * n, 5 * bars >= n, size > 9 * n, some & (size < 3 * n), STOP[tail],
        UPPER[head], lines.repeated, 2 * repeated > n, some & (10 * repeated >= 9 * words), first,
        last, notice,
    )
    out = np.zeros(lines.n, np.int64)
    for i, flag in enumerate(signs):
        out |= flag.astype(np.int64) << i
    return out


# What a whole text is measured by.
MEASURES = (
    "log words", "characters per word", "symbols per word", "capitals per letter", "digits per character",
    "marks per word", "bars per word", "sentence ends per word", "repeated lines", "repeated words",
    "words per line", "distinct words", "lines ending like a sentence", "words without letters",
    "non-ASCII per character", "longest word",
)


def measures(texts: Texts) -> np.ndarray:
    """MEASURES of every row; all are 0 for a text without words."""
    t, data = texts, texts.data
    lines = Lines(t)
    words, n = t.n_words, np.maximum(t.n_words, 1)
    size = np.maximum(t.per_row(t.inside), 1)
    capitals, small = t.per_row(UPPER[data]), t.per_row(LOWER[data] | HIGH[data])
    again = repeated_words(t)
    rows = t.word_rows()
    hashes = t.word_hashes() if len(rows) else np.zeros(0, np.uint64)
    _, seen = repeats(rows, hashes)
    letters = prefix_sums(UPPER[data] | LOWER[data] | HIGH[data])
    bare = letters[t.ends] == letters[t.starts]
    worded = lines.n_words > 0
    line_rows = lines.rows[worded]
    n_lines = np.bincount(line_rows, minlength=t.n)
    tail = data[t.ends[(lines.first_word + lines.n_words)[worded] - 1] - 1]
    longest = np.zeros(t.n)
    np.maximum.at(longest, rows, t.ends - t.starts)
    out = np.stack(
        [
            np.log1p(words), size / n, t.per_row(SYMBOL[data]) / n, capitals / np.maximum(capitals + small, 1),
            t.per_row(DIGIT[data]) / size, t.per_row(LOUD[data]) / n, t.per_row(BAR[data]) / n,
            t.per_row(STOP[data]) / n, np.bincount(lines.rows, lines.earlier, t.n) / np.maximum(n_lines, 1),
            per_row(t, again) / n, np.log1p(words / np.maximum(n_lines, 1)), per_row(t, ~seen) / n,
            np.bincount(line_rows, STOP[tail], t.n) / np.maximum(n_lines, 1), per_row(t, bare) / n,
            t.per_row(HIGH[data]) / size, np.log1p(longest),
        ],
        axis=1,
    ).astype(float)
    out[words == 0] = 0.0
    return out
