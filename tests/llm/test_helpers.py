"""The numpy parts of the operators against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from cotflow.llm import line_crf, near_dup, packing, substrings
from cotflow.llm.batches import Texts, blocks, repeats, window_hashes, window_starts
from cotflow.llm.calibration import apply_isotonic, fit_isotonic
from cotflow.llm.contamination import sketch
from cotflow.llm.lines import Lines, measures, repeated_words

TEXTS = [
    "", None, " \t\n", "one", "a b a b a b", "x\ny\nx\n\n x \nx", "é ü ß c", "tab\tand\x0bother\x0cgaps\r\nhere",
    "word " * 50, "\n\n", "the the the the", "trailing space ", " " + "long" * 300,
]


def spans(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_runs_of_non_blanks():
    texts = Texts(pa.array(TEXTS))
    assert texts.n_words.tolist() == [len(spans(t)) for t in TEXTS]
    words = [texts.data[a:b].tobytes().decode() for a, b in zip(texts.starts, texts.ends, strict=True)]
    assert words == [w for t in TEXTS for w in spans(t)]


def test_equal_words_and_windows_share_hashes():
    texts = Texts(pa.array(["a b c a b c", None, "b c a"]))
    words = ["a", "b", "c", "a", "b", "c", "b", "c", "a"]
    found = dict(zip(words, texts.word_hashes().tolist(), strict=True))
    assert [found[w] for w in words] == texts.word_hashes().tolist() and len(set(found.values())) == 3
    starts, rows = window_starts(texts.first_word[:-1], texts.n_words, 2)
    keys = [tuple(words[s : s + 2]) for s in starts]
    hashes = window_hashes(texts.word_hashes(), starts, 2).tolist()
    assert len(set(zip(keys, hashes, strict=True))) == len(set(keys)) == len(set(hashes))
    assert rows.tolist() == [0] * 5 + [2] * 2


def test_blocks_cover_every_row_once():
    batch = pa.record_batch({"text": pa.array(TEXTS), "n": pa.array(range(len(TEXTS)))})
    parts = [p for p, _ in blocks([batch, batch.slice(0, 0)], "text", limit=20)]
    assert [n for p in parts for n in p.column(1).to_pylist()] == list(range(len(TEXTS)))


def test_sliced_arrays_are_read_at_their_offset():
    assert Texts(pa.array(TEXTS).slice(4, 2)).n_words.tolist() == [6, 5]


def test_repeats():
    rows, hashes = np.array([0, 0, 0, 1, 1]), np.array([5, 6, 5, 5, 7], np.uint64)
    assert [x.tolist() for x in repeats(rows, hashes)] == [[True, False, True, False, False], [False, False, True, False, False]]


def test_repeated_words_of_three_word_windows():
    texts = Texts(pa.array(TEXTS))
    got = np.split(repeated_words(texts), texts.first_word[1:-1])
    for text, flags in zip(TEXTS, got, strict=True):
        words = spans(text)
        counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        want = {j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert set(np.flatnonzero(flags)) == want


def test_repeated_lines():
    lines = Lines(Texts(pa.array(TEXTS)))
    assert lines.n == sum((t or "").count("\n") + 1 for t in TEXTS)
    for i, text in enumerate(TEXTS):
        seen, want = set(), 0
        for line in (text or "").split("\n"):
            if spans(line):
                want += line in seen
                seen.add(line)
        assert int(lines.earlier[lines.rows == i].sum()) == want


def test_measures_are_finite_and_zero_without_words():
    rows = measures(Texts(pa.array(TEXTS)))
    assert np.isfinite(rows).all() and not rows[:3].any()


def test_isotonic_pools_violators():
    knots = fit_isotonic([1, 2, 3, 4], [0, 1, 0, 1], [1, 1, 1, 1])
    assert knots[1].tolist() == [0, 0.5, 1] and apply_isotonic(knots, np.array([-5.0, 2.5, 9.0])).tolist() == [0, 0.5, 1]
    assert apply_isotonic(fit_isotonic([], [], []), np.array([3.0])).tolist() == [0]


def _paths(n):
    return product((0, 1), repeat=n)


def _score(scores, transition, path):
    return sum(scores[i][y] for i, y in enumerate(path)) + sum(transition[a][b] for a, b in zip(path, path[1:], strict=False))


def test_viterbi_finds_the_best_path():
    draws = np.random.default_rng(1)
    first = np.array([0, 3, 3, 8, 9])
    scores, transition = draws.normal(size=(9, 2)), draws.normal(size=(2, 2))
    labels = line_crf.viterbi(scores, transition, first)
    for a, b in zip(first, first[1:], strict=False):
        best = max(_paths(b - a), key=lambda p: _score(scores[a:b], transition, p))
        assert tuple(labels[a:b]) == best


def test_field_gradient_matches_differences():
    draws = np.random.default_rng(2)
    bits = draws.integers(0, 2, (6, len(line_crf.LINE_SIGNS))).astype(float)
    labels, first = np.array([0, 1, 1, 0, 0, 1]), np.array([0, 4, 6])
    model = line_crf.Field(draws.normal(size=(2, bits.shape[1])), draws.normal(size=(2, 2)))
    slope, value = line_crf.gradient(model, bits, labels, first)
    brute = 0.0
    for a, b in zip(first, first[1:], strict=False):
        scores = bits[a:b] @ model.emission.T
        every = [_score(scores, model.transition, p) for p in _paths(b - a)]
        brute += _score(scores, model.transition, tuple(labels[a:b])) - math.log(sum(math.exp(x) for x in every))
    assert value == pytest.approx(brute)
    moved = line_crf.Field(model.emission.copy(), model.transition.copy())
    moved.transition[0, 1] += 1e-6
    assert (line_crf.gradient(moved, bits, labels, first)[1] - value) / 1e-6 == pytest.approx(slope.transition[0, 1], abs=1e-3)
    moved = line_crf.Field(model.emission.copy(), model.transition)
    moved.emission[1, 3] += 1e-6
    assert (line_crf.gradient(moved, bits, labels, first)[1] - value) / 1e-6 == pytest.approx(slope.emission[1, 3], abs=1e-3)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_multiset(seed):
    draws = random.Random(seed)
    capacity = draws.randint(5, 40)
    counts = Counter(draws.randint(1, capacity - 1) for _ in range(draws.randint(1, 9)))
    chosen = packing.fullest(dict(counts), capacity)
    assert all(counts[k] >= n > 0 for k, n in chosen.items()) and max(counts) in chosen
    sums = {max(counts)}
    rest = list((counts - Counter([max(counts)])).elements())
    for length in rest:
        sums |= {s + length for s in sums if s + length <= capacity}
    assert sum(k * n for k, n in chosen.items()) == max(sums)


def test_packer_places_every_token_once():
    draws = random.Random(3)
    packer = packing.Packer(capacity=64, window=40)
    docs = [np.arange(draws.choice([0, 1, 3, 30, 64, 65, 200])) for _ in range(500)]
    sequences = [s for i, d in enumerate(docs) for s in packer.add(i, d.astype("<u4").tobytes())] + list(packer.finish())
    seen = {}
    for sequence in sequences:
        total = sum(map(len, sequence))
        assert total == 64 or total & (total - 1) == 0
        for p in sequence:
            assert p.doc_tokens == len(docs[p.doc_id])
            for k, token in enumerate(np.frombuffer(p.ids, "<u4")):
                assert token == p.start + k and seen.setdefault((p.doc_id, p.start + k), True)
    assert len(seen) == sum(map(len, docs))
    assert sum(sum(map(len, s)) < 64 for s in sequences) <= 6


def test_encoder_agrees_with_the_tokenizer():
    encode = packing.Encoder(packing.default_tokenizer())
    texts = [
        "It's THEY'RE 12 3½ ª º don't!!! a'b 'sx", "À É İstanbul ΣΑΣ ΣΣ.", "<|endoftext|> <|ENDOFTEXT|>", "x\x0by\x0cz \x1c",
        "ﬁ ǅ ŉ ß ẞ naïve Ĳ ĳ zero​width é", "", "a b c\u0085d", "日本語 текст", "x" * 3000,
    ]
    for text in texts:
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == ids
    assert encode([None]) == [b""]


def test_messages_survive_packing():
    a, b = np.array([3, 2**63, 5], np.uint64), np.array([-1, 0, 7], np.int64)
    got = substrings.unpack(substrings.pack(a, b), np.uint64, np.int64)
    assert [x.tolist() for x in got] == [a.tolist(), b.tolist()]
    assert [len(x) for x in substrings.unpack(substrings.pack(a[:0], b[:0]), np.uint64, np.int64)] == [0, 0]


def test_estimates_are_never_below_the_counts():
    """A tiny sketch is full of collisions; every window seen twice must still pass."""
    draws = random.Random(5)
    texts = [" ".join(draws.choice("abcdef") for _ in range(60)) for _ in range(4)]
    units = [substrings.Unit(i, np.array([i]), np.array([1]), Texts(pa.array([t]))) for i, t in enumerate(texts)]
    shape = substrings.Shape(3, 6, 2)
    messages = [m for u in units for m in substrings.sketch_messages(u, shape)]
    answers = {u.number: {} for u in units}
    for part in {m["part"] for m in messages}:
        table = pa.Table.from_pylist([m for m in messages if m["part"] == part], schema=substrings.arrow_schema(substrings.MESSAGE))
        for row in substrings.merge_sketches(table).to_pylist():
            answers[row["unit"]][row["part"]] = row["payload"]
    counts = Counter(tuple(t.split()[i : i + 3]) for t in texts for i in range(58))
    for unit, text in zip(units, texts, strict=True):
        starts, _, first, second = unit.windows(3)
        passed = substrings.estimated_repeated(unit, shape, answers[unit.number], first, second)
        words = text.split()
        assert all(p for p, s in zip(passed, starts, strict=True) if counts[tuple(words[s : s + 3])] > 1)


def brute_probability_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)


def test_probability_jaccard_by_prefix_sums():
    draws = random.Random(4)
    for _ in range(30):
        a, b = (Counter(draws.choice("abcdefgh") for _ in range(draws.randint(1, 15))) for _ in range(2))
        every = sorted(set(a) | set(b))
        got = near_dup.probability_jaccard(*(np.array([float(c[e]) for e in every]) for c in (a, b)))
        assert got == pytest.approx(brute_probability_jaccard(a, b))


def test_registers_agree_as_often_as_texts_are_similar():
    draws = np.random.default_rng(6)
    n = 400
    hashes = draws.integers(1, 2**63, (n, 60), dtype=np.int64).astype(np.uint64)
    weights = draws.integers(1, 4, (n, 60)).astype(float)
    rows = np.repeat(np.arange(n), 50)
    left = near_dup.signatures(rows, hashes[:, :50].ravel(), weights[:, :50].ravel(), n)
    right = near_dup.signatures(rows, hashes[:, 10:].ravel(), weights[:, 10:].ravel(), n)
    x, y = weights.copy(), weights.copy()
    x[:, 50:], y[:, :10] = 0, 0
    expected = np.mean([near_dup.probability_jaccard(a, b) for a, b in zip(x, y, strict=True)])
    assert (left == right).mean() == pytest.approx(expected, abs=0.01)
    assert (near_dup.signatures(rows[:0], hashes[0, :0], weights[0, :0], 2) == 0).all()


def test_sketch_keeps_the_smallest_of_each_register():
    rows = np.zeros(200, np.int64)
    hashes = np.random.default_rng(7).integers(1, 2**63, 200, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    _, kept = sketch(rows, hashes, np.array([4]))
    registers = {}
    for h in hashes.tolist():
        registers[h >> 59] = min(h, registers.get(h >> 59, h))
    assert sorted(kept.tolist()) == sorted(registers.values())


def test_similarity_bounds():
    """Never below the similarity, and equal to it where weights are equal."""
    draws = np.random.default_rng(7)
    sides, texts = [], []
    for n in (9, 7):
        rows, hashes, weights = [], [], []
        for i in range(n):
            own = np.sort(draws.choice(40, draws.integers(5, 35), replace=False)).astype(np.uint64)
            rows += [i] * len(own)
            hashes += own.tolist()
            weights += (np.ones(len(own)) * 3 if i % 2 else draws.integers(1, 4, len(own))).tolist()
            texts.append((own, np.array(weights[-len(own) :], float)))
        sides.append((np.array(rows), np.array(hashes, np.uint64), np.array(weights, float)))
    bounds = near_dup.similarity_bounds(*sides, 9, 7)
    for i in range(9):
        for j in range(7):
            exact = near_dup.similarity(texts[i], texts[9 + j])
            assert bounds[i, j] >= exact - 1e-5
            assert not (i % 2 and j % 2) or abs(bounds[i, j] - exact) < 1e-5
