"""Quality by line labels: a linear-chain conditional random field and Viterbi decoding.

Base rules count words, symbols, repeated lines and repeated words. A text that passes them is
split into lines; the field labels each line content or boilerplate, and the text is kept when
content lines hold at least CONTENT_SHARE of its words.

The field has one weight per (label, line sign) and per (label, next label). It is trained by
gradient ascent on a bounded sample of labelled documents: the lines of a low-quality document
count as boilerplate, those of others as content (distant labels; no line is labelled itself).

Defined results: a null or empty text has no words and fails the base rules. Without labelled
documents all weights are 0 and every line counts as content. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cotflow.llm.batches import Texts, arrow_schema, blocks
from cotflow.llm.frames import id_and_text
from cotflow.llm.lines import CONTINUATION, LINE_SIGNS, SYMBOL, Lines, line_signs, per_row, repeated_words

CONTENT, BOILERPLATE = 0, 1
CONTENT_SHARE = 0.5
LEAST_WORDS = 50
# Bounds of the training sample and of one training sequence; longer ones count as several.
DOCUMENTS, SEQUENCE = 2000, 64
STEPS, RATE, DECAY = 150, 0.1, 1e-3

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"
)


@dataclass
class Field:
    emission: np.ndarray  # labels x signs
    transition: np.ndarray  # label x next label


def no_field() -> Field:
    return Field(np.zeros((2, len(LINE_SIGNS))), np.zeros((2, 2)))


def _bits(signs: np.ndarray) -> np.ndarray:
    return (signs[..., None] >> np.arange(len(LINE_SIGNS)) & 1).astype(float)


class _Steps:
    """Sequences side by side, longest first: at step t the first ``active[t]`` go on."""

    def __init__(self, first: np.ndarray):
        lengths = np.diff(first)
        self.order = np.argsort(-lengths, kind="stable")
        self.first, lengths = first[:-1][self.order], lengths[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(longest), "left")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


def viterbi(scores: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every line; lines first[i]:first[i+1] form sequence i. Ties: content."""
    steps = _Steps(first)
    best = scores.copy()
    back = np.zeros(scores.shape, np.int8)
    for t in range(1, len(steps.active)):
        here = steps.at(t)
        ways = best[here - 1][:, :, None] + transition[None]
        back[here] = ways.argmax(axis=1)
        best[here] += ways.max(axis=1)
    labels = best.argmax(axis=1).astype(np.int8)
    for t in range(len(steps.active) - 1, 0, -1):
        here = steps.at(t)
        labels[here - 1] = back[here, labels[here]]
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(model: Field, bits: np.ndarray, labels: np.ndarray, first: np.ndarray) -> tuple[Field, float]:
    """Gradient and value of the log likelihood of the labels, by forward-backward sums."""
    scores = bits @ model.emission.T
    steps = _Steps(first)
    forward, backward = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(steps.active)):
        here = steps.at(t)
        forward[here] += _log_sum(forward[here - 1][:, :, None] + model.transition[None], 1)
    for t in range(len(steps.active) - 1, 0, -1):
        here = steps.at(t)
        ahead = (scores[here] + backward[here])[:, None, :] + model.transition[None]
        backward[here - 1] = _log_sum(ahead, 2)
    ends = first[1:][np.diff(first) > 0] - 1
    total = np.repeat(_log_sum(forward[ends], 1), np.diff(first)[np.diff(first) > 0])
    marginal = np.exp(forward + backward - total[:, None])
    true = np.eye(2)[labels]
    emission = (true - marginal).T @ bits
    follows = np.ones(len(scores), bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    now = np.flatnonzero(follows)
    pair = np.exp(
        forward[now - 1][:, :, None] + model.transition[None]
        + (scores[now] + backward[now])[:, None, :] - total[now][:, None, None]
    )
    transition = np.einsum("ni,nj->ij", true[now - 1], true[now]) - pair.sum(axis=0)
    value = scores[np.arange(len(labels)), labels].sum() + model.transition[labels[now - 1], labels[now]].sum()
    return Field(emission, transition), float(value - _log_sum(forward[ends], 1).sum())


def train(sequences: list[tuple[list[int], int]]) -> Field:
    """From (line signs, label) of documents; ascent with per-weight step sizes."""
    parts = [
        (np.array(signs[i : i + SEQUENCE], np.int64), label)
        for signs, label in sequences
        for i in range(0, len(signs), SEQUENCE)
    ]
    model = no_field()
    if len({label for _, label in parts}) < 2:
        return model
    bits = _bits(np.concatenate([signs for signs, _ in parts]))
    labels = np.repeat([label for _, label in parts], [len(signs) for signs, _ in parts])
    first = np.concatenate([[0], np.cumsum([len(signs) for signs, _ in parts])])
    weights = np.concatenate([model.emission.ravel(), model.transition.ravel()])
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    cut = model.emission.size
    for step in range(1, STEPS + 1):
        model = Field(weights[:cut].reshape(2, -1), weights[cut:].reshape(2, 2))
        slope, _ = gradient(model, bits, labels, first)
        flat = np.concatenate([slope.emission.ravel(), slope.transition.ravel()]) / len(labels) - DECAY * weights
        mean = 0.9 * mean + 0.1 * flat
        square = 0.99 * square + 0.01 * flat**2
        weights = weights + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(weights[:cut].reshape(2, -1), weights[cut:].reshape(2, 2))


def _signs(texts: Texts) -> tuple[Lines, np.ndarray, np.ndarray]:
    lines = Lines(texts)
    again = repeated_words(texts)
    return lines, again, line_signs(lines, again)


def _sample_signs(batches):
    for part, texts in blocks(batches, "text"):
        lines, _, signs = _signs(texts)
        rows = [signs[a:b] for a, b in zip(lines.first_line[:-1], lines.first_line[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))],
            names=["bad", "signs"],
        )


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> Field:
    """Train on the DOCUMENTS labelled ids with the smallest digests, half of either kind."""
    known = labels.select(
        labels[id_col].cast("long").alias("doc_id"), (labels[label_col] == 0).alias("bad")
    ).dropna()
    picked = None
    for bad in (True, False):
        part = known.where(F.col("bad") == bad).dropDuplicates(["doc_id"])
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS // 2)
        picked = part if picked is None else picked.unionByName(part)
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("bad", "text")
    rows = sample.mapInArrow(_sample_signs, "bad boolean, signs array<long>").collect()
    rows = sorted((r["signs"], int(r["bad"])) for r in rows)
    return train(rows)


def judge(texts: Texts, model: Field) -> list[np.ndarray]:
    """The columns of RESULT after doc_id."""
    lines, again, signs = _signs(texts)
    labels = viterbi(_bits(signs) @ model.emission.T, model.transition, lines.first_line)
    words = texts.n_words
    content = np.bincount(lines.rows, lines.n_words * (labels == CONTENT), texts.n)
    share = content / np.maximum(words, 1)
    repeated = per_row(texts, again)
    failed = (words < LEAST_WORDS) | (100 * repeated > 50 * words)
    return [
        words, texts.per_row(texts.inside & ~CONTINUATION[texts.data]), texts.per_row(SYMBOL[texts.data]),
        np.bincount(lines.rows, lines.earlier, texts.n).astype(np.int64), repeated, failed,
        ~failed & (share >= CONTENT_SHARE), np.diff(lines.first_line), share,
    ]


def line_quality(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, with the columns of RESULT."""
    schema = arrow_schema(RESULT)

    def label(batches):
        for part, texts in blocks(batches, "text"):
            columns = judge(texts, model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))],
                schema=schema,
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(label, RESULT)
