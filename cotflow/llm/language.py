"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte sequences of SIZES lengths inside a lower-case word, its two borders
included; every byte that is no letter is a border. A text's vector is the mean embedding of its
subwords. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded
sample; a temperature and a rejection threshold are calibrated on a part of it that the descent
does not see.

Defined results: a null text, and one without a letter, gets UNDETERMINED with score 0 and is not
accepted. Rows with a null id are predicted too. Ties go to the first language in name order.
Without learnable rows every text gets UNDETERMINED. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cotflow.llm.batches import Texts, arrow_schema, blocks, mix
from cotflow.llm.frames import draw, id_and_text
from cotflow.llm.lines import HIGH, LOWER, UPPER

UNDETERMINED = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SIZES = (2, 3, 4)
DIMENSION = 16
# Bound of the sample: about so many documents of each language, by digest of the id.
DOCUMENTS_PER_LANGUAGE = 400
CALIBRATION_SHARE = 0.25
EPOCHS, RATE = 12, 0.5
# Rejected below the score at which accepted calibration texts are right this often.
ACCEPTED_ACCURACY = 0.99

RESULT = "doc_id long, lang_pred string, score double, accepted boolean"


def _codes(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII capitals lowered; 0 for every byte that is no letter."""
    lower = np.where(UPPER[data], data + 32, data)
    return np.where(UPPER[data] | LOWER[data] | HIGH[data], lower, 0)


def subwords(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword, by ascending row within each size."""
    # Each text is followed by a border, so that none reaches into the next.
    codes = np.zeros(len(texts.data) + texts.n + 1, np.uint64)
    rows = np.repeat(np.arange(texts.n), np.diff(texts.offsets) + 1)
    codes[np.arange(len(texts.data)) + rows_of_bytes(texts) + 1] = _codes(texts.data)
    border = codes == 0
    inner = np.cumsum(border)
    buckets, owners = [], []
    hashed = codes.copy()
    for size in range(2, max(SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        hashed = hashed[:n] * np.uint64(0x100000001B3) + codes[size - 1 :]
        if size not in SIZES:
            continue
        # No border strictly inside, and not nothing but borders.
        ok = inner[size - 2 : size - 2 + n] == inner[:n]
        ok &= ~(border[:n] & border[size - 1 :]) if size == 2 else True
        at = np.flatnonzero(ok)
        buckets.append((mix(hashed[at] + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(rows[np.minimum(at, len(rows) - 1)])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def rows_of_bytes(texts: Texts) -> np.ndarray:
    return np.repeat(np.arange(texts.n), np.diff(texts.offsets))


def has_letter(texts: Texts) -> np.ndarray:
    found = texts.per_row(UPPER[texts.data] | LOWER[texts.data]) > 0
    for i in np.flatnonzero(~found & (texts.per_row(HIGH[texts.data]) > 0)):
        found[i] = any(c.isalpha() for c in texts.text(i))
    return found


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    least_score: float

    def probabilities(self, texts: Texts) -> np.ndarray:
        buckets, rows = subwords(texts)
        sums = np.zeros((texts.n, len(self.languages)))
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        if len(rows):
            edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sums[rows[edges]] = np.add.reduceat(self.table[buckets[order]], edges, axis=0)
        counts = np.bincount(rows, minlength=texts.n)
        return _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str]) -> Model:
    """From (buckets, their counts, language number) of texts in any fixed order."""
    draws = np.random.default_rng(5)
    order = draws.permutation(len(samples))
    kept = int(len(samples) * CALIBRATION_SHARE) if len(samples) >= 40 else 0
    calibration, learning = order[:kept], order[kept:]
    embedding = draws.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    weights = np.zeros((DIMENSION, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * len(learning), 0
    for _ in range(EPOCHS):
        for i in draws.permutation(learning):
            buckets, counts, language = samples[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ embedding[buckets]
            error = _softmax((hidden @ weights + bias)[None])[0].astype(np.float32)
            error[language] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * error
            # The mean spreads the gradient over the subwords; scaled up, each one still moves.
            embedding[buckets] -= rate * 10 * np.outer(share, back)
    model = Model(languages, embedding @ weights, bias, 1.0, 0.0)
    held = calibration if kept else learning
    logits = np.array([_mean_row(model.table, samples[i]) + bias for i in held])
    truth = np.array([samples[i][2] for i in held])
    losses = [
        (-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t)
        for t in (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0)
    ]
    model.temperature = min(losses)[1]
    chances = _softmax(logits / model.temperature)
    scores, right = chances.max(axis=1), chances.argmax(axis=1) == truth
    best = np.argsort(-scores, kind="stable")
    good = np.cumsum(right[best]) >= ACCEPTED_ACCURACY * np.arange(1, len(best) + 1)
    model.least_score = float(scores[best][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def _mean_row(table: np.ndarray, sample) -> np.ndarray:
    buckets, counts, _ = sample
    return counts @ table[buckets] / counts.sum()


def _counted(batches):
    schema = arrow_schema("lang string, buckets binary, counts binary")
    for part, texts in blocks(batches, "text"):
        buckets, rows = subwords(texts)
        found, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
        edges = np.searchsorted(found, np.arange(texts.n + 1) * BUCKETS)
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([(found[a:b] % BUCKETS).astype(np.uint16).tobytes() for a, b in spans], pa.binary()),
                pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
            ],
            schema=schema,
        )


def fit(docs: DataFrame, learnable: Callable[[Column], Column], id_col="doc_id", text_col="text", lang_col="lang") -> Model | None:
    """Train on rows whose id is learnable and whose language is known; None without any.

    The sample keeps an id when its digest falls below DOCUMENTS_PER_LANGUAGE over the number of
    rows of its language, so its size is bounded in expectation for every language alike.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(learnable(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, DOCUMENTS_PER_LANGUAGE / sizes[lang])])
    sample = rows.where(draw(F.col("doc_id"), F.lit("language")) < shares[F.col("lang")])
    counted = sample.select("lang", "text").mapInArrow(_counted, "lang string, buckets binary, counts binary").collect()
    number = {lang: i for i, lang in enumerate(languages)}
    samples = sorted((bytes(r["buckets"]), bytes(r["counts"]), number[r["lang"]]) for r in counted if len(r["buckets"]))
    if not samples:
        return None
    return train(
        [(np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint32), n) for b, c, n in samples], languages
    )


def predict_languages(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs, with the columns of RESULT."""
    schema = arrow_schema(RESULT)

    def predict(batches):
        for part, texts in blocks(batches, "text"):
            names, scores, accepted = [UNDETERMINED] * texts.n, np.zeros(texts.n), np.zeros(texts.n, bool)
            if model is not None and texts.n:
                known = has_letter(texts)
                chances = model.probabilities(texts)
                names = np.where(known, np.array(model.languages, object)[chances.argmax(axis=1)], UNDETERMINED)
                scores = np.where(known, chances.max(axis=1), 0.0)
                accepted = known & (scores >= model.least_score)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)], schema=schema
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(predict, RESULT)
