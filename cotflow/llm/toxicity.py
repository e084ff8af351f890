"""Toxicity by compression distance: two zstandard dictionaries, one decision per window.

A window is one word, lower case, written REPEAT times so that its frame never falls back to a
raw block (which would hide what the dictionary saves). Every distinct window of a document is
compressed with a dictionary trained on ordinary text and with one trained on toxic text. Each
(raw length, ordinary length, toxic length) has a calibrated weight, the log ratio of how many
toxic and ordinary documents show it; the document's score is an isotonic map of its largest
weight. The sample of labelled documents is split in three: dictionaries, weights, isotonic map.

Defined results: a null text, and a text without letters, has no window and scores like a
document whose weight is the lowest seen. Rows with a null id are scored too. Repeated rows give
repeated scores. Without labelled documents of both kinds every score is 0.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cotflow.llm.batches import arrow_schema, give_back
from cotflow.llm.calibration import apply_isotonic, fit_isotonic
from cotflow.llm.frames import draw, id_and_text, staged

LEVEL = 9
REPEAT = 4
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
# Bounds of the sample of labelled documents that the classifier is fitted on.
TOXIC_DOCUMENTS, ORDINARY_DOCUMENTS = 4000, 12000
REMEMBERED = 200_000  # words per task
MAX_WORD = 200  # characters; longer runs of letters are looked at in pieces
NO_WINDOW = -20.0  # weight of a document without windows
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % MAX_WORD)

Key = tuple[int, int, int]


def windows(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


@dataclass
class Distance:
    """The pair of dictionaries; compressors are made where they are used."""

    ordinary: bytes
    toxic: bytes
    _ready: tuple | None = field(default=None, repr=False)
    _known: dict[str, Key] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_ready": None, "_known": {}}

    def _compress(self) -> tuple:
        if self._ready is None:
            made = []
            for content in (self.ordinary, self.toxic):
                dictionary = zstandard.ZstdCompressionDict(
                    content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                )
                dictionary.precompute_compress(level=LEVEL)
                made.append(
                    zstandard.ZstdCompressor(
                        level=LEVEL, dict_data=dictionary, write_content_size=False,
                        write_checksum=False, write_dict_id=False,
                    ).compress
                )
            self._ready = tuple(made)
        return self._ready

    def key(self, word: str) -> Key:
        """The lengths of a word's window; those met before are remembered."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = self._known[word] = self._lengths(word)
        return found

    def _lengths(self, word: str) -> Key:
        raw = word.encode("utf-8", "surrogatepass")
        window = (b" " + raw) * REPEAT + b" "
        ordinary, toxic = self._compress()
        return min(len(raw), 24), len(ordinary(window)), len(toxic(window))


@dataclass
class Model:
    distance: Distance
    weights: dict[Key, float]
    knots: tuple[np.ndarray, np.ndarray]


def _dictionary(words: list[str], size: int) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    words = sorted(words)
    random.Random(7).shuffle(words)
    samples = [
        ("  " + "  ".join(words[i : i + 16]) + "  ").encode("utf-8", "surrogatepass")
        for i in range(0, len(words), 16)
    ]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"        "


def train_distance(ordinary: list[tuple[str, int]], toxic: list[tuple[str, int]]) -> Distance:
    """From (word, how many times it counts) of either kind."""
    return Distance(
        _dictionary([w for w, n in ordinary for _ in range(n)], ORDINARY_BYTES),
        _dictionary([w for w, n in toxic for _ in range(n)], TOXIC_BYTES),
    )


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Model | None:
    """Fit on a bounded sample of the labelled documents; None without both kinds.

    ``labels`` has one row per labelled document; null ids and labels are left out. The sample
    takes the TOXIC_DOCUMENTS and ORDINARY_DOCUMENTS ids with the smallest digests, so it does
    not depend on partitioning, and its ids alone are broadcast.
    """
    known = labels.select(
        labels[id_col].cast("long").alias("doc_id"), (labels[label_col] == 1).alias("toxic")
    ).dropna()
    picked = None
    for toxic, bound in ((True, TOXIC_DOCUMENTS), (False, ORDINARY_DOCUMENTS)):
        part = known.where(F.col("toxic") == toxic).dropDuplicates(["doc_id"])
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumn("part", F.floor(draw(F.col("doc_id"), F.lit("part")) * 5).cast("int"))
    # Copies of one text count once: else a copied passage looks like a habit of its class.
    sample = (
        id_and_text(docs, id_col, text_col)
        .join(F.broadcast(picked), "doc_id")
        .dropna()
        .groupBy(F.sha2("text", 256).alias("digest"), "toxic")
        .agg(F.min(F.struct("doc_id", "part", "text")).alias("row"))
        .select("row.doc_id", "row.part", "row.text", "toxic")
    )
    words = staged(sample.mapInArrow(_sample_words, "doc_id long, part int, toxic boolean, words array<string>"), "toxicity-sample")

    sizes = {(r["toxic"], r["part"]): r["n"] for r in words.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    count = lambda toxic, parts: sum(n for (t, p), n in sizes.items() if t == toxic and p in parts)
    if not count(True, range(5)) or not count(False, range(5)):
        return None
    # Parts 0 and 1 train dictionaries, 2 and 3 weights, 4 the isotonic map. In small samples the
    # dictionaries and weights share their documents, in tiny ones everything does.
    first, second, third = (0, 1), (2, 3), (4,)
    small = min(count(t, p) for t in (True, False) for p in (first, second, third)) < 50
    if small:
        first, second, third = (0, 1, 2), (0, 1, 2), (3, 4)
        if not min(count(t, p) for t in (True, False) for p in (first, third)):
            first = second = third = range(5)
    n_toxic, n_ordinary = count(True, first), count(False, first)
    least = 2 if small else max(3, n_toxic // 100)
    frequent = (
        words.where(F.col("part").isin(list(first)))
        .select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(
            F.count_if(F.col("toxic")).alias("in_toxic"),
            F.count_if(~F.col("toxic")).alias("in_ordinary"),
        )
        .where((F.col("in_ordinary") >= 3) | (F.col("in_toxic") >= least))
        .collect()
    )
    ordinary = [(r["word"], min(r["in_ordinary"], 200)) for r in frequent if r["in_ordinary"] >= 3]
    toxic = [
        (r["word"], r["in_toxic"])
        for r in frequent
        if r["in_toxic"] >= least and r["in_toxic"] * n_ordinary > 8 * r["in_ordinary"] * n_toxic
    ]
    distance = train_distance(ordinary, toxic)

    def keys(batches):
        for batch in batches:
            seen = {True: Counter(), False: Counter()}
            for is_toxic, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[is_toxic].update({distance.key(w) for w in row})
            yield pa.RecordBatch.from_pylist(
                [
                    {"toxic": t, "raw": k[0], "ordinary": k[1], "distance": k[2], "n": n}
                    for t, c in seen.items()
                    for k, n in c.items()
                ],
                schema=arrow_schema("toxic boolean, raw int, ordinary int, distance int, n long"),
            )

    counted = (
        words.where(F.col("part").isin(list(second)))
        .select("toxic", "words")
        .mapInArrow(keys, "toxic boolean, raw int, ordinary int, distance int, n long")
        .groupBy("raw", "ordinary", "distance")
        .agg(
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("in_toxic"),
            F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("in_ordinary"),
        )
        .collect()
    )
    n_toxic, n_ordinary = count(True, second), count(False, second)
    weights = {
        (r["raw"], r["ordinary"], r["distance"]): math.log(
            (r["in_toxic"] + 0.5) / (n_toxic + 1) / ((r["in_ordinary"] + 0.5) / (n_ordinary + 1))
        )
        for r in counted
    }
    raw = Model(distance, weights, (np.array([0.0]), np.array([0.0])))

    def sums(batches):
        for batch in batches:
            scores = [raw_score(raw, row) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["toxic", "score"]
            )

    # As in the labelled population, where one kind may be sampled more thinly than the other.
    shares = known.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()
    scale = {r["toxic"]: r["n"] / max(1, count(r["toxic"], range(5))) for r in shares}
    points = (
        words.where(F.col("part").isin(list(third)))
        .select("toxic", "words")
        .mapInArrow(sums, "toxic boolean, score double")
        .groupBy(F.round("score", 3).alias("score"), "toxic")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    weight = [scale.get(r["toxic"], 1.0) * r["n"] for r in points]
    raw.knots = fit_isotonic(
        [r["score"] for r in points],
        [w if r["toxic"] else 0.0 for w, r in zip(weight, points, strict=True)],
        weight,
    )
    return raw


def _sample_words(batches):
    schema = arrow_schema("doc_id long, part int, toxic boolean, words array<string>")
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256).to_pydict()
            words = [sorted(windows(t)) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip((rows["doc_id"], rows["part"], rows["toxic"], words), schema, strict=True)],
                schema=schema,
            )


def raw_score(model: Model, words) -> float:
    """The largest weight among the windows."""
    weights, key = model.weights, model.distance.key
    return max((weights.get(key(word), 0.0) for word in words), default=NO_WINDOW)


def score_texts(model: Model | None, texts) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return apply_isotonic(model.knots, np.array([raw_score(model, windows(t)) for t in texts], float))


def toxicity_scores(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: doc_id, score in [0, 1]."""

    def score(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                scores = score_texts(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores)], names=["doc_id", "score"]
                )
            give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are."""
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(score_texts(model, part.column(at).to_pylist()) < threshold))
            give_back()

    return docs.mapInArrow(keep, docs.schema)
