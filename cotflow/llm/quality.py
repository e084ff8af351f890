"""Quality score: random Fourier features, ridge regression, isotonic calibration.

Every document is reduced to the 16 MEASURES. Random Fourier features of the standardised
measures approximate a Gaussian kernel; the normal equations of ridge regression are summed per
partition and then over partitions; an isotonic map, fitted on learning rows that the equations
did not see, turns the raw score into a probability. All labelled rows are used: what the driver
receives is FEATURES + 1 rows and at most BINS bins, whatever the size of the input.

Defined results: a null or empty text has measures 0 and is scored as such. Rows with a null id
are scored, but cannot be labelled. Without labelled rows every score is 0; with one kind of label
every score is that label. Repeated rows give repeated scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cotflow.llm.batches import arrow_schema, blocks
from cotflow.llm.calibration import apply_isotonic, fit_isotonic
from cotflow.llm.frames import draw, id_and_text, staged
from cotflow.llm.lines import MEASURES, measures

FEATURES = 128
KERNEL_WIDTH = 3.0  # in standard deviations of the measures
RIDGE = 1e-3  # times the number of rows
BINS = 2000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of MEASURES, one row per row of docs."""
    schema = arrow_schema("doc_id long, measures array<double>")

    def measure(batches):
        for part, texts in blocks(batches, "text"):
            rows = measures(texts)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(MEASURES)), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays([part.column(0), flat], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(measure, "doc_id long, measures array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, rows: np.ndarray) -> np.ndarray:
        turned = ((rows - self.mean) / self.scale) @ self.directions + self.phases
        return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(turned), np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return apply_isotonic(self.knots, self.raw(rows))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))


def fit(measured_docs: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality") -> Model | None:
    """Two passes over the measures of the labelled documents; None without any."""
    known = labels.select(
        labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label")
    ).dropna()
    rows = measured_docs.join(known, "doc_id").withColumn(
        "calibrates", draw(F.col("doc_id"), F.lit("calibrates")) < 0.2
    )
    first = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("measures")[i]).alias(f"m{i}") for i in range(len(MEASURES))],
        *[F.stddev_pop(F.col("measures")[i]).alias(f"s{i}") for i in range(len(MEASURES))],
    ).first()
    if not first["n"]:
        return None
    draws = np.random.default_rng(11)
    model = Model(
        np.array([first[f"m{i}"] for i in range(len(MEASURES))]),
        np.array([max(first[f"s{i}"], 1e-9) for i in range(len(MEASURES))]),
        draws.normal(size=(len(MEASURES), FEATURES)) / KERNEL_WIDTH,
        draws.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
        (np.array([0.0]), np.array([0.0])),
    )

    def normal_equations(batches):
        """One row of the sums [Z'Z | Z'y] per feature and task."""
        sums, n = np.zeros((FEATURES + 1, FEATURES + 2)), 0
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            sums += z.T @ np.hstack([z, y[:, None]])
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))],
                names=["feature", "sums"],
            )

    def add_up(key, table):
        total = np.sum([np.array(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"feature": [key[0].as_py()], "sums": [total.tolist()]}, schema=arrow_schema("feature int, sums array<double>"))

    learn = rows.where(~F.col("calibrates"))
    schema = "feature int, sums array<double>"
    summed = learn.select("measures", "label").mapInArrow(normal_equations, schema).groupBy("feature").applyInArrow(add_up, schema).collect()
    if summed:
        equations = np.array([r["sums"] for r in sorted(summed, key=lambda r: r["feature"])])
        n = equations[-1, FEATURES]
        model.weights = np.linalg.solve(
            equations[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), equations[:, -1]
        )

    def raw_scores(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            bins = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "label"])

    def bins_of(part):
        return part.select("measures", "label").mapInArrow(raw_scores, "bin int, label double").groupBy("bin").agg(
            F.sum("label").alias("positive"), F.count("*").alias("n")
        ).collect()

    # A handful of labels may leave nothing to calibrate on; then the learning rows serve.
    points = bins_of(rows.where("calibrates")) or bins_of(learn)
    model.knots = fit_isotonic(
        [(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in points], [r["positive"] for r in points], [r["n"] for r in points]
    )
    return model


def quality_scores(measured_docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score in [0, 1], one row per measured row."""

    def score(batches):
        for batch in batches:
            rows = _matrix(batch.column(1))
            scores = np.zeros(len(rows)) if model is None else model.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return measured_docs.select("doc_id", "measures").mapInArrow(score, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """Measure every document once, learn from the labelled ones, score all."""
    table = staged(measured(docs, id_col, text_col), "quality-measures")
    return quality_scores(table, fit(table, labels, id_col, label_col))
