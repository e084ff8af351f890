"""Scoring of generated answers against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotflow.functions.answers import answers_match, final_answer_strict


def score_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each generated text beside its truth; both answers are cut out strictly."""
    wanted = truth.select(
        "example_id", "question", final_answer_strict(F.col("answer")).alias("true_answer")
    )
    given = predictions.select(
        "example_id",
        "generated_text",
        final_answer_strict(F.col("generated_text")).alias("predicted_answer"),
    )
    joined = wanted.join(given, "example_id")
    return joined.select(
        "example_id", "question", "true_answer", "predicted_answer", "generated_text",
        answers_match(F.col("predicted_answer"), F.col("true_answer")).alias("correct"),
    )


def accuracy(scored: DataFrame) -> DataFrame:
    right, total = F.count_if("correct"), F.count("*")
    return scored.agg(
        F.coalesce(F.try_divide(right, total), F.lit(0.0)).alias("accuracy"),
        right.alias("correct"),
        total.alias("total"),
    )
