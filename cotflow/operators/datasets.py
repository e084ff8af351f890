"""Training rows from original examples and from alternative chains of thought."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cotflow.functions.text import id_suffix

SPLITS = ("train", "test")


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def to_sft_original(examples: DataFrame, split: str | Column = "train") -> DataFrame:
    """Missing texts become ''; a final answer that was not found stays NULL. The split is one
    name for all rows or a column."""
    if isinstance(split, str):
        if split not in SPLITS:
            raise ValueError(f"invalid split {split!r}: must be one of {SPLITS}")
        split = F.lit(split)
    return examples.select(
        split.alias("split"),
        id_suffix(F.col("example_id")).alias("id"),
        _or_empty("question"),
        _or_empty("answer"),
        "final_answer",
    )


def to_sft_alternative(cots: DataFrame) -> DataFrame:
    """Alternative chains of thought are always training rows."""
    return cots.select(
        F.lit("train").alias("split"),
        id_suffix(F.col("example_id")).alias("id"),
        _or_empty("question"),
        _or_empty("answer"),
        _or_empty("final_answer"),
    )


def filter_examples(df: DataFrame, needle: str, required: bool = False) -> DataFrame:
    """Examples whose id contains the text, upper and lower case alike.

    A run that writes asks with ``required``: where nothing matches it stops with an error before
    anything is written. Looking for the first match reads ids alone and ends when it is found.
    """
    found = df.where(F.contains(F.lower("example_id"), F.lit(needle.lower())))
    if required and found.select("example_id").isEmpty():
        raise LookupError(f"no example id contains {needle!r}")
    return found


def union_styles(datasets: dict[str, DataFrame]) -> DataFrame:
    """Datasets of several styles under one another, told apart by ``type``."""
    tagged = [df.withColumn("type", F.lit(name)) for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, tagged)


def split_counts(sft: DataFrame) -> DataFrame:
    return sft.groupBy("split").agg(F.count("*").alias("rows"))
