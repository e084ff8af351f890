"""The corpus pipeline: raw documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is
written to the shared folder before the next one reads it. All stages but the last return the
columns of documents. Toxic documents, all but the first of near-duplicates, and documents that
contain a benchmark item go; words repeated from an earlier document are cut; the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotflow.llm import contamination, near_dup, packing, substrings, toxicity
from cotflow.llm.frames import staged
from cotflow.sources.corpora import table

# No SQL expresses a fitted classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored toxic; the classifier learns from the labelled ones among all documents."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every class of near-duplicates, and every row without an id."""
    return near_dup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words covered by a 20-word window that starts earlier; no document is dropped."""
    cut = substrings.cut_repeated(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; null and empty texts contain none."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence, with their token ids; a null text counts as empty."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", contaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
