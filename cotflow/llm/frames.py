"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotflow.session import drop_stage, stage_path


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under names of its own; others cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cut lineage that any executor can read."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stage_path = path
    return stored


def forget(*stages: DataFrame) -> None:
    """Delete staged tables whose last reader has been stored."""
    for stored in stages:
        drop_stage(stored.sparkSession, stored.stage_path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def draw(*key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
