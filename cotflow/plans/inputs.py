"""Corpora the queries run on, derived from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotflow.operators.orderings import reasoning_paths
from cotflow.plans.jobs import spread_scan
from cotflow.session import stage_path
from cotflow.sources import corpora
from cotflow.sources.corpora import table

_STAGED: dict[tuple[str, str, str], str] = {}


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return corpora.examples_from_orders(spread_scan(orders))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.results_from_examples(examples(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.responses_from_results(results(spark, sf_dir))


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpora.segments_from_documents(spread_scan(documents))


def line_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpora.line_graphs_from_documents(spread_scan(documents))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.examples_from_conversations(table(spark, sf_dir, "conversations"))


def multihop_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.multihop_from_documents(spread_scan(table(spark, sf_dir, "documents")))


def tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.tool_rows_from_events(table(spark, sf_dir, "events"))


def sft_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.sft_ids_from_documents(table(spark, sf_dir, "documents"))


def as_json(name: str, value: Column | None = None) -> Column:
    """A list column as JSON text, with its nulls."""
    value = F.col(name) if value is None else value
    return F.to_json(value, {"ignoreNullFields": "false"}).alias(name)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning paths in their chain-of-thought form, stored once per session.

    The reports read a stored table, as they would after a real run, instead of
    enumerating again for every report.
    """
    slot = (spark.sparkContext.applicationId, sf_dir, "paths")
    if slot not in _STAGED:
        path = stage_path(spark, "paths")
        reasoning_paths(results(spark, sf_dir), for_cots=True).write.parquet(path)
        _STAGED[slot] = path
    return spark.read.parquet(_STAGED[slot])
