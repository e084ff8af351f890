"""Whole jobs over tables, each a composition of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotflow.functions.text import pipeline_type, sft_prompt
from cotflow.operators import analysis, consistency, cots, datasets, prompts, segments
from cotflow.operators.graphs import value_dependency_edges
from cotflow.operators.orderings import reasoning_paths
from cotflow.operators.reconciliation import reconcile_ids
from cotflow.operators.sampling import train_val_split
from cotflow.operators.scoring import accuracy, score_predictions
from cotflow.session import stored


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores before work that costs far more than the move.

    A graph record of a few kilobytes can take milliseconds to enumerate, so splits sized
    by bytes are far too large for it, and a results file with one array is one task.
    """
    return df.repartition(_width(df))


def spread_scan(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a plain scan only if it has fewer splits than there are cores."""
    width = _width(scan)
    return scan if scan.rdd.getNumPartitions() >= width else scan.repartition(width)


def _width(df: DataFrame) -> int:
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


def graphs_from_answers(examples: DataFrame) -> DataFrame:
    """Results straight from worked answers: segments by line, edges by value use."""
    drafted = examples.withColumn("segments", segments.segment_direct(F.col("answer")))
    noded = drafted.withColumn("nodes", segments.renumbered_nodes(F.col("segments")))
    linked = noded.withColumn("edges", value_dependency_edges(F.col("nodes")))
    return linked.select(
        *examples.columns,
        F.col("answer").alias("cot"),
        "segments",
        segments.filter_required(F.col("segments")).alias("required_segments"),
        "nodes",
        "edges",
        ((F.size("nodes") > 0) & (F.size("edges") > 0)).alias("success"),
        pipeline_type(F.lit("direct")).alias("pipeline_type"),
    )


def parse_responses(examples: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, successes per outcome) of one batch of responses."""
    results = prompts.assemble_results(examples, responses)
    return results, analysis.success_summary(results)


def alternative_sft(
    results: DataFrame, order: str, max_cots: int = 10, seed: int = 0
) -> DataFrame:
    """Results to training rows: paths, cap, original texts, training layout."""
    paths = reasoning_paths(spread(results), for_cots=True, seed=seed)
    kept = cots.cot_records(paths, results, order, max_cots, seed)
    return datasets.to_sft_alternative(cots.alternative_cots(kept))


def analyze_paths(paths: DataFrame) -> dict[str, DataFrame]:
    """The report's tables. Store ``paths`` first: they scan it three times in all, as summary and steps
    are stored; the report has fourteen parts that read them."""
    positions = analysis.step_positions(paths)
    steps = analysis.top_steps(analysis.step_flexibility(positions))
    steps = stored(steps.join(analysis.step_position_variance(positions), "step", "left"), "report-steps")
    summary = stored(analysis.analysis_summary(paths), "report-summary")
    return {"summary": summary, "steps": steps, "report": analysis.analysis_report(summary, steps)}


def check_ids(rows: DataFrame, reference_file: str | None = None) -> dict[str, DataFrame]:
    names = consistency.file_names(rows)
    differences = reconcile_ids(rows, names, reference_file)
    return {
        "files": consistency.ids_per_file(rows),
        "differences": consistency.sorted_differences(differences),
        "consistent": consistency.ids_consistent(differences, len(names)),
    }


def score(predictions: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    scored = score_predictions(predictions, truth)
    return scored, accuracy(scored)


def export_training(
    sft: DataFrame, key: str = "id", frac: float = 0.1, seed: int = 42, group_col: str | None = None
) -> DataFrame:
    """Training prompts with their side of the split. A split by rows reads ``sft`` up to five times, so
    that it is stored."""
    rows = stored(sft, "training-rows") if group_col is None else sft
    parted = train_val_split(rows, frac, seed, key, group_col)
    return parted.select(
        key, "part", sft_prompt(F.col("question"), F.col("answer")).alias("prompt")
    )
