"""Id sets of dataset files: distinct ids, differences from a reference file, equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ids_per_file(rows: DataFrame) -> DataFrame:
    """Distinct ids, rows without an id, and (if the reader marks them) unreadable lines."""
    bad = F.col("bad_line") if "bad_line" in rows.columns else F.lit(False)
    # Counting per (file, id) first keeps a file with most of the rows off a single task.
    pairs = rows.groupBy("file", "id", bad.alias("bad")).agg(F.count("*").alias("n"))
    missing = F.when(F.col("id").isNull() & ~F.col("bad"), F.col("n"))
    return pairs.groupBy("file").agg(
        F.count_if(F.col("id").isNotNull()).alias("distinct_ids"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_id_rows"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("bad_lines"),
    )


def file_names(rows: DataFrame) -> list[str]:
    """The dataset files, smallest name first: as many names as the reader listed."""
    return sorted(r["file"] for r in rows.select("file").distinct().collect())


def id_differences(
    rows: DataFrame, files: list[str] | None = None, reference_file: str | None = None
) -> DataFrame:
    """(file, side, id): ids a file lacks or has beyond the reference file.

    One aggregate by id gathers the few file names that hold it; comparing that set with
    all names gives every difference at once, without pairing files with ids.
    """
    names = files if files is not None else file_names(rows)
    if reference_file is not None and names and reference_file not in names:
        raise ValueError(f"no dataset file {reference_file!r}")
    reference = reference_file or (min(names) if names else "")
    others = F.array(*[F.lit(f) for f in sorted(names) if f != reference]).cast("array<string>")
    held = (
        rows.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.collect_set("file").alias("holders"))
    )
    has_reference = F.array_contains("holders", reference)
    lacking = F.when(has_reference, F.array_except(others, "holders")).otherwise(
        F.array_intersect(others, "holders")
    )
    return held.select(
        F.explode(lacking).alias("file"),
        F.when(has_reference, "missing").otherwise("extra").alias("side"),
        "id",
    )


def sorted_differences(differences: DataFrame) -> DataFrame:
    """Differences in report order; ids sort as text. A range sort, never one list per file."""
    return differences.orderBy("file", F.col("side").desc(), "id")


def ids_consistent(differences: DataFrame, n_files: int | None = None) -> DataFrame:
    """One row: whether every file holds exactly the reference ids.

    With a known number of files below two there is nothing to check: ``consistent`` is NULL.
    """
    nothing = F.lit(n_files is not None and n_files < 2)
    return differences.agg(
        F.when(~nothing, F.count("*") == 0).alias("consistent"),
        F.count_if(F.col("side") == "missing").alias("missing_ids"),
        F.count_if(F.col("side") == "extra").alias("extra_ids"),
    )


def all_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").isNotNull()).select("id").distinct()
