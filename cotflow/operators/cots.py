"""Alternative chains of thought: capping, numbering, texts, metadata and summaries.

``paths`` means the records of ``reasoning_paths``, one row per example, so the work per
example needs no shuffle. ``cap_paths`` and ``number_cots`` serve tables stored with one
row per ordering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cotflow.functions.hashing import hash_key
from cotflow.functions.lambdas import let, upto
from cotflow.functions.text import COT_RULE_WIDTH, RULE_WIDTH, alt_answer, cot_text
from cotflow.operators.orderings import spelled

# Texts of the readable output.
NO_PATHS = "No paths found"
HEADING = "Alternative Chain-of-Thought Reasoning Paths"


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record per key, as when later entries overwrite earlier ones.

    A missing order comes before any other; of records with one order the larger digest counts,
    so a rerun chooses alike, and of equal records one stays. Every task ranks its own rows and
    sends one per key, so a hot key does not gather; the records are made and moved once. Columns of
    types that cannot be written as JSON are not supported.
    """
    rest = [c for c in df.columns if c != key]
    latest = Window.partitionBy(key).orderBy(F.desc(order), F.desc("__hash"), F.desc("__digest"))
    marked = df.withColumns({"__hash": F.xxhash64(*rest), "__digest": F.md5(F.to_json(F.struct(*rest)))})
    return marked.withColumn("__place", F.row_number().over(latest)).where("__place = 1").select(*df.columns)


def attach_original(paths: DataFrame, originals: DataFrame, order: str) -> DataFrame:
    """Question and answers of the original example; '' where the original is missing."""
    wanted = ["question", "answer", "final_answer"]
    latest = keep_last(originals.select("example_id", order, *wanted), "example_id", order)
    joined = paths.join(latest.drop(order), "example_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in wanted})


def kept_numbers(total: Column, max_cots: int, seed: int, key: Column) -> Column:
    """Path numbers to keep, ascending: all of them, or a seeded random choice of max_cots."""

    def chosen(numbers: Column) -> Column:
        drawn = F.array_sort(
            F.transform(
                numbers, lambda i: F.struct(hash_key(seed, key, i).alias("h"), i.alias("i"))
            )
        )
        return F.array_sort(F.transform(F.slice(drawn, 1, max_cots), lambda d: d["i"]))

    return let(
        upto(total), lambda n: F.when(F.size(n) > max_cots, chosen(n)).otherwise(n)
    )


def cap_paths(rows: DataFrame, max_cots: int = 10, seed: int = 0) -> DataFrame:
    """The same choice on one row per ordering; ranks are cut before the shuffle."""
    order = Window.partitionBy("example_id").orderBy(
        hash_key(seed, F.col("example_id"), F.col("path_no")), "path_no"
    )
    ranked = rows.withColumn("draw", F.row_number().over(order))
    return ranked.where(F.col("draw") <= max_cots).drop("draw")


def number_cots(rows: DataFrame) -> DataFrame:
    """1-based number of each kept ordering within its example."""
    order = Window.partitionBy("example_id").orderBy("path_no")
    return rows.withColumn("cot_no", F.row_number().over(order))


def preview(paths: DataFrame, k: int = 3) -> DataFrame:
    """The first k orderings per example with their step texts, and how many more there are.

    Examples with an error or without orderings have one row that says so.
    """
    told = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("total_paths", F.lit(0)) == 0, NO_PATHS)
    shown = paths.select(
        "example_id", "node_ids", "node_texts", "total_paths",
        F.coalesce("method", F.lit("unknown")).alias("method"),
        F.coalesce(F.col("complexity_estimate")["complexity"], F.lit("unknown")).alias("complexity"),
        told.alias("error"),
        F.posexplode_outer(F.slice("orderings", 1, k)).alias("at", "ordering"),
        F.greatest(F.size("orderings") - k, F.lit(0)).alias("more"),
    )
    good = F.col("error").isNull()

    def joined(names: str, mark: str) -> Column:
        return F.when(good, F.array_join(spelled(F.col("ordering"), F.col(names)), mark))

    return shown.select(
        "example_id", "error",
        *[F.when(good, F.col(c)).alias(c) for c in ("total_paths", "method", "complexity")],
        F.when(good, F.col("at") + 1).alias("path_no"),
        joined("node_ids", " → ").alias("sequence"),
        joined("node_texts", "\n").alias("texts"),
        F.when(good, F.col("more")).alias("more"),
    )


def preview_text(rows: DataFrame) -> DataFrame:
    """The rows of ``preview`` as readable blocks; a block's first row carries the header of its example."""
    rule = "=" * RULE_WIDTH
    header = F.concat(
        F.lit(f"{rule}\nEXAMPLE: "), "example_id", F.lit("\nTotal Paths: "), "total_paths", F.lit(" (method: "), "method",
        F.lit(", complexity: "), "complexity", F.lit(f")\n{rule}\n"),
    )
    steps = F.regexp_replace(F.concat(F.lit("  "), "texts"), "\n", "\n  ")
    block = F.concat(
        F.when(F.col("path_no") == 1, header).otherwise(""), F.lit("PREVIEW - Alternative COT "), "path_no", F.lit(":\n" + "-" * 50 + "\nSequence: "),
        "sequence", F.lit("\n\n"), steps,
    )
    return rows.select("example_id", "path_no", F.coalesce(F.concat("example_id", F.lit(": "), "error"), block).alias("text"))


def cot_records(
    paths: DataFrame, originals: DataFrame, order: str, max_cots: int = 10, seed: int = 0,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per example its kept orderings, spelled out and numbered, and its original texts.

    ``cots`` is an array of struct(cot_no, path_no, sequence, texts), empty for examples
    without orderings. Capping happens in the row; only the join by example id shuffles, and it moves
    node numbers: they are spelled out behind it. ``store`` stores the joined records, for callers that
    read them several times.
    """
    numbers = kept_numbers(F.size("orderings"), max_cots, seed, F.col("example_id"))
    picked = F.transform(
        numbers, lambda number: F.struct(number.alias("path_no"), F.get(F.col("orderings"), number - 1).alias("ordering"))
    )
    kept = paths.select(
        "example_id", "total_paths", "method",
        F.col("complexity_estimate")["complexity"].alias("complexity"),
        picked.alias("picked"), "node_ids", "node_texts",
    )
    records = attach_original(kept, originals, order)
    if store:
        records = store(records)

    def spell(pick: Column, at: Column) -> Column:
        return F.struct(
            (at + 1).alias("cot_no"),
            pick["path_no"].alias("path_no"),
            spelled(pick["ordering"], F.col("node_ids")).alias("sequence"),
            spelled(pick["ordering"], F.col("node_texts")).alias("texts"),
        )

    cots = F.transform("picked", spell).alias("cots")
    return records.select("example_id", "total_paths", "method", "complexity", cots, "question", "answer", "final_answer")


def alternative_cots(records: DataFrame) -> DataFrame:
    """One row per kept ordering with its readable text and its training answer."""
    rows = records.select("example_id", "question", "final_answer", F.inline("cots"))
    return rows.select(
        "*",
        alt_answer(F.col("texts"), F.col("final_answer")).alias("answer"),
        cot_text(F.col("cot_no"), F.col("sequence"), F.col("texts")).alias("cot_text"),
    )


def combined_cots_text(records: DataFrame) -> DataFrame:
    """One readable document per example that has orderings."""
    kept = F.size("cots")
    note = F.when(
        F.col("total_paths") > kept,
        F.concat(F.lit(" (sampled "), kept, F.lit(" of "), F.col("total_paths"), F.lit(" paths)")),
    ).otherwise("")
    parts = F.transform(
        "cots",
        lambda c: F.concat(
            cot_text(c["cot_no"], c["sequence"], c["texts"]),
            F.lit("\n" + "-" * COT_RULE_WIDTH + "\n\n"),
        ),
    )
    document = F.concat(
        F.lit(f"{HEADING}\nExample: "), F.col("example_id"),
        F.lit("\nTotal Paths Generated: "), F.col("total_paths"),
        F.lit(" (method: "), F.col("method"), F.lit(", complexity: "), F.col("complexity"),
        F.lit(")\nCOTs Saved: "), kept, note,
        F.lit("\n" + "=" * RULE_WIDTH + "\n\n"), F.array_join(parts, ""),
    )
    return records.where(kept > 0).select("example_id", document.alias("document"))


def alt_cot_metadata(paths: DataFrame, max_cots: int = 10) -> DataFrame:
    """What was saved per example; examples with an error or no paths have no metadata."""
    usable = paths.where(F.col("error").isNull() & (F.col("total_paths") > 0))
    return usable.select(
        "example_id",
        F.col("total_paths").alias("total_paths_generated"),
        F.least(F.size("orderings"), F.lit(max_cots)).alias("cots_saved"),
        (F.size("orderings") > max_cots).alias("sampling_applied"),
        F.lit(max_cots).alias("max_cots_limit"),
        "method",
        "complexity_estimate",
    )


def alt_cot_results(paths: DataFrame, max_cots: int = 10) -> DataFrame:
    """Per example: the number saved, or why none were."""
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(
        F.coalesce(F.col("total_paths"), F.lit(0)) == 0, NO_PATHS
    )
    saved = F.least(F.size("orderings"), F.lit(max_cots))
    return paths.select(
        "example_id",
        F.when(error.isNull(), saved).otherwise(F.lit(0)).alias("cots_saved"),
        error.alias("error"),
    )


def alt_cot_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_examples"),
        F.count_if(F.col("error").isNull()).alias("successful_examples"),
        F.coalesce(F.sum("cots_saved"), F.lit(0)).cast("bigint").alias("total_cots_saved"),
    )
