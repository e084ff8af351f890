"""Reports over reasoning paths. Every group is reduced inside its tasks before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How many steps of each class the report lists.
LISTED = {"always_first": 5, "always_last": 5, "flexible": 10}


def success_summary(results: DataFrame) -> DataFrame:
    good, total = F.count_if(F.coalesce(F.col("success"), F.lit(False))), F.count("*")
    return results.agg(
        good.alias("successful"),
        total.alias("total"),
        F.coalesce(F.try_divide(good * 100, total), F.lit(0.0)).alias("percent"),
    )


def path_run_summary(paths: DataFrame) -> DataFrame:
    return paths.agg(
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count("*").alias("total"),
        F.coalesce(F.sum("total_paths"), F.lit(0)).cast("bigint").alias("total_paths"),
    )


def flexibility_stats(paths: DataFrame) -> DataFrame:
    total = F.coalesce(F.col("total_paths"), F.lit(0))
    return paths.where(F.col("error").isNull()).agg(
        F.count_if(total > 1).alias("examples_with_multiple_paths"),
        F.coalesce(F.avg(total), F.lit(0.0)).alias("avg_paths_per_example"),
        F.coalesce(F.max(total), F.lit(0)).alias("max_paths"),
    )


def path_bucket(total: Column) -> Column:
    """Size class of a path count; a count of zero falls into the second class."""
    return (
        F.when(total == 1, "single_path")
        .when(total <= 10, "2-10_paths")
        .when(total <= 100, "11-100_paths")
        .otherwise("100+_paths")
    )


def path_count_distribution(paths: DataFrame) -> DataFrame:
    good = paths.where(F.col("error").isNull())
    bucket = path_bucket(F.coalesce(F.col("total_paths"), F.lit(0)))
    return good.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("examples"))


def method_usage(paths: DataFrame) -> DataFrame:
    good = paths.where(F.col("error").isNull())
    method = F.coalesce(F.col("method"), F.lit("unknown")).alias("method")
    return good.groupBy(method).agg(F.count("*").alias("examples"))


def complexity_distribution(paths: DataFrame) -> DataFrame:
    good = paths.where(F.col("error").isNull())
    label = F.coalesce(F.col("complexity_estimate")["complexity"], F.lit("unknown"))
    return good.groupBy(label.alias("complexity")).agg(F.count("*").alias("examples"))


def alt_cot_overview(paths: DataFrame) -> DataFrame:
    """Totals over all rows, error rows counting as zero paths."""
    total, good = F.coalesce(F.col("total_paths"), F.lit(0)), F.col("error").isNull()
    return paths.agg(
        F.count("*").alias("total_examples"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("total_paths"),
        F.count_if(total > 1).alias("examples_with_multiple"),
        F.try_divide(F.sum(total), F.count_if(good)).alias("avg_paths"),
    )


def step_positions(paths: DataFrame) -> DataFrame:
    """Positions of every step over the orderings of its example, if it has several.

    All orderings of an example are in its row, so this needs no shuffle.
    """
    keys = [c for c in ("example_ord", "example_id") if c in paths.columns]

    def describe(step: Column, number: Column) -> Column:
        at = F.transform("orderings", lambda o: (F.array_position(o, number) - 1).cast("int"))
        return F.struct(step.alias("step"), at.alias("at"))

    per_step = paths.select(
        *keys,
        (F.size("node_ids") - 1).alias("last_pos"),
        F.inline(F.when(F.size("orderings") > 1, F.transform("node_ids", describe))),
    )
    return per_step.select(
        *keys,
        "step",
        F.array_min("at").alias("min_pos"),
        F.array_max("at").alias("max_pos"),
        F.size(F.array_distinct("at")).alias("positions"),
        F.size("at").alias("occurrences"),
        F.get("at", F.lit(0)).alias("first_path_pos"),
        "last_pos",
    )


def step_flexibility(positions: DataFrame) -> DataFrame:
    """Examples per step where it always comes first, always last, or moves.

    A step fixed between the ends is counted nowhere. The first_seen columns tell where a
    class met the step first: example order, then place in that example's first ordering.
    """
    fixed, low = F.col("positions") == 1, F.col("min_pos")
    classes = {
        "always_first": fixed & (low == 0),
        "always_last": fixed & (low != 0) & (low == F.col("last_pos")),
        "flexible": ~fixed,
    }
    seen = F.struct(F.col("example_ord"), F.col("first_path_pos"))
    if dict(positions.dtypes)["example_ord"] in ("int", "bigint"):
        # One long, so that the aggregate hashes: positions take 20 bits.
        seen = F.col("example_ord").cast("bigint") * (1 << 20) + F.col("first_path_pos")
    aggregates = []
    for name, hit in classes.items():
        aggregates += [
            F.count_if(hit).alias(name),
            F.min(F.when(hit, seen)).alias(f"{name}_seen"),
        ]
    return positions.groupBy("step").agg(*aggregates)


def step_position_variance(positions: DataFrame) -> DataFrame:
    """Spread (latest minus earliest position) per step, from the last example that has it."""
    spread = F.col("max_pos") - F.col("min_pos")
    return (
        positions.where(F.col("occurrences") > 1)
        .groupBy("step")
        .agg(F.max_by(spread, F.col("example_ord")).alias("position_range"))
    )


def top_steps(flexibility: DataFrame, listed: dict[str, int] = LISTED) -> DataFrame:
    """The most frequent steps of each class, ties in order of first encounter.

    The classes are ranked side by side, so the paths are read once for all of them; the
    ranks are cut per task before the shuffle.
    """
    entries = [
        F.struct(
            F.lit(name).alias("class"),
            F.lit(k).alias("k"),
            F.col(name).alias("examples"),
            F.col(f"{name}_seen").alias("seen"),
        )
        for name, k in listed.items()
    ]
    long = flexibility.select("step", F.inline(F.array(*entries))).where("examples > 0")
    order = Window.partitionBy("class").orderBy(F.col("examples").desc(), "seen", "step")
    ranked = long.withColumn("rank", F.row_number().over(order))
    cut = ranked.where((F.col("rank") <= max(listed.values())) & (F.col("rank") <= F.col("k")))
    return cut.select("class", "rank", "step", "examples")


def analysis_summary(paths: DataFrame) -> DataFrame:
    """The whole summary as one long table (section, key, value).

    Every example adds its entries to the sections and one aggregate closes them, so the
    paths are read once and only a few hundred partial sums per task are shuffled.
    """
    good = F.col("error").isNull()
    total = F.when(good, F.coalesce(F.col("total_paths"), F.lit(0)))

    def entry(section: str, key: Column | str, value: Column) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        return F.struct(
            F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value")
        )

    single = F.array(
        entry("totals", "total_examples", F.lit(1)),
        entry("totals", "successful_examples", good.cast("int")),
        entry("flexibility_stats", "examples_with_multiple_paths", F.coalesce(total > 1, F.lit(False)).cast("int")),
        entry("flexibility_stats", "avg_paths_per_example", total),
        entry("flexibility_stats", "max_paths", total),
        entry("path_distribution", path_bucket(total), good.cast("int")),
        entry("method_usage", F.coalesce("method", F.lit("unknown")), good.cast("int")),
    )

    def step_entry(step: Column, number: Column) -> Column:
        at = F.transform("orderings", lambda o: F.array_position(o, number))
        low, high = F.array_min(at), F.array_max(at)
        section = (
            F.when(low != high, "flexible_steps")
            .when(low == 1, "always_first_steps")
            .when(low == F.size("node_ids"), "always_last_steps")
        )
        return F.struct(
            section.alias("section"), step.alias("key"), F.lit(1.0).alias("value")
        )

    steps = F.when(F.size("orderings") > 1, F.transform("node_ids", step_entry))
    entries = F.concat(
        single, F.coalesce(steps, F.array().cast("array<struct<section:string,key:string,value:double>>"))
    )
    long = paths.select(F.inline(entries)).where(F.col("section").isNotNull())
    closed = long.groupBy("section", "key").agg(
        F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.max("value").alias("max")
    )
    value = (
        F.when(F.col("key") == "avg_paths_per_example", F.col("avg"))
        .when(F.col("key") == "max_paths", F.col("max"))
        .otherwise(F.col("sum"))
    )
    listed = closed.select("section", "key", F.coalesce(value, F.lit(0.0)).alias("value"))
    fixed = F.col("section").isin("totals", "flexibility_stats")
    return listed.where(fixed | (F.col("value") > 0))


# Headings of the text report.
TITLE = "REASONING PATHS ANALYSIS REPORT"
SECTIONS = ("SUMMARY", "GENERATION METHODS", "PATH COUNT DISTRIBUTION", "REASONING STEP PATTERNS")
STEP_HEADINGS = {
    "always_first": "Steps that always come first:",
    "always_last": "Steps that always come last:",
    "flexible": "Most flexible steps (variable position):",
}


def analysis_report(summary: DataFrame, steps: DataFrame) -> DataFrame:
    """The readable report as lines (section, place, line) in that order.

    ``summary`` is the long table; ``steps`` has class, rank, step, examples and position_range.
    Only totals, methods, path classes and the listed steps are read, so the report stays small.
    """

    def texts(section: int, rows: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
        return [(section, place, line) for place, line in rows]

    fixed = texts(0, [(0, TITLE), (1, "=" * 50), (2, "")])
    for number, (name, width) in enumerate(zip(SECTIONS, (20, 20, 25, 25), strict=True), 1):
        fixed += texts(number, [(-2, name), (-1, "-" * width)])
        fixed += texts(number, [(10_000, "")]) if number < 4 else []
    lines = summary.sparkSession.createDataFrame(fixed, "section int, place int, line string")

    totals = {
        "total_examples": (1, "Total Examples: "), "successful_examples": (2, "Successful: "),
        "examples_with_multiple_paths": (4, "Examples with Multiple Paths: "),
        "avg_paths_per_example": (5, "Average Paths per Example: "), "max_paths": (6, "Maximum Paths Found: "),
    }
    number = F.coalesce("value", F.lit(0.0))
    whole = number.cast("bigint").cast("string")
    for key, (place, label) in totals.items():
        shown = F.format_string("%.1f", number) if key == "avg_paths_per_example" else whole
        lines = lines.unionByName(
            summary.where(F.col("section").isin("totals", "flexibility_stats") & (F.col("key") == key)).select(
                F.lit(1).alias("section"), F.lit(place).alias("place"), F.concat(F.lit(label), shown).alias("line")
            )
        )
    failed = summary.where("section = 'totals'").agg(
        F.sum(F.when(F.col("key") == "total_examples", F.col("value")).otherwise(-F.col("value"))).alias("value")
    )
    lines = lines.unionByName(
        failed.select(F.lit(1).alias("section"), F.lit(3).alias("place"), F.concat(F.lit("Failed: "), whole).alias("line"))
    )
    order = Window.orderBy("key")
    for section, name in ((2, "method_usage"), (3, "path_distribution")):
        rows = summary.where((F.col("section") == name) & (F.col("value") > 0))
        title = F.initcap(F.translate("key", "_", " "))
        lines = lines.unionByName(
            # A handful of methods and path classes.
            rows.select(
                F.lit(section).alias("section"), F.row_number().over(order).alias("place"),
                F.concat(title, F.lit(": "), whole, F.lit(" examples")).alias("line"),
            )
        )
    for i, (name, heading) in enumerate(STEP_HEADINGS.items()):
        own = steps.where(F.col("class") == name)
        shown = F.concat(F.lit("  "), "step", F.lit(": "), F.col("examples").cast("string"), F.lit(" examples"))
        if name == "flexible":
            spread = F.coalesce("position_range", F.lit(0)).cast("string")
            shown = F.concat(shown, F.lit(" (variance: "), spread, F.lit(")"))
        ends = [F.struct(F.lit(100 * i).alias("place"), F.lit(heading).alias("line"))]
        if name != "flexible":
            ends.append(F.struct(F.lit(100 * i + 99).alias("place"), F.lit("").alias("line")))
        framed = own.where("rank = 1").select(F.lit(4).alias("section"), F.inline(F.array(*ends)))
        lines = lines.unionByName(framed).unionByName(
            own.select(F.lit(4).alias("section"), (F.lit(100 * i) + F.col("rank")).alias("place"), shown.alias("line"))
        )
    return lines.orderBy("section", "place")
