"""Segment lists: filters, statistics, rule-based segmentation and contract checks.

All checks work inside the example's own row and explode only the violations found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotflow import schemas
from cotflow.functions.lambdas import empty, let
from cotflow.functions.text import strip_calc_markup

# The prompt rules' segment limits and word lists.
SEGMENT_LIMITS = {
    "regular": (None, 15),
    "decontextualized": (None, 15),
    "direct": (None, 15),
    "reasoning_only_decontextualized": (None, 12),
    "reasoning_only_direct": (None, 12),
    "consolidated": (5, 8),
}
TRANSITIONS = ("so", "then", "therefore", "thus", "next")
PRONOUNS = ("it", "this", "that", "these", "them")


def filter_required(segments: Column) -> Column:
    return _with_flag(segments, 1)


def filter_optional(segments: Column) -> Column:
    return _with_flag(segments, 0)


def _with_flag(segments: Column, flag: int) -> Column:
    kept = F.filter(segments, lambda s: F.coalesce(s["is_required"] == flag, F.lit(False)))
    return F.coalesce(kept, empty(schemas.SEGMENTS))


def segment_stats(segments: Column) -> Column:
    """Counts, ratio and the two text lists; an error when there are no segments."""
    total = F.coalesce(F.greatest(F.size(segments), F.lit(0)), F.lit(0))

    def describe(parts: Column) -> Column:
        required, optional = parts["required"], parts["optional"]
        return F.struct(
            total.alias("total_segments"),
            F.size(required).alias("required_count"),
            F.size(optional).alias("optional_count"),
            F.try_divide(F.size(required), total).alias("required_ratio"),
            F.transform(required, lambda s: s["text"]).alias("required_segments"),
            F.transform(optional, lambda s: s["text"]).alias("optional_segments"),
            F.when(total == 0, "No segments provided").alias("error"),
        )

    parts = F.struct(
        filter_required(segments).alias("required"), filter_optional(segments).alias("optional")
    )
    return let(parts, describe)


def segment_direct(answer: Column) -> Column:
    """Segments of a worked answer without a model: one per line, marker lines dropped.

    Calculator notes are removed; a line counts as required when it calculates something.
    """
    texts = F.transform(F.split(answer, "\n"), lambda x: F.trim(strip_calc_markup(x)))
    kept = F.filter(texts, lambda x: (x != "") & ~x.startswith("####"))
    return F.transform(
        kept,
        lambda x, i: F.struct(
            F.concat(F.lit("s"), (i + 1).cast("string")).alias("id"),
            x.alias("text"),
            F.when(F.contains(x, F.lit("=")), 1).otherwise(0).alias("is_required"),
        ),
    )


def renumbered_nodes(segments: Column) -> Column:
    """Graph nodes for the required segments, ids s1.. in order of appearance."""
    return F.transform(
        filter_required(segments),
        lambda s, i: F.struct(
            F.concat(F.lit("s"), (i + 1).cast("string")).alias("id"), s["text"].alias("text")
        ),
    )


def _sequential_ids() -> Column:
    def wrong(s: Column, i: Column) -> Column:
        place = (i + 1).cast("string")
        same = F.coalesce(s["id"] == F.concat(F.lit("s"), place), F.lit(False))
        return F.when(~same, F.concat(place, F.lit(":"), F.coalesce(s["id"], F.lit("null"))))

    return F.array_compact(F.transform("segments", wrong))


def _segment_count() -> Column:
    """Counts outside the limits of the row's style."""
    count, bad = F.size("segments"), F.lit(False)
    for style, (low, high) in SEGMENT_LIMITS.items():
        outside = count > high
        if low is not None:
            outside = outside | (count < low)
        bad = bad | ((F.col("style") == style) & outside)
    return F.when(bad & F.col("segments").isNotNull(), F.array(count.cast("string")))


def _exact_excerpt() -> Column:
    missing = F.filter("segments", lambda s: F.instr(F.col("cot"), s["text"]) == 0)
    return F.transform(missing, lambda s: s["id"])


def _non_overlap() -> Column:
    """Segments are looked up one after the other, each behind the end of the one before; a text
    that stands in the chain of thought, but nowhere behind that end, overlaps."""
    cot = F.col("cot")

    def advance(seen: Column, s: Column) -> Column:
        ahead = F.position(s["text"], cot, seen["reach"])
        late = (ahead == 0) & (F.instr(cot, s["text"]) > 0)
        return F.struct(
            F.when(ahead > 0, ahead + F.length(s["text"])).otherwise(seen["reach"]).alias("reach"),
            F.when(late, F.concat(seen["late"], F.array(s["id"]))).otherwise(seen["late"]).alias("late"),
        )

    worded = F.filter("segments", lambda s: F.coalesce(s["text"], F.lit("")) != "")
    start = F.struct(F.lit(1).alias("reach"), empty("array<string>").alias("late"))
    return F.aggregate(worded, start, advance, lambda seen: seen["late"])


def _decontextualized() -> Column:
    pattern = rf"(?i)^\s*({'|'.join(TRANSITIONS)})\b|\b({'|'.join(PRONOUNS)})\b"
    leaning = F.filter("segments", lambda s: s["text"].rlike(pattern))
    return F.transform(leaning, lambda s: s["id"])


def _graph_covers_required() -> Column:
    """Texts of required segments without a node, and nodes without a required segment."""

    def compare(t: Column) -> Column:
        missing = F.array_except(t["required"], t["nodes"])
        extra = F.array_except(t["nodes"], t["required"])
        return F.concat(
            F.transform(missing, lambda x: F.concat(F.lit("missing: "), x)),
            F.transform(extra, lambda x: F.concat(F.lit("extra: "), x)),
        )

    texts = F.struct(
        F.transform(filter_required(F.col("segments")), lambda s: s["text"]).alias("required"),
        F.transform("nodes", lambda n: n["text"]).alias("nodes"),
    )
    return let(texts, compare)


RULES = {
    "sequential_ids": _sequential_ids,
    "segment_count": _segment_count,
    "exact_excerpt": _exact_excerpt,
    "non_overlap": _non_overlap,
    "decontextualized": _decontextualized,
    "graph_covers_required": _graph_covers_required,
}


def check_contracts(results: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """Violations of the named prompt rules as (example_id, rule, detail), in one pass.

    Rules read segments, and some of them cot, nodes or style.
    """

    def entries(rule: str) -> Column:
        details = F.coalesce(RULES[rule](), empty("array<string>"))
        return F.transform(
            details, lambda d: F.struct(F.lit(rule).alias("rule"), d.alias("detail"))
        )

    return results.select("example_id", F.inline(F.concat(*[entries(rule) for rule in rules])))
