"""Tool-call records: JSON lists of available tools and expected calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotflow.functions.lambdas import empty
from cotflow.functions.tags import STRICT, json_list

# Texts for missing fields.
NO_NAME, NO_DESCRIPTION = "Unknown", "No description"

TOOL = "struct<name:string,description:string,parameters:string>"
CALL = "struct<name:string,arguments:string>"


def parse_tool_calls(df: DataFrame) -> DataFrame:
    """Both lists parsed; an empty text is an empty list, and if either is broken both are.

    Broken means not strict JSON. A valid value that is no list holds no entries itself, but
    leaves the other side as it is.
    """

    def parsed(name: str, element: str) -> Column:
        blank = F.coalesce(F.col(name), F.lit("")) == ""
        text = F.trim(F.col(name))
        # One value and nothing else, of whatever kind.
        wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
        other = (F.size(wrapped) == 1) & ~text.startswith("[")
        return F.when(blank | other, empty(f"array<{element}>")).otherwise(json_list(text, element))

    both = df.select(
        "id", "query",
        parsed("tools", TOOL).alias("tools"), parsed("answers", CALL).alias("answers"),
    )
    whole = F.col("tools").isNotNull() & F.col("answers").isNotNull()
    return both.select(
        "id", "query",
        F.when(whole, F.col("tools")).otherwise(empty(f"array<{TOOL}>")).alias("tools"),
        F.when(whole, F.col("answers")).otherwise(empty(f"array<{CALL}>")).alias("answers"),
    )


def explode_tools(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("id", F.posexplode("tools").alias("at", "t"))
    return rows.select(
        "id",
        (F.col("at") + 1).alias("tool_no"),
        F.coalesce("t.name", F.lit(NO_NAME)).alias("name"),
        F.coalesce("t.description", F.lit(NO_DESCRIPTION)).alias("description"),
    )


def explode_calls(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("id", F.posexplode("answers").alias("at", "c"))
    return rows.select(
        "id",
        (F.col("at") + 1).alias("call_no"),
        F.coalesce("c.name", F.lit(NO_NAME)).alias("name"),
        F.coalesce("c.arguments", F.lit("{}")).alias("arguments"),
    )
