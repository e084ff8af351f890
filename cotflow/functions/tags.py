"""Tagged blocks in model responses: plain text and JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cotflow import schemas
from cotflow.functions.lambdas import let


BLANKS = " \t\n\x0b\f\r"


def tag_text(response: Column, tag: str) -> Column:
    """Trimmed text between the first ``<tag>`` and its close tag; NULL without one.

    Two searches for fixed texts, each begun where the one before ended.
    """
    opening, closing = F.lit(f"<{tag}>"), F.lit(f"</{tag}>")
    start = F.position(opening, response)
    begin = start + len(f"<{tag}>")
    stop = F.position(closing, response, begin)
    body = F.btrim(F.substring(response, begin, stop - begin), F.lit(BLANKS))
    return F.when((start > 0) & (stop > 0), body)


# JSON as the standard has it: no comments, single quotes or bare control characters.
STRICT = {"allowSingleQuotes": "false", "allowComments": "false", "allowUnquotedControlChars": "false"}


def json_list(text: Column, element: str) -> Column:
    """Parse text that must be exactly one strict JSON list; NULL otherwise.

    The text is wrapped in one more list first: the parser stops at the end of the first
    value, so without the wrapping it would accept anything that follows the list.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), f"array<array<{element}>>", STRICT
    )
    return let(
        wrapped,
        lambda w: F.when(text.startswith("[") & (F.size(w) == 1), F.get(w, F.lit(0))),
    )


def _element(list_type: str) -> str:
    return list_type.removeprefix("array<").removesuffix(">")


def extract_cot(response: Column) -> Column:
    return tag_text(response, "cot")


def extract_segments(response: Column) -> Column:
    """Segments of a response; a flag may be written as a number or as true or false."""
    raw = json_list(tag_text(response, "segments"), "struct<id:string,text:string,is_required:string>")

    def flagged(s: Column) -> Column:
        flag = F.when(s["is_required"] == "true", 1).when(s["is_required"] == "false", 0)
        number = s["is_required"].try_cast("double")
        whole = F.when(number == F.rint(number), number.try_cast("int"))
        return F.struct(s["id"].alias("id"), s["text"].alias("text"), flag.otherwise(whole).alias("is_required"))

    return F.transform(raw, flagged)


def extract_nodes(response: Column) -> Column:
    return json_list(tag_text(response, "nodes"), _element(schemas.NODES))


def extract_edges(response: Column) -> Column:
    """Edge lists of any length; an entry that is not a list becomes NULL, not a failure."""
    entries = json_list(tag_text(response, "edges"), "string")
    return F.transform(entries, lambda e: F.from_json(e, "array<string>", STRICT))


def extract_graph(response: Column) -> Column:
    """struct(nodes, edges) when both lists parse; empty lists are accepted here."""
    nodes, edges = extract_nodes(response), extract_edges(response)
    return let(
        F.struct(nodes.alias("nodes"), edges.alias("edges")),
        lambda g: F.when(g["nodes"].isNotNull() & g["edges"].isNotNull(), g),
    )
