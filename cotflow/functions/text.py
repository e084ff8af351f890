"""Text rules: prompt layout, file-name styles, chain-of-thought layout."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# Prompt texts, separators and the segmentation styles.
USER_SEPARATOR = "---USER---"
DEFAULT_SYSTEM = "You are a helpful assistant that follows instructions precisely."
MATH_SYSTEM = (
    "You are a helpful assistant that solves math problems step by step. "
    "Always end your answer with '#### [number]' where [number] is the final numerical answer."
)
STYLE_TEMPLATES = {
    "regular": ("segment_cot", "create_graph"),
    "consolidated": ("segment_cot_consolidated", "create_graph"),
    "decontextualized": ("segment_cot_decontextualized", "create_graph_decontextualized"),
    "direct": ("segment_cot_direct", "create_graph_direct"),
    "reasoning_only_decontextualized": (
        "segment_cot_reasoning_only_decontextualized",
        "create_graph_decontextualized",
    ),
    "reasoning_only_direct": ("segment_cot_reasoning_only_direct", "create_graph_direct"),
}
DIRECT_STYLES = ("direct", "reasoning_only_direct")
PREFIX = "alternative_cots_"
RULE_WIDTH, COT_RULE_WIDTH = 80, 60


def id_suffix(example_id: Column) -> Column:
    """The part after the last underscore."""
    return F.substring_index(example_id, "_", -1)


def strip_calc_markup(text: Column) -> Column:
    """Drop ``<<...>>`` calculator notes."""
    return F.regexp_replace(text, "<<[^>]*>>", "")


def split_prompt(text: Column) -> Column:
    """struct(system, user): cut at the first separator, both trimmed."""
    cut = F.instr(text, USER_SEPARATOR)
    system = F.when(cut > 0, _strip(F.substring(text, F.lit(1), cut - 1))).otherwise(
        F.lit(DEFAULT_SYSTEM)
    )
    rest = F.substring(text, cut + len(USER_SEPARATOR), F.length(text))
    user = F.when(cut > 0, _strip(rest)).otherwise(_strip(text))
    return F.struct(system.alias("system"), user.alias("user"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders and unescape doubled braces.

    The template is taken apart here, so braces inside the data stay as they are.
    """
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def _ascii(text: Column) -> Column:
    """Every character beyond ASCII as the escapes of its UTF-16 units."""

    def escaped(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return F.when(char.rlike(r"[^\x00-\x7f]"), F.regexp_replace(units, "(....)", r"\\u$1")).otherwise(char)

    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
    whole = F.array_join(F.transform(chars, escaped), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(text)


def indented_json(segments: Column, ascii_only: bool = True) -> Column:
    """A segment list as indented JSON text, one key per line; non-ASCII characters are escaped
    unless ``ascii_only`` is off."""

    def quoted(value: Column) -> Column:
        listed = F.to_json(F.array(value))
        inner = F.substring(listed, F.lit(2), F.length(listed) - 2)
        return F.when(value.isNull(), F.lit("null")).otherwise(_ascii(inner) if ascii_only else inner)

    def one(s: Column) -> Column:
        return F.concat(
            F.lit('  {\n    "id": '), quoted(s["id"]),
            F.lit(',\n    "text": '), quoted(s["text"]),
            F.lit(',\n    "is_required": '),
            F.coalesce(s["is_required"].cast("string"), F.lit("null")),
            F.lit("\n  }"),
        )

    body = F.array_join(F.transform(segments, one), ",\n")
    return F.when(F.size(segments) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n"), body, F.lit("\n]"))
    )


def _question_answer(question: Column, tail: Column, system: str | None) -> Column:
    system = MATH_SYSTEM if system is None else system
    head = F.lit(f"{system}\nQuestion: " if system else "Question: ")
    return F.concat(head, F.coalesce(question, F.lit("")), tail)


def sft_prompt(question: Column, answer: Column, system: str | None = None) -> Column:
    tail = F.concat(F.lit("\nAnswer: "), F.coalesce(answer, F.lit("")))
    return _question_answer(question, tail, system)


def eval_prompt(question: Column, system: str | None = None) -> Column:
    return _question_answer(question, F.lit("\nAnswer:"), system)


def style_from_filename(stem: Column) -> Column:
    """Segmentation style told by a paths-file stem; longer suffixes are tested first."""
    base = F.replace(stem, F.lit("_reasoning_paths"), F.lit(""))
    found = F.when(~F.contains(stem, F.lit("_reasoning_paths")), F.lit("regular"))
    for style in sorted(STYLE_TEMPLATES, key=len, reverse=True):
        found = found.when(F.endswith(base, F.lit(f"_{style}")), F.lit(style))
    return found.when(
        F.contains(base, F.lit("_direct_pipeline_results")), F.lit("direct")
    ).otherwise(F.lit("regular"))


def dataset_type_from_path(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/+")
    own, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return (
        F.when(own.startswith(PREFIX), own)
        .when(parent.startswith(PREFIX), parent)
        .otherwise(F.lit(PREFIX + "unknown"))
    )


def pipeline_type(style: Column, mode: Column | None = None) -> Column:
    direct = F.coalesce(style.isin(*DIRECT_STYLES), F.lit(False))
    if mode is not None:
        direct = direct | F.coalesce(mode == "direct", F.lit(False))
    return F.when(direct, F.lit("direct_answer_segmentation")).otherwise(
        F.lit("normal_with_cot_generation")
    )


def segment_template(style: Column) -> Column:
    return _template(style, 0)


def graph_template(style: Column) -> Column:
    return _template(style, 1)


def _template(style: Column, which: int) -> Column:
    found = None
    for name, templates in STYLE_TEMPLATES.items():
        hit = style == name
        value = F.lit(templates[which])
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found.otherwise(F.lit(STYLE_TEMPLATES["regular"][which]))


def cot_text(number: Column, sequence: Column, texts: Column) -> Column:
    """The readable form of one ordering."""
    title = F.concat(F.lit("# Alternative COT "), number.cast("string"))
    steps = F.array_join(texts, "\n")
    full = F.concat(
        title, F.lit("\n# Sequence: "), F.array_join(sequence, " → "), F.lit("\n\n"), steps,
        F.lit("\n"),
    )
    return F.when(
        F.coalesce(F.size(texts), F.lit(0)) <= 0,
        F.concat(title, F.lit("\n(No reasoning steps found)\n")),
    ).otherwise(full)


def alt_answer(texts: Column, final_answer: Column) -> Column:
    """Steps joined by newlines, closed by the marked final answer when there is one."""
    steps = F.array_join(texts, "\n")
    return F.when(
        F.coalesce(final_answer, F.lit("")) != "",
        F.concat(steps, F.lit("\n#### "), final_answer),
    ).otherwise(steps)
