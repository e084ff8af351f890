"""Requests to a model, its responses, and the results put together from them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cotflow.functions.tags import extract_cot, extract_edges, extract_nodes, extract_segments
from cotflow.functions.text import (
    STYLE_TEMPLATES,
    indented_json,
    pipeline_type,
    render_template,
    split_prompt,
)
from cotflow.operators.segments import filter_required

STAGES = ("cot", "segments", "graph")


def template_name(style: str, stage: str) -> str:
    """Template of a stage; an unknown style is treated as regular."""
    segment, graph = STYLE_TEMPLATES.get(style, STYLE_TEMPLATES["regular"])
    return {"cot": "generate_cot", "segments": segment, "graph": graph}[stage]


def attach_templates(examples: DataFrame, templates: DataFrame, stage: str) -> DataFrame:
    """Add the stage's template text by style; templates are (name, template) rows.

    Few names share all examples, so a shuffle by name would pile them up on as many tasks. Only
    the names that some style asks for are broadcast, one text each, so that side is bounded by
    the list of styles. Of several texts of one name the largest counts.
    """
    asked = sorted({template_name(style, stage) for style in STYLE_TEMPLATES})
    named_texts = templates.where(F.col("name").isin(asked)).groupBy("name").agg(F.max("template").alias("template"))
    name = F.lit(template_name("regular", stage))
    for known in STYLE_TEMPLATES:
        name = F.when(F.col("style") == known, template_name(known, stage)).otherwise(name)
    return examples.withColumn("name", name).join(F.broadcast(named_texts), "name", "left")


def render_prompt(df: DataFrame, template: str) -> Column:
    """The filled template; columns the data does not have yet count as missing."""
    fields = {
        "question": F.col("question"),
        "answer": F.col("answer"),
        "final_answer": F.col("final_answer"),
    }
    if "cot" in df.columns:
        fields["cot_output_from_prompt_1"] = F.col("cot")
    if "segments" in df.columns:
        fields["segments_from_prompt_2"] = indented_json(F.col("segments"))
    return render_template(template, fields)


def render_requests(df: DataFrame, templates: dict[str, str], stage: str) -> DataFrame:
    """One request per example: system and user message of the stage's filled template.

    Templates are a handful of texts that live in the plan, so rendering is a projection. ``df``
    may mix styles; a style of it whose template was not given fails the row that needs it, and
    a missing regular template fails at once.
    """
    regular = template_name("regular", stage)
    if regular not in templates:
        raise KeyError(f"no template {regular!r}")
    prompt = render_prompt(df, templates[regular])
    for style in STYLE_TEMPLATES:
        name = template_name(style, stage)
        if name == regular:
            continue
        lacking = F.raise_error(F.lit(f"no template {name!r} for style {style!r}")).cast("string")
        own = render_prompt(df, templates[name]) if name in templates else lacking
        prompt = F.when(F.col("style") == style, own).otherwise(prompt)
    rendered = df.select("example_id", F.lit(stage).alias("stage"), split_prompt(prompt).alias("p"))
    return rendered.select("example_id", "stage", "p.system", "p.user")


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with its response; NULL where none came back, the largest of several."""
    one = responses.groupBy("example_id", "stage").agg(F.max("response").alias("response"))
    return requests.join(one, ["example_id", "stage"], "left")


def generate_with(
    requests: DataFrame,
    complete: Callable[[pd.DataFrame], pd.Series],
    stored: DataFrame | None = None,
    in_flight: int | None = None,
    attempts: int = 3,
    backoff: float = 1.0,
    pause: float = 0.0,
) -> DataFrame:
    """Responses from a caller-supplied batch function over (system, user) frames.

    Requests that ``stored`` has an answer to are left out. A task hands over at most ``in_flight``
    requests at a time and waits ``pause`` seconds after each call, so tasks times in_flight bound
    what the model sees at once. A failing call is repeated after ``backoff``, twice and four times
    as many seconds and so on; the last of ``attempts`` failures ends the task, and Spark's own
    retries of it follow. Blank space around a response is removed.
    """
    if stored is not None:
        requests = requests.join(stored.select("example_id", "stage").distinct(), ["example_id", "stage"], "left_anti")

    def answer(part: pd.DataFrame) -> pd.Series:
        for attempt in range(attempts):
            try:
                found = complete(part)
                time.sleep(pause)
                return found
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(backoff * 2**attempt)
        raise ValueError("attempts must be 1 or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), in_flight or len(batch)):
                part = batch.iloc[start : start + (in_flight or len(batch))]
                yield part[["example_id", "stage"]].assign(response=answer(part)).assign(
                    response=lambda f: f["response"].str.strip()
                )

    return requests.select("example_id", "stage", "system", "user").mapInPandas(
        run, "example_id string, stage string, response string"
    )


def generate_stored(
    requests: DataFrame, complete: Callable[[pd.DataFrame], pd.Series], path: str, rounds: int = 10, **options
) -> DataFrame:
    """All responses, saved as they come: each round answers a share of the requests and appends it.

    What ``path`` already holds is not asked again, so a run that was broken off goes on where the
    last whole round ended. Spark commits an append as a whole. One run at a time may write to it.
    """
    spark = requests.sparkSession
    schema = "example_id string, stage string, response string"
    place = F.pmod(F.xxhash64("example_id", "stage"), F.lit(rounds))
    # Writing nothing makes the folder, so that the first round has something to read.
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    for turn in range(rounds):
        stored = spark.read.schema(schema).parquet(path)
        generate_with(requests.where(place == turn), complete, stored, **options).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def responses_by_example(responses: DataFrame) -> DataFrame:
    """The stages' responses side by side, one row per example.

    A later copy of a response cannot be told from an earlier one, so the largest wins;
    the choice does not depend on row order, and copies of a hot key combine early.
    """
    return responses.groupBy("example_id").agg(
        *[
            F.max(F.when(F.col("stage") == stage, F.col("response"))).alias(f"{stage}_response")
            for stage in STAGES
        ]
    )


def assemble_results(examples: DataFrame, responses: DataFrame) -> DataFrame:
    """Pipeline results from raw responses; every stage needs the one before it.

    ``failed_stage`` names the first stage without a usable answer. A graph needs both a
    node and an edge list that are not empty.
    """
    joined = examples.join(responses_by_example(responses), "example_id", "left")
    kind = pipeline_type(F.col("style"))
    direct = kind == "direct_answer_segmentation"
    cot = F.when(direct, F.col("answer")).otherwise(
        F.when(extract_cot(F.col("cot_response")) != "", extract_cot(F.col("cot_response")))
    )
    parsed = joined.select(
        *examples.columns,
        kind.alias("pipeline_type"),
        cot.alias("cot"),
        extract_segments(F.col("segments_response")).alias("raw_segments"),
        extract_nodes(F.col("graph_response")).alias("raw_nodes"),
        extract_edges(F.col("graph_response")).alias("raw_edges"),
    )
    has_cot = F.col("cot").isNotNull()
    has_segments = F.coalesce(F.size("raw_segments") > 0, F.lit(False))
    has_graph = F.coalesce((F.size("raw_nodes") > 0) & (F.size("raw_edges") > 0), F.lit(False))
    staged = parsed.withColumn(
        "failed_stage",
        F.when(~has_cot, "cot").when(~has_segments, "segments").when(~has_graph, "graph"),
    )
    failed = F.col("failed_stage")
    reached_segments = has_cot & has_segments
    return staged.select(
        *examples.columns,
        "cot",
        F.when(reached_segments, F.col("raw_segments")).alias("segments"),
        F.when(reached_segments, filter_required(F.col("raw_segments"))).alias("required_segments"),
        F.when(failed.isNull(), F.col("raw_nodes")).alias("nodes"),
        F.when(failed.isNull(), F.col("raw_edges")).alias("edges"),
        failed.isNull().alias("success"),
        # A record that stopped before its chain of thought has no pipeline type yet.
        F.when(has_cot, F.col("pipeline_type")).alias("pipeline_type"),
        "failed_stage",
    )
