"""Question/answer, graph, response and tool-call corpora derived from the sales, document,
conversation and event tables, one record per source row.

Each derivation is a projection of its row (conversations: one equi-join), so a corpus
grows with its table and splits like it. Row keys decide which records carry faults:
broken tags, cut JSON, cycles, unknown nodes, missing answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotflow import schemas
from cotflow.functions.answers import final_answer_loose
from cotflow.functions.lambdas import empty, let, upto
from cotflow.functions.text import STYLE_TEMPLATES, pipeline_type, strip_calc_markup
from cotflow.operators.graphs import bit, value_dependency_edges
from cotflow.operators.segments import filter_required, renumbered_nodes, segment_direct

STYLES = tuple(STYLE_TEMPLATES)
MAX_STEPS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def style_of(key: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STYLES]), (key % len(STYLES)).cast("int"))


def _text(value: Column) -> Column:
    return value.cast("string")


def examples_from_orders(orders: DataFrame) -> DataFrame:
    """One worked example per order: one to seven additions, some using earlier results."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    steps = (key % MAX_STEPS + 1).cast("int")
    base = customer % 997 + 11

    def value(k: Column) -> Column:
        return base * bit(k) + k

    def step(k: Column) -> Column:
        """A sum of up to two earlier results, or of a small number, and what is left to its value."""

        def earlier(at: Column, ok: Column) -> Column:
            return F.when(ok, value(at))

        def line(row: Column) -> Column:
            first, second, made = row["first"], row["second"], row["made"]
            small = F.when(first.isNull() & second.isNull(), (k + 2).cast("bigint"))
            left = made
            for part in (first, second, small):
                left = left - F.coalesce(part, F.lit(0))
            parts = [_text(x) for x in (first, second, small, left)]
            return F.concat(
                F.when((key + k) % 6 == 0, "So ").when((key + k) % 11 == 0, "This gives ").otherwise(""),
                F.lit("step "), _text(k), F.lit(": "), F.concat_ws(" + ", *parts), F.lit(" = <<"),
                F.concat_ws("+", *parts), F.lit("="), _text(made), F.lit(">>"),
                F.format_number(made, 0), F.lit(" units"),
            )

        one = ((customer + (key % 13) * k) % k).cast("int")
        two = ((F.call_function("div", key, F.lit(7)) + k * 3) % (k + 2)).cast("int")
        return let(
            F.struct(
                earlier(one, one > 0).alias("first"),
                earlier(two, (two > 0) & (two < k) & (two != one)).alias("second"),
                value(k).alias("made"),
            ),
            line,
        )

    total = value(steps)
    marked = F.concat(F.lit("#### "), _text(total))
    ending = (
        F.when(key % 9 == 0, F.concat(F.lit("#### "), F.format_number(total, 0)))
        .when(key % 9 == 1, F.concat(F.lit("#### -"), _text(total)))
        .when(key % 9 == 2, F.concat(F.lit("####"), _text(total)))
        .when(key % 9 == 3, F.concat(marked, F.lit(".50")))
        .when(key % 9 == 4, F.concat(marked, F.lit("abc")))
        .when(key % 9 == 6, F.concat(marked, F.lit("  \nDone.")))
        .when(key % 9 == 7, F.concat(marked, F.lit(".")))
        .when(key % 9 == 8, marked)
    )
    opening = F.when(key % 5 == 0, F.concat(F.lit("We count the units of order "), _text(key), F.lit(".")))
    body = F.array_join(F.transform(upto(steps), step), "\n")
    rows = orders.select(
        key.alias("example_ord"),
        F.concat(F.lit("orders_train_"), _text(key)).alias("example_id"),
        F.concat(
            F.lit("How many units does customer "), _text(customer), F.lit(" get after "),
            _text(steps), F.lit(" steps ("), F.col("o_orderpriority"), F.lit(")?"),
        ).alias("question"),
        F.concat_ws("\n", opening, body, ending).alias("answer"),
        style_of(key).alias("style"),
    )
    return rows.withColumn("final_answer", final_answer_loose(F.col("answer")))


def predictions_from_examples(examples: DataFrame) -> DataFrame:
    """Generated answers: right, off by one, without a marker, or with a decimal zero."""
    key = F.col("example_ord")
    number = F.regexp_extract("final_answer", r"^-?[0-9]+", 0)
    text = (
        F.when(key % 4 == 0, F.col("answer"))
        .when(key % 4 == 1, F.concat(F.lit("I get\n#### "), _text(number.try_cast("bigint") + 1)))
        .when(key % 4 == 2, F.concat(F.lit("The total is "), number))
        .otherwise(F.concat(F.lit("#### "), number, F.lit(".0\n")))
    )
    return examples.select("example_id", F.coalesce(text, F.lit("no idea")).alias("generated_text"))


def results_from_examples(examples: DataFrame) -> DataFrame:
    """Pipeline results with a graph per example; some graphs carry faults."""
    key = F.col("example_ord")
    drafted = (
        examples.withColumn("segments", segment_direct(F.col("answer")))
        .withColumn("clean_nodes", renumbered_nodes(F.col("segments")))
        .withColumn("clean_edges", value_dependency_edges(F.col("clean_nodes")))
    )
    nodes, edges = F.col("clean_nodes"), F.col("clean_edges")
    last = F.concat(F.lit("s"), _text(F.size(nodes)))
    again = F.array(F.struct(F.lit("s1").alias("id"), F.lit("again").alias("text")))

    def plus(*edge: Column) -> Column:
        return F.concat(edges, F.array(F.array(*edge)))

    fault = key % 23
    return drafted.select(
        "example_ord", "example_id", "question", "answer", "final_answer", "style",
        strip_calc_markup(F.col("answer")).alias("cot"),
        "segments",
        filter_required(F.col("segments")).alias("required_segments"),
        F.when(fault == 5, F.concat(nodes, again))
        .when(fault == 7, empty(schemas.NODES))
        .otherwise(nodes)
        .alias("nodes"),
        F.when(fault == 1, plus(last, F.lit("s1")))
        .when(fault == 2, plus(F.lit("s1"), F.lit("s99")))
        .when(fault == 3, plus(F.lit("s1")))
        .when(fault == 4, plus(F.lit("s1"), F.lit("s1")))
        .when(fault == 8, F.concat(edges, edges))
        .otherwise(edges)
        .alias("edges"),
        (key % 31 != 3).alias("success"),
        pipeline_type(F.col("style")).alias("pipeline_type"),
    )


def single_quoted(listed: Column) -> Column:
    return F.replace(listed, F.lit('"'), F.lit("'"))


def trailing_comma(listed: Column) -> Column:
    return F.concat(F.substring(listed, F.lit(1), F.length(listed) - 1), F.lit(",]"))


def line_graphs_from_documents(documents: DataFrame) -> DataFrame:
    """Results whose steps are all lines of a document, however many.

    In two of three documents line i waits for line i / 2; every third line waits for the one before
    it; in some the first waits for the last, which closes a cycle.
    """
    key = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    count = F.size("lines")

    def name(i: Column) -> Column:
        return F.concat(F.lit("s"), _text(i))

    later = F.filter(upto(count), lambda i: i > 1)
    half = F.transform(later, lambda i: F.array(name(F.call_function("div", i, F.lit(2))), name(i)))
    before = F.transform(F.filter(later, lambda i: (key + i) % 3 == 0), lambda i: F.array(name(i - 1), name(i)))
    back = F.when((key % 23 == 1) & (count > 1), F.array(F.array(name(count), F.lit("s1")))).otherwise(empty(schemas.EDGES))
    drafted = documents.select("doc_id", lines.alias("lines"))
    return drafted.select(
        key.alias("example_ord"),
        F.concat(F.lit("documents_train_"), _text(key)).alias("example_id"),
        F.transform("lines", lambda x, i: F.struct(name(i + 1).alias("id"), x.alias("text"))).alias("nodes"),
        F.concat(F.when(key % 3 != 0, half).otherwise(empty(schemas.EDGES)), before, back).alias("edges"),
        F.lit(True).alias("success"),
    )


def responses_from_results(results: DataFrame) -> DataFrame:
    """Model responses that carry the results as tagged text, some of them damaged."""
    key = F.col("example_ord")

    def block(tag: str, body: Column, closed: Column | None = None) -> Column:
        close = F.lit(f"\n</{tag}>")
        if closed is not None:
            close = F.when(closed, close).otherwise(F.lit(""))
        return F.concat(F.lit(f"<{tag}>\n"), body, close)

    cot = F.concat(
        F.lit("Here it is:\n"),
        block("cot", F.when(key % 17 == 2, "").otherwise(F.col("cot")), key % 17 != 1),
    )
    listed = F.to_json("segments")
    flags = F.replace(F.replace(listed, F.lit('"is_required":1'), F.lit('"is_required":true')), F.lit('"is_required":0'), F.lit('"is_required":false'))
    segments = (
        F.when(key % 19 == 2, listed)
        .when(key % 19 == 1, block("segments", F.substring(listed, F.lit(1), F.length(listed) - 1)))
        .when(key % 19 == 3, block("segments", F.lit("[]")))
        .when(key % 19 == 4, block("segments", F.concat(listed, F.lit(" and so on"))))
        .when(key % 19 == 5, block("segments", flags))
        .when(key % 19 == 6, block("segments", single_quoted(listed)))
        .when(key % 19 == 7, block("segments", F.concat(F.lit('{"list":'), listed, F.lit("}"))))
        .when(key % 19 == 8, block("segments", trailing_comma(listed)))
        .otherwise(block("segments", listed))
    )
    nodes = F.to_json("nodes")
    written = (
        F.when(key % 37 == 5, single_quoted(nodes))
        .when(key % 37 == 6, F.concat(F.lit('{"n":'), nodes, F.lit("}")))
        .when(key % 37 == 7, trailing_comma(nodes))
        .otherwise(nodes)
    )
    graph = F.concat(
        block("nodes", written), F.lit("\n\n"),
        block("edges", F.to_json("edges"), key % 23 != 6),
    )
    direct = F.col("pipeline_type") == "direct_answer_segmentation"
    stages = F.array(
        F.when(~direct, F.struct(F.lit("cot").alias("stage"), cot.alias("response"))),
        F.struct(F.lit("segments").alias("stage"), segments.alias("response")),
        F.when(key % 29 != 5, F.struct(F.lit("graph").alias("stage"), graph.alias("response"))),
    )
    return results.select(
        "example_id", F.inline(F.filter(stages, lambda s: s.isNotNull()))
    )


def segments_from_documents(documents: DataFrame) -> DataFrame:
    """Whole documents as chains of thought, one segment per non-empty line.

    Some segments get a text of their own that stands nowhere, some the second half of the line
    before, which overlaps that line's segment.
    """
    key = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    shift = F.when(key % 7 == 0, 1).otherwise(0)

    def half(x: Column) -> Column:
        return F.substring(x, F.floor(F.length(x) / 2).cast("int") + 1, F.length(x))

    segments = F.transform(
        lines,
        lambda x, i: F.struct(
            F.concat(F.lit("s"), _text(i + 1 + shift)).alias("id"),
            F.when((key + i) % 13 == 0, F.concat(x, F.lit("!")))
            .when(((key + i) % 17 == 5) & (i > 0), half(F.get(lines, i - 1)))
            .otherwise(x).alias("text"),
            F.when(F.length(x) % 3 == 2, F.lit(None)).otherwise(F.length(x) % 3).cast("int").alias("is_required"),
        ),
    )
    drafted = documents.select(
        key.alias("example_ord"),
        F.concat(F.lit("documents_train_"), _text(key)).alias("example_id"),
        style_of(key).alias("style"),
        F.col("text").alias("cot"),
        segments.alias("segments"),
    )
    key = F.col("example_ord")
    kept = F.filter(
        F.transform(
            filter_required(F.col("segments")),
            lambda s, i: F.when(
                (key + i) % 10 != 0, F.struct(s["id"].alias("id"), s["text"].alias("text"))
            ),
        ),
        lambda s: s.isNotNull(),
    )
    extra = F.array(F.struct(F.lit("x").alias("id"), F.lit("extra step").alias("text")))
    return drafted.withColumn(
        "nodes", F.when(key % 9 == 0, F.concat(kept, extra)).otherwise(kept)
    )


def examples_from_conversations(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it.

    An equi-join on (conversation, turn): a conversation of any length spreads over all
    partitions, which a window over the conversation would not.
    """
    asked = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    told = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "turn"]).select(
        F.concat_ws("_", F.lit("conversations_train"), "conv_id", "turn").alias("example_id"),
        "question",
        "answer",
        final_answer_loose(F.col("answer")).alias("final_answer"),
    )


def multihop_from_documents(documents: DataFrame) -> DataFrame:
    """Raw multi-hop records: paragraphs are lines, facts point at some of their sentences."""
    key = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    context = F.transform(
        lines,
        lambda x, i: F.array(
            F.concat(F.lit("T"), _text(i % 5)), F.to_json(F.split(x, r"\. "))
        ),
    )
    facts = F.transform(
        F.sequence(F.lit(1), F.lit(4)),
        lambda k: F.array(
            F.concat(F.lit("T"), _text((key + k) % 6)), _text(key * k % 4 - 1)
        ),
    )
    return documents.select(
        F.concat(F.lit("d"), _text(key)).alias("_id"),
        F.get(lines, F.lit(0)).alias("question"),
        F.when(key % 5 != 0, F.col("lang")).alias("answer"),
        F.when(key % 4 != 0, F.lit("bridge")).alias("type"),
        F.col("source").alias("level"),
        F.when(key % 8 != 0, facts).alias("supporting_facts"),
        context.alias("context"),
    )


def tool_rows_from_events(events: DataFrame) -> DataFrame:
    """Tool-call records around the event properties; some lists are empty or broken."""
    key, props = F.col("event_id"), F.col("props")
    tools = F.concat(
        F.lit('[{"name":"'), F.col("event_type"), F.lit('","description":"user '),
        _text(F.col("user_id")), F.lit('"},{"parameters":'), props, F.lit("}]"),
    )
    calls = F.concat(
        F.lit('[{"name":"'), F.col("event_type"), F.lit('","arguments":'), props,
        F.lit('},{"name":"log"}]'),
    )
    return events.select(
        key.alias("id"),
        F.concat(F.lit("What did user "), _text(F.col("user_id")), F.lit(" do?")).alias("query"),
        F.when(key % 11 == 0, F.substring(tools, F.lit(1), F.length(tools) - 1))
        .when(key % 13 == 0, F.lit(""))
        .when(key % 29 == 1, single_quoted(tools))
        .when(key % 29 == 2, F.concat(F.lit('{"tools":'), tools, F.lit("}")))
        .when(key % 29 == 3, trailing_comma(tools))
        .otherwise(tools)
        .alias("tools"),
        F.when(key % 17 == 0, F.concat(calls, F.lit(" done")))
        .when(key % 19 == 0, F.lit(""))
        .when(key % 31 == 4, trailing_comma(calls))
        .when(key % 31 == 5, F.lit("true"))
        .otherwise(calls)
        .alias("answers"),
    )


def sft_ids_from_documents(documents: DataFrame) -> DataFrame:
    """Ids per dataset file: one original and two variants that lack or add some ids."""
    key = F.col("doc_id")
    files = F.array(
        F.when(key % 97 != 1, F.lit("original.jsonl")),
        F.when(key % 89 != 2, F.lit("alternative_cots_direct.jsonl")),
        F.when(key % 83 != 3, F.lit("alternative_cots_regular.jsonl")),
    )
    return documents.select(
        F.explode(F.filter(files, lambda f: f.isNotNull())).alias("file"),
        F.when(key % 101 != 7, _text(key)).alias("id"),
    )
