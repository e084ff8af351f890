"""Queries over question, answer, response and prompt texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotflow.functions import answers, tags, text
from cotflow.operators import datasets, prompts, scoring, segments
from cotflow.plans import inputs, oracle_ctes as o
from cotflow.plans.registry import SQL, query
from cotflow.session import stage_path, write_file
from cotflow.sources import corpora, readers

S_RE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    "final_answer_strict",
    o.sql(o.EXAMPLES, f"SELECT example_id, {o.strict('answer')} final_answer FROM examples"),
)
def final_answer_strict(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    return rows.select(
        "example_id", answers.final_answer_strict(F.col("answer")).alias("final_answer")
    )


@query(
    "final_answer_loose",
    o.sql(o.EXAMPLES, f"SELECT example_id, {o.loose('answer')} final_answer FROM examples"),
)
def final_answer_loose(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    return rows.select(
        "example_id", answers.final_answer_loose(F.col("answer")).alias("final_answer")
    )


@query(
    "normalize_number",
    f"""WITH v AS (
      SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN format('{{:,}}', o_custkey * 1000)
        WHEN 1 THEN '-' || o_custkey || '.500' WHEN 2 THEN o_custkey || 'e3'
        WHEN 3 THEN o_custkey || ' 000.0' WHEN 4 THEN '[invalid]' WHEN 5 THEN o_orderpriority
        WHEN 6 THEN '000' || o_custkey ELSE '-' || (o_custkey % 3) || '.1250' END raw FROM orders
      UNION ALL SELECT -o_orderkey, o_custkey * 2976164 || '.4646845' FROM orders
      UNION ALL SELECT -o_orderkey, '-' || o_custkey * 7 || '.999999' || (o_orderkey % 10) || '5' FROM orders)
    SELECT o_orderkey, raw, {o.normalized("raw")} number FROM v""",
)
def normalize_number(spark, sf_dir):
    orders = corpora.table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey") % 8, F.col("o_custkey")
    raw = (
        F.when(key == 0, F.format_number(customer * 1000, 0))
        .when(key == 1, F.concat(F.lit("-"), customer, F.lit(".500")))
        .when(key == 2, F.concat(customer, F.lit("e3")))
        .when(key == 3, F.concat(customer, F.lit(" 000.0")))
        .when(key == 4, F.lit("[invalid]"))
        .when(key == 5, F.col("o_orderpriority"))
        .when(key == 6, F.concat(F.lit("000"), customer))
        .otherwise(F.concat(F.lit("-"), customer % 3, F.lit(".1250")))
    )
    # Fives at the seventh place, below and above 9e8, and fractions that carry.
    large = F.concat(customer * 2976164, F.lit(".4646845"))
    carried = F.concat(F.lit("-"), customer * 7, F.lit(".999999"), F.col("o_orderkey") % 10, F.lit("5"))
    rows = orders.select("o_orderkey", raw.alias("raw"))
    for more in (large, carried):
        rows = rows.unionByName(orders.select((-F.col("o_orderkey")).alias("o_orderkey"), more.alias("raw")))
    return rows.select(
        "o_orderkey", "raw", answers.normalize_number(F.col("raw")).alias("number")
    )


PREDICTIONS = """,
predictions AS (
  SELECT example_id, coalesce(CASE example_ord % 4 WHEN 0 THEN answer
    WHEN 1 THEN 'I get' || chr(10) || '#### ' || (try_cast(num AS BIGINT) + 1)
    WHEN 2 THEN 'The total is ' || num ELSE '#### ' || num || '.0' || chr(10) END,
    'no idea') generated_text
  FROM (SELECT *, CASE WHEN final_answer IS NOT NULL
          THEN regexp_extract(final_answer, '^-?[0-9]+', 0) END num FROM examples))"""
SCORED = f""",
cut AS (
  SELECT e.example_id, question, {o.strict("answer")} true_answer,
    {o.strict("generated_text")} predicted_answer, generated_text
  FROM examples e JOIN predictions p ON p.example_id = e.example_id),
scored AS (
  SELECT *, predicted_answer <> '[invalid]' AND {o.normalized("predicted_answer")}
    = {o.normalized("true_answer")} correct FROM cut)"""


def _scored(spark, sf_dir):
    examples = inputs.examples(spark, sf_dir)
    predictions = corpora.predictions_from_examples(examples)
    return scoring.score_predictions(predictions, examples)


@query("score_predictions", o.sql(o.EXAMPLES + PREDICTIONS + SCORED, "SELECT * FROM scored"))
def score_predictions(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(
    "accuracy",
    o.sql(
        o.EXAMPLES + PREDICTIONS + SCORED,
        "SELECT count_if(correct) / count(*) accuracy, count_if(correct)::BIGINT correct, "
        "count(*) total FROM scored",
    ),
)
def accuracy(spark, sf_dir):
    return scoring.accuracy(_scored(spark, sf_dir))


@query(
    "extract_cot",
    o.sql(
        o.RESPONSES,
        f"SELECT example_id, {o.tag('response', 'cot')} cot FROM responses WHERE stage = 'cot'",
    ),
)
def extract_cot(spark, sf_dir):
    rows = inputs.responses(spark, sf_dir).where("stage = 'cot'")
    return rows.select("example_id", tags.extract_cot(F.col("response")).alias("cot"))


@query(
    "extract_segments",
    o.sql(
        o.RESPONSES
        + f""",
p AS (SELECT example_id, {o.tag("response", "segments")} body FROM responses
      WHERE stage = 'segments'),
q AS (SELECT example_id, {o.parsed("body", o.SEGMENT_JSON)} s FROM p)""",
        """SELECT example_id, s IS NOT NULL parsed, len(s)::INT segments,
      array_to_string(list_transform(s, lambda x: x.id || '=' || x.is_required || ':' || x.text),
        '|') content FROM q""",
    ),
)
def extract_segments(spark, sf_dir):
    rows = inputs.responses(spark, sf_dir).where("stage = 'segments'")
    found = rows.select("example_id", tags.extract_segments(F.col("response")).alias("s"))
    line = F.transform(
        "s", lambda x: F.concat(x["id"], F.lit("="), x["is_required"], F.lit(":"), x["text"])
    )
    return found.select(
        "example_id",
        F.col("s").isNotNull().alias("parsed"),
        F.when(F.col("s").isNotNull(), F.size("s")).alias("segments"),
        F.array_join(line, "|").alias("content"),
    )


GRAPH_RESPONSES = f""",
p AS (SELECT example_id, {o.tag("response", "nodes")} n, {o.tag("response", "edges")} e
      FROM responses WHERE stage = 'graph'),
q AS (SELECT example_id, {o.parsed("n", o.NODE_JSON)} n, {o.parsed("e", o.EDGE_JSON)} e FROM p)"""


def _graph_responses(spark, sf_dir):
    return inputs.responses(spark, sf_dir).where("stage = 'graph'")


@query(
    "extract_nodes",
    o.sql(
        o.RESPONSES + GRAPH_RESPONSES,
        """SELECT example_id, len(n)::INT nodes, array_to_string(list_transform(n,
      lambda x: x.id || ':' || x.text), '|') content FROM q""",
    ),
)
def extract_nodes(spark, sf_dir):
    rows = _graph_responses(spark, sf_dir)
    found = rows.select("example_id", tags.extract_nodes(F.col("response")).alias("n"))
    line = F.transform("n", lambda x: F.concat(x["id"], F.lit(":"), x["text"]))
    return found.select(
        "example_id",
        F.when(F.col("n").isNotNull(), F.size("n")).alias("nodes"),
        F.array_join(line, "|").alias("content"),
    )


@query(
    "extract_edges",
    o.sql(
        o.RESPONSES + GRAPH_RESPONSES,
        """SELECT example_id, len(e)::INT edges, array_to_string(list_transform(e,
      lambda x: array_to_string(x, '>')), '|') content FROM q""",
    ),
)
def extract_edges(spark, sf_dir):
    rows = _graph_responses(spark, sf_dir)
    found = rows.select("example_id", tags.extract_edges(F.col("response")).alias("e"))
    line = F.transform("e", lambda x: F.array_join(x, ">"))
    return found.select(
        "example_id",
        F.when(F.col("e").isNotNull(), F.size("e")).alias("edges"),
        F.array_join(line, "|").alias("content"),
    )


@query(
    "extract_graph",
    o.sql(
        o.RESPONSES + GRAPH_RESPONSES,
        f"""SELECT example_id, n IS NOT NULL AND e IS NOT NULL whole,
      CASE WHEN n IS NOT NULL AND e IS NOT NULL THEN {o.as_json("n")} END nodes,
      CASE WHEN n IS NOT NULL AND e IS NOT NULL THEN {o.as_json("e")} END edges FROM q""",
    ),
)
def extract_graph(spark, sf_dir):
    rows = _graph_responses(spark, sf_dir)
    found = rows.select("example_id", tags.extract_graph(F.col("response")).alias("g"))
    return found.select(
        "example_id",
        F.col("g").isNotNull().alias("whole"),
        inputs.as_json("nodes", F.col("g.nodes")), inputs.as_json("edges", F.col("g.edges")),
    )


@query(
    "segment_stats",
    o.sql(
        o.DOCUMENT_SEGMENTS,
        """SELECT example_id, len(segments)::INT total_segments,
      len(list_filter(segments, lambda s: s.is_required = 1))::INT required_count,
      len(list_filter(segments, lambda s: s.is_required = 0))::INT optional_count,
      CASE WHEN len(segments) > 0 THEN len(list_filter(segments, lambda s: s.is_required = 1))
        / len(segments) END required_ratio,
      array_to_string(list_transform(list_filter(segments, lambda s: s.is_required = 1),
        lambda s: s.text), '|') required_text,
      CASE WHEN len(segments) = 0 THEN 'No segments provided' END error FROM doc""",
    ),
)
def segment_stats(spark, sf_dir):
    rows = inputs.document_segments(spark, sf_dir)
    found = rows.select("example_id", segments.segment_stats(F.col("segments")).alias("s"))
    return found.select(
        "example_id", "s.total_segments", "s.required_count", "s.optional_count",
        "s.required_ratio", F.array_join("s.required_segments", "|").alias("required_text"),
        "s.error",
    )


def _filter_sql(flag: int) -> str:
    return o.sql(
        o.DOCUMENT_SEGMENTS,
        f"SELECT example_id, id, text FROM doc_rows WHERE is_required = {flag}",
    )


def _filtered(spark, sf_dir, keep):
    rows = inputs.document_segments(spark, sf_dir)
    found = rows.select("example_id", F.explode(keep(F.col("segments"))).alias("s"))
    return found.select("example_id", "s.id", "s.text")


@query("filter_required", _filter_sql(1))
def filter_required(spark, sf_dir):
    return _filtered(spark, sf_dir, segments.filter_required)


@query("filter_optional", _filter_sql(0))
def filter_optional(spark, sf_dir):
    return _filtered(spark, sf_dir, segments.filter_optional)


TURN_PROMPTS = """,
pt AS (SELECT example_id, CASE WHEN length(question) % 3 = 0 THEN question || ' ' || chr(10) || answer
  ELSE question || chr(10) || '---USER---' || chr(10) || answer || '---USER---' || question || ' '
  END prompt FROM turns)"""


def _stripped(value: str) -> str:
    return S_RE.format(value)


@query(
    "split_prompt",
    o.sql(
        o.TURNS + TURN_PROMPTS,
        f"""SELECT example_id, CASE WHEN contains(prompt, '---USER---')
        THEN {_stripped("left(prompt, instr(prompt, '---USER---') - 1)")}
        ELSE 'You are a helpful assistant that follows instructions precisely.' END AS system,
      CASE WHEN contains(prompt, '---USER---')
        THEN {_stripped("substr(prompt, instr(prompt, '---USER---') + 10)")}
        ELSE {_stripped("prompt")} END AS user_text FROM pt""",
    ),
)
def split_prompt(spark, sf_dir):
    rows = inputs.turns(spark, sf_dir)
    marked = F.concat(
        F.col("question"), F.lit("\n---USER---\n"), F.col("answer"), F.lit("---USER---"),
        F.col("question"), F.lit(" "),
    )
    plain = F.concat(F.col("question"), F.lit(" \n"), F.col("answer"))
    prompt = F.when(F.length("question") % 3 == 0, plain).otherwise(marked)
    cut = rows.select("example_id", text.split_prompt(prompt).alias("p"))
    return cut.select("example_id", "p.system", F.col("p.user").alias("user_text"))


# Wording of our own; the layout follows the template rules.
TEMPLATES = {
    "generate_cot": "Reason in <cot> tags.\n---USER---\nQ: {question}\nA: {answer}\nF: {final_answer}\n",
    "segment_cot": 'Cut into [{{"id": "s1"}}].\n---USER---\nQ: {question}\nText: {cot_output_from_prompt_1}',
    "segment_cot_direct": "Cut the answer.\n---USER---\n{answer} {{kept}}",
    "create_graph": "Link.\n---USER---\n{question}\n{segments_from_prompt_2}\n{{}}",
    "create_graph_decontextualized": "Link alone.\n---USER---\n{question}\n{segments_from_prompt_2}\n{{}}",
    "create_graph_direct": "Link answers.\n---USER---\n{question}\n{segments_from_prompt_2}\n{{}}",
}


@query(
    "render_prompt",
    o.sql(
        o.RESULTS,
        """SELECT example_id, 'graph' stage, CASE
        WHEN style IN ('direct', 'reasoning_only_direct') THEN 'Link answers.'
        WHEN style IN ('decontextualized', 'reasoning_only_decontextualized') THEN 'Link alone.'
        ELSE 'Link.' END AS system, question || chr(10)
      || CASE WHEN len(segments) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(
        list_transform(segments, lambda s: '  {' || chr(10) || '    "id": "' || s.id || '",'
          || chr(10) || '    "text": "' || s.text || '",' || chr(10) || '    "is_required": '
          || s.is_required || chr(10) || '  }'), ',' || chr(10)) || chr(10) || ']' END
      || chr(10) || '{}' user_text FROM results""",
    ),
)
def render_prompt(spark, sf_dir):
    rows = inputs.results(spark, sf_dir)
    requests = prompts.render_requests(rows, TEMPLATES, "graph")
    return requests.withColumnRenamed("user", "user_text")


# Written out, so that a wrong mapping in the package shows.
STYLE_SQL = """CASE style WHEN 'consolidated' THEN 'segment_cot_consolidated'
      WHEN 'decontextualized' THEN 'segment_cot_decontextualized' WHEN 'direct' THEN 'segment_cot_direct'
      WHEN 'reasoning_only_decontextualized' THEN 'segment_cot_reasoning_only_decontextualized'
      WHEN 'reasoning_only_direct' THEN 'segment_cot_reasoning_only_direct' ELSE 'segment_cot' END segment_template,
    CASE WHEN style IN ('decontextualized', 'reasoning_only_decontextualized') THEN 'create_graph_decontextualized'
      WHEN style IN ('direct', 'reasoning_only_direct') THEN 'create_graph_direct' ELSE 'create_graph' END graph_template"""


@query(
    "templates_for_style",
    f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN source ELSE
      {o.style("doc_id")} END style FROM documents)
    SELECT doc_id, style, {STYLE_SQL} FROM s""",
)
def templates_for_style(spark, sf_dir):
    key = F.col("doc_id")
    style = F.when(key % 7 == 6, F.col("source")).otherwise(corpora.style_of(key))
    rows = corpora.table(spark, sf_dir, "documents").select("doc_id", style.alias("style"))
    return rows.select(
        "doc_id", "style",
        text.segment_template(F.col("style")).alias("segment_template"),
        text.graph_template(F.col("style")).alias("graph_template"),
    )


@query(
    "attach_templates",
    o.sql(
        o.EXAMPLES,
        f"""SELECT example_id, style, name, CASE name
        WHEN 'segment_cot' THEN 'Cut into [{{{{"id": "s1"}}}}].' || chr(10) || '---USER---' || chr(10)
          || 'Q: {{question}}' || chr(10) || 'Text: {{cot_output_from_prompt_1}}'
        WHEN 'segment_cot_direct' THEN 'Cut the answer.' || chr(10) || '---USER---' || chr(10)
          || '{{answer}} {{{{kept}}}}' END AS template
      FROM (SELECT *, segment_template name FROM (SELECT example_id, style, {STYLE_SQL} FROM examples))""",
    ),
)
def attach_templates(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir).select("example_id", "style")
    stored = spark.createDataFrame(list(TEMPLATES.items()), "name string, template string")
    return prompts.attach_templates(rows, stored, "segments")


# The system text written out, quotes doubled for SQL.
MATH_SQL = (
    "You are a helpful assistant that solves math problems step by step. Always end your answer with "
    "''#### [number]'' where [number] is the final numerical answer."
)


def _prompt_sql(tail: str) -> str:
    return o.sql(
        o.TURNS,
        f"SELECT example_id, '{MATH_SQL}' || chr(10) || "
        f"'Question: ' || question || chr(10) || 'Answer:' || {tail} prompt, "
        f"'Question: ' || question || chr(10) || 'Answer:' || {tail} bare FROM turns",
    )


@query("sft_prompt", _prompt_sql("' ' || answer"))
def sft_prompt(spark, sf_dir):
    q, a = F.col("question"), F.col("answer")
    return inputs.turns(spark, sf_dir).select(
        "example_id", text.sft_prompt(q, a).alias("prompt"), text.sft_prompt(q, a, "").alias("bare")
    )


@query("eval_prompt", _prompt_sql("''"))
def eval_prompt(spark, sf_dir):
    q = F.col("question")
    return inputs.turns(spark, sf_dir).select(
        "example_id", text.eval_prompt(q).alias("prompt"), text.eval_prompt(q, "").alias("bare")
    )


@query(
    "style_from_filename",
    f"""WITH f AS (SELECT doc_id, CASE doc_id % 4
        WHEN 0 THEN lang || '_pipeline_results_' || {o.style("doc_id")} || '_reasoning_paths'
        WHEN 1 THEN lang || '_direct_pipeline_results_x_1700_reasoning_paths'
        WHEN 2 THEN lang || '_pipeline_results_' || {o.style("doc_id")}
        ELSE source || '_reasoning_paths' END stem FROM documents),
      b AS (SELECT *, replace(stem, '_reasoning_paths', '') base FROM f)
    SELECT doc_id, stem, CASE WHEN NOT contains(stem, '_reasoning_paths') THEN 'regular'
      WHEN base LIKE '%\\_reasoning\\_only\\_decontextualized' ESCAPE '\\'
        THEN 'reasoning_only_decontextualized'
      WHEN base LIKE '%\\_reasoning\\_only\\_direct' ESCAPE '\\' THEN 'reasoning_only_direct'
      WHEN ends_with(base, '_decontextualized') THEN 'decontextualized'
      WHEN ends_with(base, '_consolidated') THEN 'consolidated'
      WHEN ends_with(base, '_direct') THEN 'direct'
      WHEN ends_with(base, '_regular') THEN 'regular'
      WHEN contains(base, '_direct_pipeline_results') THEN 'direct' ELSE 'regular' END style
    FROM b""",
)
def style_from_filename(spark, sf_dir):
    key = F.col("doc_id")
    named = F.concat(F.col("lang"), F.lit("_pipeline_results_"), corpora.style_of(key))
    stem = (
        F.when(key % 4 == 0, F.concat(named, F.lit("_reasoning_paths")))
        .when(
            key % 4 == 1,
            F.concat(F.col("lang"), F.lit("_direct_pipeline_results_x_1700_reasoning_paths")),
        )
        .when(key % 4 == 2, named)
        .otherwise(F.concat(F.col("source"), F.lit("_reasoning_paths")))
    )
    rows = corpora.table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"))
    return rows.select("doc_id", "stem", text.style_from_filename(F.col("stem")).alias("style"))


@query(
    "dataset_type_from_path",
    f"""WITH p AS (SELECT doc_id, CASE doc_id % 3
        WHEN 0 THEN 'data/' || lang || '/alternative_cots_' || {o.style("doc_id")}
        WHEN 1 THEN 'data/alternative_cots_' || {o.style("doc_id")} || '/' || source
        ELSE 'data/' || source || '/' || lang END path FROM documents)
    SELECT doc_id, path, CASE
      WHEN starts_with(string_split(path, '/')[-1], 'alternative_cots_') THEN string_split(path, '/')[-1]
      WHEN starts_with(string_split(path, '/')[-2], 'alternative_cots_') THEN string_split(path, '/')[-2]
      ELSE 'alternative_cots_unknown' END AS type FROM p""",
)
def dataset_type_from_path(spark, sf_dir):
    key = F.col("doc_id")
    styled = F.concat(F.lit("alternative_cots_"), corpora.style_of(key))
    path = (
        F.when(key % 3 == 0, F.concat_ws("/", F.lit("data"), "lang", styled))
        .when(key % 3 == 1, F.concat_ws("/", F.lit("data"), styled, "source"))
        .otherwise(F.concat_ws("/", F.lit("data"), "source", "lang"))
    )
    rows = corpora.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", "path", text.dataset_type_from_path(F.col("path")).alias("type"))


@query(
    "strip_calc_markup",
    o.sql(
        o.EXAMPLES,
        "SELECT example_id, regexp_replace(answer, '<<[^>]*>>', '', 'g') clean FROM examples",
    ),
)
def strip_calc_markup(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    return rows.select("example_id", text.strip_calc_markup(F.col("answer")).alias("clean"))


@query(
    "pipeline_type",
    f"""SELECT doc_id, CASE WHEN {o.style("doc_id")} IN ('direct', 'reasoning_only_direct')
      OR doc_id % 5 = 0 THEN 'direct_answer_segmentation' ELSE 'normal_with_cot_generation' END
      pipeline_type FROM documents""",
)
def pipeline_type(spark, sf_dir):
    key = F.col("doc_id")
    mode = F.when(key % 5 == 0, "direct").otherwise("normal")
    kind = text.pipeline_type(corpora.style_of(key), mode)
    return corpora.table(spark, sf_dir, "documents").select("doc_id", kind.alias("pipeline_type"))


@query(
    "segment_direct",
    o.sql(
        o.RESULTS,
        "SELECT example_id, s.id, s.text, s.is_required FROM "
        "(SELECT example_id, unnest(segments) s FROM results)",
    ),
)
def segment_direct(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    found = rows.select("example_id", F.inline(segments.segment_direct(F.col("answer"))))
    return found


RULE_SQL = {
    "sequential_ids": "SELECT example_id, place || ':' || id detail FROM doc_rows WHERE id <> 's' || place",
    "segment_count": """SELECT example_id, len(segments)::VARCHAR detail FROM doc WHERE
      (style IN ('regular', 'decontextualized', 'direct') AND len(segments) > 15)
      OR (style IN ('reasoning_only_decontextualized', 'reasoning_only_direct') AND len(segments) > 12)
      OR (style = 'consolidated' AND NOT len(segments) BETWEEN 5 AND 8)""",
    "exact_excerpt": "SELECT example_id, id detail FROM doc_rows WHERE instr(cot, text) = 0",
    "non_overlap": """SELECT example_id, unnest(found.late) detail FROM (SELECT example_id, list_reduce(
      segments, lambda seen, s: {
        'cot': seen.cot,
        'reach': CASE WHEN s.text <> '' AND instr(substr(seen.cot, seen.reach), s.text) > 0
          THEN seen.reach + instr(substr(seen.cot, seen.reach), s.text) - 1 + length(s.text) ELSE seen.reach END,
        'late': CASE WHEN s.text <> '' AND instr(substr(seen.cot, seen.reach), s.text) = 0 AND instr(seen.cot, s.text) > 0
          THEN list_append(seen.late, s.id) ELSE seen.late END},
      {'cot': cot, 'reach': 1::BIGINT, 'late': []::VARCHAR[]}) found FROM doc)""",
    "decontextualized": r"""SELECT example_id, id detail FROM doc_rows WHERE regexp_matches(text,
      '(?i)^\s*(so|then|therefore|thus|next)\b|\b(it|this|that|these|them)\b')""",
    "graph_covers_required": """SELECT example_id, 'missing: ' || text detail FROM (
        SELECT example_id, text FROM required EXCEPT SELECT example_id, text FROM node_texts)
      UNION ALL SELECT example_id, 'extra: ' || text FROM (
        SELECT example_id, text FROM node_texts EXCEPT SELECT example_id, text FROM required)""",
}
RULE_CTES = (
    o.DOCUMENT_SEGMENTS
    + """,
required AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) - 1 i FROM doc_rows
  WHERE is_required = 1),
node_texts AS (SELECT example_id, text FROM required WHERE (k + i) % 10 <> 0
  UNION ALL SELECT example_id, 'extra step' FROM doc WHERE k % 9 = 0)"""
)


def _register_rule(rule: str) -> None:
    @query(
        f"check_{rule}",
        o.sql(RULE_CTES, f"SELECT example_id, '{rule}' AS rule, detail FROM ({RULE_SQL[rule]})"),
    )
    def check(spark, sf_dir):
        return segments.check_contracts(inputs.document_segments(spark, sf_dir), (rule,))


for _rule in segments.RULES:
    _register_rule(_rule)


@query(
    "check_contracts",
    o.sql(
        RULE_CTES,
        " UNION ALL ".join(
            f"SELECT example_id, '{r}' AS rule, detail FROM ({s})" for r, s in RULE_SQL.items()
        ),
    ),
)
def check_contracts(spark, sf_dir):
    return segments.check_contracts(inputs.document_segments(spark, sf_dir))


@query(
    "filter_examples",
    o.sql(
        o.TURNS,
        "SELECT example_id, question FROM turns WHERE contains(lower(example_id), 'train_1')",
    ),
)
def filter_examples(spark, sf_dir):
    rows = inputs.turns(spark, sf_dir)
    return datasets.filter_examples(rows, "TRAIN_1").select("example_id", "question")


@query(
    "id_suffix",
    o.sql(
        o.TURNS,
        "SELECT example_id, string_split(example_id, '_')[-1] id FROM turns",
    ),
)
def id_suffix(spark, sf_dir):
    rows = inputs.turns(spark, sf_dir)
    return rows.select("example_id", text.id_suffix(F.col("example_id")).alias("id"))


@query(
    "attach_responses",
    o.sql(
        o.RESPONSES
        + """,
requests AS (SELECT example_id, unnest(['cot', 'segments', 'graph']) stage FROM results)""",
        """SELECT q.example_id, q.stage, r.response IS NOT NULL answered, md5(r.response) digest
    FROM requests q LEFT JOIN responses r ON r.example_id = q.example_id AND r.stage = q.stage""",
    ),
)
def attach_responses(spark, sf_dir):
    rows = inputs.results(spark, sf_dir)
    stages = F.explode(F.array(*[F.lit(s) for s in prompts.STAGES]))
    requests = rows.select("example_id", stages.alias("stage"))
    joined = prompts.attach_responses(requests, corpora.responses_from_results(rows))
    return joined.select(
        "example_id", "stage",
        F.col("response").isNotNull().alias("answered"), F.md5("response").alias("digest"),
    )


ASSEMBLED = (
    o.RESPONSES
    + f""",
side AS (
  SELECT e.*, max(CASE WHEN stage = 'cot' THEN response END) cr,
    max(CASE WHEN stage = 'segments' THEN response END) sr,
    max(CASE WHEN stage = 'graph' THEN response END) gr
  FROM examples e LEFT JOIN responses r ON r.example_id = e.example_id GROUP BY ALL),
bodies2 AS (
  SELECT *, style IN ('direct', 'reasoning_only_direct') direct, {o.tag("cr", "cot")} cot_body,
    {o.tag("sr", "segments")} sb, {o.tag("gr", "nodes")} nb, {o.tag("gr", "edges")} eb FROM side),
lists AS (
  SELECT *, CASE WHEN direct THEN answer ELSE nullif(cot_body, '') END cot,
    {o.parsed("sb", o.SEGMENT_JSON)} s, {o.parsed("nb", o.NODE_JSON)} n,
    {o.parsed("eb", o.EDGE_JSON)} e FROM bodies2),
staged AS (
  SELECT *, CASE WHEN cot IS NULL THEN 'cot' WHEN coalesce(len(s), 0) = 0 THEN 'segments'
    WHEN coalesce(len(n), 0) = 0 OR coalesce(len(e), 0) = 0 THEN 'graph' END failed_stage FROM lists)"""
)


ASSEMBLED_SELECT = f"""SELECT example_id, cot, CASE WHEN coalesce(failed_stage, 'graph') = 'graph' THEN {o.as_json("s")} END segments,
  CASE WHEN coalesce(failed_stage, 'graph') = 'graph' THEN {o.as_json("list_filter(s, lambda x: x.is_required = 1)")} END required_segments,
  CASE WHEN failed_stage IS NULL THEN {o.as_json("n")} END nodes, CASE WHEN failed_stage IS NULL THEN {o.as_json("e")} END edges,
  failed_stage IS NULL success, CASE WHEN cot IS NULL THEN NULL WHEN direct
    THEN 'direct_answer_segmentation' ELSE 'normal_with_cot_generation' END pipeline_type, failed_stage FROM staged"""


def assembled_rows(found):
    lists = [inputs.as_json(c) for c in ("segments", "required_segments", "nodes", "edges")]
    return found.select("example_id", "cot", *lists, "success", "pipeline_type", "failed_stage")


@query("assemble_results", o.sql(ASSEMBLED, ASSEMBLED_SELECT))
def assemble_results(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    answers_ = corpora.responses_from_results(corpora.results_from_examples(rows))
    return assembled_rows(prompts.assemble_results(rows, answers_))


@query(
    "generate_with",
    o.sql(
        o.RESULTS,
        """SELECT example_id, 'cot' stage, 'Q: ' || question || chr(10) || 'A: ' || answer
      || chr(10) || 'F: ' || coalesce(final_answer, 'None') cot FROM results""",
    ),
)
def generate_with(spark, sf_dir):
    rows = inputs.results(spark, sf_dir).drop("segments", "nodes", "edges")
    requests = prompts.render_requests(rows, TEMPLATES, "cot")

    def echo(batch):
        return "<cot> " + batch["user"] + "\n</cot>"

    replies = prompts.generate_with(requests, echo)
    return replies.select("example_id", "stage", tags.extract_cot(F.col("response")).alias("cot"))


@query(
    "generate_stored",
    o.sql(
        o.RESULTS,
        """SELECT example_id, 'cot' stage, CASE WHEN example_ord % 3 = 0 THEN 'first ' ELSE 'second ' END
      || 'Q: ' || question || chr(10) || 'A: ' || answer || chr(10) || 'F: ' || coalesce(final_answer, 'None') response FROM results""",
    ),
)
def generate_stored(spark, sf_dir):
    """A third of the requests is answered in a first run. The second run asks for the others alone,
    by a function that fails every first time."""
    rows = inputs.results(spark, sf_dir).drop("segments", "nodes", "edges")
    requests = prompts.render_requests(rows, TEMPLATES, "cot")
    path = stage_path(spark, "responses")
    third = F.substring_index("example_id", "_", -1).cast("bigint") % 3 == 0
    prompts.generate_stored(requests.where(third), lambda batch: "first " + batch["user"], path, 1)
    asked = set()

    def second(batch):
        key = batch["example_id"].iloc[0]
        if key not in asked:
            asked.add(key)
            raise ConnectionError("try again")
        return "second " + batch["user"]

    return prompts.generate_stored(requests, second, path, 2, backoff=0.0, in_flight=1000)


@query("read_prompt_templates", SQL["render_prompt"])
def read_prompt_templates(spark, sf_dir):
    """Requests by templates that are read from files inside the job."""
    folder = stage_path(spark, "templates")
    for name, template in TEMPLATES.items():
        write_file(spark, f"{folder}/{name}.txt", template.encode())
    found = readers.read_prompt_templates(spark, folder, list(TEMPLATES))
    rows = inputs.results(spark, sf_dir)
    requests = prompts.render_requests(rows, readers.template_dict(found, list(TEMPLATES)), "graph")
    return requests.withColumnRenamed("user", "user_text")
