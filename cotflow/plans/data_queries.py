"""Queries over samples, splits, id sets, multi-hop and tool records, readers and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from cotflow.functions.text import pipeline_type
from cotflow.operators import consistency, cots, datasets, multihop, orderings, prompts, sampling, tools
from cotflow.operators.reconciliation import reconcile_ids
from cotflow.plans import graph_queries, inputs, jobs, oracle_ctes as o, text_queries
from cotflow.plans.registry import SQL, query
from cotflow.session import drop_stage, stage_path, stored
from cotflow.sources import corpora, readers, writers
from cotflow.sources.published import read_published
from cotflow.streaming.responses import ingest_responses_stream, ingest_results_stream, read_results_stream


@query(
    "sample_n",
    o.sql(
        o.EXAMPLES,
        "SELECT example_id, question FROM examples ORDER BY md5('42|' || example_id), example_id "
        "LIMIT 100",
    ),
)
def sample_n(spark, sf_dir):
    return sampling.sample_n(inputs.examples(spark, sf_dir), 100, 42).select(
        "example_id", "question"
    )


@query(
    "head_n",
    o.sql(o.EXAMPLES, "SELECT example_id, question FROM examples ORDER BY example_ord LIMIT 100"),
)
def head_n(spark, sf_dir):
    return sampling.head_n(inputs.examples(spark, sf_dir), 100).select("example_id", "question")


@query(
    "train_val_split",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) rn,
      count(*) OVER () n FROM documents)
    SELECT doc_id, CASE WHEN rn <= ceil(0.1 * n) THEN 'validation' ELSE 'train' END part FROM r""",
)
def train_val_split(spark, sf_dir):
    rows = corpora.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.train_val_split(rows, 0.1, 42, "doc_id")


@query(
    "train_val_split_grouped",
    """SELECT l_orderkey, l_linenumber, CASE WHEN ('0x' || substr(md5('42|' || l_orderkey), 1, 8))::BIGINT
      < 429496729 THEN 'validation' ELSE 'train' END part FROM lineitem""",
)
def train_val_split_grouped(spark, sf_dir):
    rows = corpora.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.train_val_split(rows, 0.1, 42, group_col="l_orderkey")


@query(
    "export_training",
    o.sql(
        o.EXAMPLES
        + """,
r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || example_ord)) rn, count(*) OVER () n
  FROM examples)""",
        f"""SELECT example_ord::VARCHAR id, CASE WHEN rn <= ceil(0.1 * n) THEN 'validation'
      ELSE 'train' END part, '{text_queries.MATH_SQL}' || chr(10) || 'Question: '
      || question || chr(10) || 'Answer: ' || answer prompt FROM r""",
    ),
)
def export_training(spark, sf_dir):
    return jobs.export_training(datasets.to_sft_original(inputs.examples(spark, sf_dir)))


@query(
    "ids_per_file",
    o.sql(
        o.SFT_IDS,
        """SELECT file, count(DISTINCT id) distinct_ids, count_if(id IS NULL)::BIGINT missing_id_rows,
      0::BIGINT bad_lines FROM sft_ids GROUP BY file""",
    ),
)
def ids_per_file(spark, sf_dir):
    return consistency.ids_per_file(inputs.sft_ids(spark, sf_dir))


DIFFERENCES = """,
ids AS (SELECT DISTINCT file, id FROM sft_ids WHERE id IS NOT NULL),
others AS (SELECT DISTINCT file FROM ids WHERE file <> 'original.jsonl'),
differences AS (
  SELECT f.file, 'missing' side, i.id FROM others f, ids i WHERE i.file = 'original.jsonl'
    AND NOT EXISTS (SELECT 1 FROM ids x WHERE x.file = f.file AND x.id = i.id)
  UNION ALL
  SELECT i.file, 'extra', i.id FROM ids i WHERE i.file <> 'original.jsonl'
    AND NOT EXISTS (SELECT 1 FROM ids x WHERE x.file = 'original.jsonl' AND x.id = i.id))"""


def _differences(spark, sf_dir):
    rows = inputs.sft_ids(spark, sf_dir)
    return consistency.id_differences(rows, reference_file="original.jsonl")


@query("id_differences", o.sql(o.SFT_IDS + DIFFERENCES, "SELECT * FROM differences"))
def id_differences(spark, sf_dir):
    return _differences(spark, sf_dir)


@query(
    "sorted_differences",
    o.sql(
        o.SFT_IDS + DIFFERENCES, "SELECT * FROM differences ORDER BY file, side DESC, id"
    ),
)
def sorted_differences(spark, sf_dir):
    return consistency.sorted_differences(_differences(spark, sf_dir))


@query(
    "ids_consistent",
    o.sql(
        o.SFT_IDS + DIFFERENCES,
        """SELECT count(*) = 0 consistent, count_if(side = 'missing')::BIGINT missing_ids,
      count_if(side = 'extra')::BIGINT extra_ids FROM differences""",
    ),
)
def ids_consistent(spark, sf_dir):
    rows = inputs.sft_ids(spark, sf_dir)
    return consistency.ids_consistent(reconcile_ids(rows, reference_file="original.jsonl"))


@query("reconcile_ids", SQL["id_differences"])
def reconciled_differences(spark, sf_dir):
    return reconcile_ids(inputs.sft_ids(spark, sf_dir), reference_file="original.jsonl")


@query("all_ids", o.sql(o.SFT_IDS, "SELECT DISTINCT id FROM sft_ids WHERE id IS NOT NULL"))
def all_ids(spark, sf_dir):
    return consistency.all_ids(inputs.sft_ids(spark, sf_dir))


def _multihop(spark, sf_dir):
    return multihop.multihop_from_raw(inputs.multihop_raw(spark, sf_dir))


MULTIHOP_SELECT = """SELECT id, question, answer, type, level, len(facts)::INT facts,
      array_to_string(list_transform(facts, lambda f: f.title || '#' || f.sent_id), '|') fact_list,
      len(context)::INT paragraphs, array_to_string(list_transform(context, lambda c: c.title || ':'
        || array_to_string(c.sentences, '~')), '|') context_text FROM mh"""


def _multihop_rows(df):
    fact = F.transform(
        "supporting_facts", lambda f: F.concat(f["title"], F.lit("#"), f["sent_id"])
    )
    paragraph = F.transform(
        "context", lambda c: F.concat(c["title"], F.lit(":"), F.array_join(c["sentences"], "~"))
    )
    return df.select(
        "id", "question", "answer", "type", "level",
        F.size("supporting_facts").alias("facts"),
        F.array_join(fact, "|").alias("fact_list"),
        F.size("context").alias("paragraphs"),
        F.array_join(paragraph, "|").alias("context_text"),
    )


@query("read_multihop_json", o.sql(o.MULTIHOP, MULTIHOP_SELECT))
def read_multihop_json(spark, sf_dir):
    """Writes the raw records as JSON array files and reads them back."""
    raw = inputs.multihop_raw(spark, sf_dir)
    # Pairs are [title, [sentences]] in the files, so the inner list is put in as JSON.
    pairs = F.transform(
        "context",
        lambda c: F.parse_json(
            F.concat(F.lit("["), _quoted(F.get(c, F.lit(0))), F.lit(","), F.get(c, F.lit(1)), F.lit("]"))
        ),
    )
    path = stage_path(spark, "multihop")
    writers.write_samples(raw.withColumn("context", pairs), path, "json")
    return _multihop_rows(readers.read_multihop_json(spark, path))


def _quoted(value):
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


@query("multihop_from_columnar", o.sql(o.MULTIHOP, MULTIHOP_SELECT))
def multihop_from_columnar(spark, sf_dir):
    rows = _multihop(spark, sf_dir)
    columnar = rows.withColumns(
        {
            "supporting_facts": F.struct(
                F.col("supporting_facts.title").alias("title"),
                F.col("supporting_facts.sent_id").alias("sent_id"),
            ),
            "context": F.struct(
                F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")
            ),
        }
    )
    return _multihop_rows(multihop.multihop_from_columnar(columnar))


@query(
    "multihop_text",
    o.sql(o.MULTIHOP, "SELECT id, question problem_text, answer answer_text FROM mh"),
)
def multihop_text(spark, sf_dir):
    return multihop.multihop_text(_multihop(spark, sf_dir))


@query(
    "supporting_context",
    o.sql(
        o.MULTIHOP
        + """,
paragraphs AS (SELECT id, unnest(context, recursive := true), generate_subscripts(context, 1) place
  FROM mh),
latest AS (SELECT id, title, max_by(sentences, place) sentences FROM paragraphs GROUP BY ALL),
fact_rows AS (SELECT id, unnest(facts, recursive := true), generate_subscripts(facts, 1) place FROM mh),
found AS (
  SELECT f.id, f.place, f.title, f.sent_id, sentences[CASE WHEN f.sent_id < 0
    THEN f.sent_id + len(sentences) + 1 ELSE f.sent_id + 1 END] sentence
  FROM fact_rows f JOIN latest l ON l.id = f.id AND l.title = f.title)""",
        """SELECT id, row_number() OVER (PARTITION BY id ORDER BY place)::INT fact_no, title, sent_id,
      sentence FROM found WHERE sentence IS NOT NULL""",
    ),
)
def supporting_context(spark, sf_dir):
    return multihop.supporting_context(_multihop(spark, sf_dir))


@query(
    "profile_multihop",
    o.sql(
        o.MULTIHOP
        + """,
paragraphs AS (SELECT id, type, level, len(facts)::INT facts, len(context)::INT n,
  unnest(context, recursive := true), generate_subscripts(context, 1)::INT paragraph_no FROM mh)""",
        """SELECT id, type, level, facts, n paragraphs, paragraph_no, title,
      len(sentences)::INT sentences, CASE WHEN length(sentences[1]) > 100
        THEN left(sentences[1], 100) || '...' ELSE sentences[1] END preview FROM paragraphs""",
    ),
)
def profile_multihop(spark, sf_dir):
    return multihop.profile_multihop(_multihop(spark, sf_dir))


@query(
    "parse_tool_calls",
    o.sql(
        o.TOOLS,
        """SELECT id, query,
      to_json(list_transform(tools, lambda t: [t.name, t.description, replace(t.parameters::VARCHAR, ' ', '')]))::VARCHAR tools,
      to_json(list_transform(calls, lambda c: [c.name, replace(c.arguments::VARCHAR, ' ', '')]))::VARCHAR calls FROM tool_lists""",
    ),
)
def parse_tool_calls(spark, sf_dir):
    parsed = tools.parse_tool_calls(inputs.tool_rows(spark, sf_dir))

    def listed(name, *fields):
        rows = F.transform(name, lambda x: F.array(*[x[f] for f in fields]))
        return F.to_json(rows, {"ignoreNullFields": "false"})

    return parsed.select(
        "id", "query", listed("tools", "name", "description", "parameters").alias("tools"),
        listed("answers", "name", "arguments").alias("calls"),
    )


@query(
    "explode_tools",
    o.sql(
        o.TOOLS,
        """SELECT id, place::INT tool_no, coalesce(t.name, 'Unknown') AS name,
      coalesce(t.description, 'No description') description
    FROM (SELECT id, unnest(tools) t, generate_subscripts(tools, 1) place FROM tool_lists)""",
    ),
)
def explode_tools(spark, sf_dir):
    return tools.explode_tools(tools.parse_tool_calls(inputs.tool_rows(spark, sf_dir)))


@query(
    "explode_calls",
    o.sql(
        o.TOOLS,
        """SELECT id, place::INT call_no, coalesce(c.name, 'Unknown') AS name,
      coalesce(replace(c.arguments::VARCHAR, ' ', ''), '{}') arguments
    FROM (SELECT id, unnest(calls) c, generate_subscripts(calls, 1) place FROM tool_lists)""",
    ),
)
def explode_calls(spark, sf_dir):
    return tools.explode_calls(tools.parse_tool_calls(inputs.tool_rows(spark, sf_dir)))


@query(
    "read_examples",
    f"""SELECT doc_id example_ord, 'documents_train_' || doc_id example_id, lang question, text answer,
      {o.loose("text")} final_answer FROM documents""",
)
def read_examples(spark, sf_dir):
    return readers.read_examples(
        spark, f"{sf_dir}/documents.parquet", "documents", "train", "lang", "text"
    )


@query(
    "read_pipeline_results",
    o.sql(
        o.RESULTS,
        f"""SELECT example_id, question, answer, final_answer, cot, {o.as_json("segments")} segments,
      {o.as_json("required_segments")} required_segments, {o.as_json("nodes")} nodes, {o.as_json("edges")} edges,
      success, pipeline_type FROM results""",
    ),
)
def read_pipeline_results(spark, sf_dir):
    """Writes the results as compressed JSON array files, as many as there are tasks, and reads them back."""
    path = stage_path(spark, "results")
    rows = inputs.results(spark, sf_dir).drop("example_ord", "style")
    writers.write_samples(rows, path, "json", compression="gzip")
    back = readers.read_pipeline_results(spark, path)
    lists = [inputs.as_json(c) for c in ("segments", "required_segments", "nodes", "edges")]
    return back.select(
        "example_id", "question", "answer", "final_answer", "cot", *lists, "success",
        "pipeline_type",
    )


# Dataset lines of the documents: cut JSON, absent fields and absent ids by document number.
SFT_LINES = """
sft_lines AS (
  SELECT doc_id, doc_id % 9 = 4 bad, CASE WHEN doc_id % 8 <> 3 THEN doc_id::VARCHAR END id,
    CASE WHEN doc_id % 7 <> 2 THEN lang ELSE '' END question, text answer FROM documents)"""


def _sft_lines(spark, sf_dir):
    key = F.col("doc_id")
    whole = F.to_json(
        F.struct(
            F.lit("train").alias("split"),
            F.when(key % 8 != 3, key.cast("string")).alias("id"),
            F.when(key % 7 != 2, F.col("lang")).alias("question"),
            F.col("text").alias("answer"),
        )
    )
    cut = F.substring(whole, F.lit(1), F.length(whole) - 1)
    line = F.when(key % 9 == 4, cut).otherwise(whole)
    path = stage_path(spark, "sft")
    corpora.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return readers.read_sft(spark, path)


@query(
    "read_sft",
    o.sql(
        SFT_LINES,
        "SELECT 'train' split, id, question, answer, '' final_answer FROM sft_lines WHERE NOT bad",
    ),
)
def read_sft(spark, sf_dir):
    return readers.good_lines(_sft_lines(spark, sf_dir)).drop("file")


@query(
    "sft_bad_lines",
    o.sql(
        SFT_LINES,
        """SELECT count(DISTINCT id) FILTER (WHERE NOT bad) distinct_ids,
      count_if(id IS NULL AND NOT bad)::BIGINT missing_id_rows, count_if(bad)::BIGINT bad_lines
    FROM sft_lines""",
    ),
)
def sft_bad_lines(spark, sf_dir):
    rows = _sft_lines(spark, sf_dir).withColumn("file", F.lit("all"))
    return consistency.ids_per_file(rows).drop("file")


@query(
    "write_sft",
    o.sql(
        o.PATHS + graph_queries.CAPPED,
        "SELECT 'train' split, example_ord::VARCHAR id, question, answer, final_answer FROM cots",
    ),
)
def write_sft(spark, sf_dir):
    """Writes the alternative training rows in their layout and reads them back."""
    rows = graph_queries.to_sft_alternative(spark, sf_dir)
    base = stage_path(spark, "sft_data")
    path = writers.write_sft(rows, base, "orders", 10, "alternative_cots_direct", compression="gzip")
    return readers.good_lines(readers.read_sft(spark, path)).drop("file")


@query(
    "write_samples_csv",
    o.sql(
        o.EXAMPLES,
        "SELECT example_id, question, answer, style, final_answer FROM examples",
    ),
)
def write_samples_csv(spark, sf_dir):
    """Writes examples as CSV with line breaks inside fields and reads them back."""
    rows = inputs.examples(spark, sf_dir).drop("example_ord")
    path = stage_path(spark, "csv")
    writers.write_samples(rows, path, "csv")
    options = {"header": True, "multiLine": True, "escape": '"'}
    return spark.read.options(**options).schema(rows.schema).csv(path)


def _as_text(tables: dict[str, str]) -> str:
    """SQL that puts tables under one another, every row as JSON of its columns in order of their names."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS kind, to_json([{columns}])::VARCHAR AS content FROM ({sql})" for name, (sql, columns) in tables.items()
    )


# All five tables come from the same expressions, so the statement lists these once.
ALT_CTES = o.PATHS + graph_queries.CAPPED + graph_queries.ALT_RESULTS
ALT_TABLES = {
    "cots": (
        "SELECT example_id, cot_no, path_no, question, answer, final_answer FROM cots",
        "answer, cot_no::VARCHAR, example_id, final_answer, path_no::VARCHAR, question",
    ),
    "combined": (o.select_of(SQL["combined_cots_text"], o.PATHS + graph_queries.CAPPED), "document, example_id"),
    "metadata": (
        o.select_of(SQL["alt_cot_metadata"], o.PATHS),
        "cots_saved::VARCHAR, example_id, method, sampling_applied::VARCHAR, total_paths_generated::VARCHAR",
    ),
    "results": (o.select_of(SQL["alt_cot_results"], o.PATHS + graph_queries.ALT_RESULTS), "cots_saved::VARCHAR, error, example_id"),
    "summary": (
        o.select_of(SQL["alt_cot_summary"], o.PATHS + graph_queries.ALT_RESULTS),
        "successful_examples::VARCHAR, total_cots_saved::VARCHAR, total_examples::VARCHAR",
    ),
}


@query("write_alt_cots", o.sql(ALT_CTES, _as_text(ALT_TABLES)))
def write_alt_cots(spark, sf_dir):
    """Publishes the five tables of a style and reads all of them back through the manifest."""
    paths = inputs.paths(spark, sf_dir)
    records = cots.cot_records(
        paths, inputs.results(spark, sf_dir), "example_ord", 10, 5, lambda joined: stored(joined, "cot-records")
    )
    results, base = cots.alt_cot_results(paths, 10), stage_path(spark, "alt")
    tables = cots.alternative_cots(records), cots.alt_cot_metadata(paths, 10), cots.alt_cot_summary(results)
    writers.write_alt_cots(*tables, base, "direct", cots.combined_cots_text(records), results)

    def listed(name):
        names = sorted(c.split("::")[0].strip() for c in ALT_TABLES[name][1].split(", "))
        df = read_published(spark, f"{base}/alternative_cots_direct", name)
        texts = F.array(*[F.col(c).cast("string") for c in names])
        return df.select(F.lit(name).alias("kind"), F.to_json(texts, {"ignoreNullFields": "false"}).alias("content"))

    return functools.reduce(DataFrame.unionByName, map(listed, ALT_TABLES))


@query(
    "read_reasoning_paths",
    o.sql(
        o.PATHS,
        """SELECT p.example_id, p.error, p.complexity, p.method, p.total_paths::INT total_paths,
      s.path_no::INT path_no, s.sequence, s.texts
    FROM paths p LEFT JOIN spelled s ON s.example_ord = p.example_ord""",
    ),
)
def read_reasoning_paths(spark, sf_dir):
    """Writes the paths in their stored layout as JSON array files and reads them back.

    The layout repeats the texts of an example in each of its orderings, so the files are compressed;
    ``spread`` makes as many as there are tasks to read them.
    """
    path = stage_path(spark, "stored")
    stored = writers.stored_paths(jobs.spread(inputs.paths(spark, sf_dir)))
    writers.write_samples(stored, path, "json", compression="gzip")
    rows = readers.read_reasoning_paths(spark, path).select(
        "example_id", "error", F.col("complexity_estimate.complexity").alias("complexity"),
        "method", "total_paths", "node_ids", "node_texts",
        F.posexplode_outer("orderings").alias("at", "ordering"),
    )

    def joined(names, mark):
        return F.when(
            F.col("ordering").isNotNull(),
            F.array_join(orderings.spelled(F.col("ordering"), F.col(names)), mark),
        )

    return rows.select(
        "example_id", "error", "complexity", "method", "total_paths",
        (F.col("at") + 1).alias("path_no"),
        joined("node_ids", " → ").alias("sequence"),
        joined("node_texts", "\n").alias("texts"),
    )


@query("write_report", SQL["analysis_summary"])
def write_report(spark, sf_dir):
    """Writes all report tables and reads the summary back."""
    paths = inputs.paths(spark, sf_dir)
    root = stage_path(spark, "report")
    writers.write_report(jobs.analyze_paths(paths), root)
    back = spark.read.schema("section string, key string, value double").json(f"{root}/summary")
    return back.withColumn("value", F.round("value", 9))


@query(
    "ingest_responses_stream",
    o.sql(
        o.RESPONSES
        + f""",
p AS (SELECT example_id, stage, CASE WHEN stage = 'cot' THEN {o.tag("response", "cot")} END cot,
    CASE WHEN stage = 'segments' THEN {o.tag("response", "segments")} END s,
    CASE WHEN stage = 'graph' THEN {o.tag("response", "nodes")} END n,
    CASE WHEN stage = 'graph' THEN {o.tag("response", "edges")} END e FROM responses)""",
        f"""SELECT example_id, stage, cot, {o.as_json(o.parsed("s", o.SEGMENT_JSON))} segments,
      {o.as_json(o.parsed("n", o.NODE_JSON))} nodes, {o.as_json(o.parsed("e", o.EDGE_JSON))} edges
    FROM p""",
    ),
)
def ingest_responses_stream_query(spark, sf_dir):
    """Responses land as compressed JSON files, run through the stream and come back as a table."""
    base = stage_path(spark, "stream")
    inputs.responses(spark, sf_dir).write.json(f"{base}/landing", compression="gzip")
    stream = ingest_responses_stream(
        spark, f"{base}/landing", f"{base}/parsed", f"{base}/checkpoint"
    )
    stream.awaitTermination()
    back = spark.read.parquet(f"{base}/parsed")
    return back.select("example_id", "stage", "cot", *[inputs.as_json(c) for c in ("segments", "nodes", "edges")])


@query(
    "ingest_results_stream",
    o.sql(
        text_queries.ASSEMBLED,
        text_queries.ASSEMBLED_SELECT + " WHERE sr IS NOT NULL AND gr IS NOT NULL AND (direct OR cr IS NOT NULL)",
    ),
)
def ingest_results_stream_query(spark, sf_dir):
    """Responses arrive last stage first, every file twice, as many files per batch as a stage has;
    results are assembled from what the stream put together."""
    base = stage_path(spark, "results-stream")
    examples = inputs.examples(spark, sf_dir)
    inputs.responses(spark, sf_dir).write.parquet(f"{base}/responses", compression="zstd")
    responses, files = spark.read.parquet(f"{base}/responses"), spark.sparkContext.defaultParallelism
    direct = pipeline_type(F.col("style")) == "direct_answer_segmentation"
    stages = [F.lit(s) for s in ("segments", "graph", "cot")]
    needed = examples.select("example_id", F.when(direct, F.array(*stages[:2])).otherwise(F.array(*stages)).alias("needed"))
    for stage in ("graph", "segments", "cot", "graph"):
        responses.where(F.col("stage") == stage).coalesce(files).write.mode("append").json(f"{base}/landing", compression="gzip")
    for turn in range(2):
        # The second run goes on from the checkpoint of the first, when all files have come again.
        if turn:
            responses.coalesce(2 * files).write.mode("append").json(f"{base}/landing", compression="gzip")
            drop_stage(spark, f"{base}/responses")
        ingest_results_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint", needed, files).awaitTermination()
    found = read_results_stream(spark, f"{base}/out")
    complete = examples.join(found.select("example_id").distinct(), "example_id", "left_semi")
    return text_queries.assembled_rows(prompts.assemble_results(complete, found))


REPORT_SQL = f"""
WITH summary AS ({SQL["analysis_summary"]}), steps AS (
  SELECT t.*, position_range FROM ({SQL["top_steps"]}) t LEFT JOIN ({SQL["step_position_variance"]}) v USING (step)
), wide AS (
  SELECT max(value) FILTER (key = 'total_examples') total, max(value) FILTER (key = 'successful_examples') good,
    max(value) FILTER (key = 'examples_with_multiple_paths') several,
    max(value) FILTER (key = 'avg_paths_per_example') mean, max(value) FILTER (key = 'max_paths') most
  FROM summary WHERE section IN ('totals', 'flexibility_stats')
), counted AS (
  SELECT CASE section WHEN 'method_usage' THEN 2 ELSE 3 END section, row_number() OVER (PARTITION BY section ORDER BY key) place,
    CASE key WHEN 'exhaustive' THEN 'Exhaustive' WHEN 'sampling' THEN 'Sampling' WHEN 'unknown' THEN 'Unknown'
      WHEN 'single_path' THEN 'Single Path' ELSE replace(key, '_paths', ' Paths') END || ': ' || value::BIGINT || ' examples' line
  FROM summary WHERE section IN ('method_usage', 'path_distribution') AND value > 0
), listed AS (
  SELECT 4 section, rank + CASE class WHEN 'always_first' THEN 0 WHEN 'always_last' THEN 100 ELSE 200 END place,
    '  ' || step || ': ' || examples || ' examples'
      || CASE WHEN class = 'flexible' THEN ' (variance: ' || coalesce(position_range, 0) || ')' ELSE '' END line
  FROM steps
), lines AS (
  SELECT unnest([0, 0, 0]) section, unnest([0, 1, 2]) place,
    unnest(['REASONING PATHS ANALYSIS REPORT', repeat('=', 50), '']) line
  UNION ALL SELECT unnest([1, 2, 3, 4]), -2,
    unnest(['SUMMARY', 'GENERATION METHODS', 'PATH COUNT DISTRIBUTION', 'REASONING STEP PATTERNS'])
  UNION ALL SELECT unnest([1, 2, 3, 4]), -1, unnest([repeat('-', 20), repeat('-', 20), repeat('-', 25), repeat('-', 25)])
  UNION ALL SELECT unnest([1, 2, 3]), 10000, ''
  UNION ALL SELECT 1, unnest([1, 2, 3, 4, 5, 6]), unnest(['Total Examples: ' || total::BIGINT, 'Successful: ' || good::BIGINT,
    'Failed: ' || (total - good)::BIGINT, 'Examples with Multiple Paths: ' || several::BIGINT,
    'Average Paths per Example: ' || printf('%.1f', mean), 'Maximum Paths Found: ' || most::BIGINT]) FROM wide
  UNION ALL SELECT * FROM counted UNION ALL SELECT * FROM listed
  UNION ALL SELECT DISTINCT 4, CASE class WHEN 'always_first' THEN 0 WHEN 'always_last' THEN 100 ELSE 200 END,
    CASE class WHEN 'always_first' THEN 'Steps that always come first:' WHEN 'always_last' THEN 'Steps that always come last:'
      ELSE 'Most flexible steps (variable position):' END FROM steps
  UNION ALL SELECT DISTINCT 4, CASE class WHEN 'always_first' THEN 99 ELSE 199 END, '' FROM steps WHERE class <> 'flexible'
)
SELECT section::INT section, place::INT place, line FROM lines"""


@query("analysis_report", REPORT_SQL)
def analysis_report(spark, sf_dir):
    return jobs.analyze_paths(inputs.paths(spark, sf_dir))["report"]


@query(
    "head_n_sparse",
    o.sql(o.EXAMPLES, "SELECT example_id, question FROM examples ORDER BY example_ord LIMIT 100"),
)
def head_n_sparse(spark, sf_dir):
    """The first rows by an index with gaps, of the struct type that readers give."""
    place = F.struct((F.col("example_ord") * 10).alias("block"), F.lit(1).alias("row"))
    rows = inputs.examples(spark, sf_dir).withColumn("example_ord", place)
    return sampling.head_n(rows, 100).select("example_id", "question")


@query(
    "sample_n_large",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER () n,
      row_number() OVER (ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber)) rn FROM lineitem)
    WHERE rn <= n - n // 4""",
)
def sample_n_large(spark, sf_dir):
    """Three quarters of the line items, by a key of two columns."""
    rows = corpora.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    n = rows.count()
    return sampling.sample_n(rows, n - n // 4, 42, ["l_orderkey", "l_linenumber"])


UNSEEDED = graph_queries.CAPPED.replace("'5|", "'0|")


@query("alternative_sft", o.sql(o.PATHS + UNSEEDED, graph_queries.SFT_ALT))
def alternative_sft(spark, sf_dir):
    return jobs.alternative_sft(inputs.results(spark, sf_dir), "example_ord")


@query(
    "export_training_alternative",
    o.sql(
        o.PATHS
        + UNSEEDED
        + f""",
sft AS ({graph_queries.SFT_ALT}),
ranked AS (SELECT *, count(*) OVER () n, row_number() OVER (ORDER BY md5('42|' || id), md5(to_json(
  {{'split': split, 'id': id, 'question': question, 'answer': answer, 'final_answer': final_answer}}))) rn FROM sft)""",
        f"""SELECT id, CASE WHEN rn <= ceil(0.1 * n) THEN 'validation' ELSE 'train' END part,
      '{text_queries.MATH_SQL}' || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || answer prompt FROM ranked""",
    ),
)
def export_training_alternative(spark, sf_dir):
    """Chains of thought of one question share their id; rows are split one by one."""
    return jobs.export_training(jobs.alternative_sft(inputs.results(spark, sf_dir), "example_ord"))


@query("check_ids", SQL["id_differences"])
def check_ids(spark, sf_dir):
    return jobs.check_ids(inputs.sft_ids(spark, sf_dir), "original.jsonl")["differences"]


@query("score", SQL["accuracy"])
def score(spark, sf_dir):
    examples = inputs.examples(spark, sf_dir)
    return jobs.score(corpora.predictions_from_examples(examples), examples)[1]


@query("parse_responses", o.sql(text_queries.ASSEMBLED, """SELECT count(*) FILTER (failed_stage IS NULL) successful, count(*) total,
      100 * count(*) FILTER (failed_stage IS NULL) / count(*) AS "percent" FROM staged"""))
def parse_responses(spark, sf_dir):
    return _parsed(spark, sf_dir)[1]


@query("parse_responses_results", o.sql(text_queries.ASSEMBLED, text_queries.ASSEMBLED_SELECT))
def parse_responses_results(spark, sf_dir):
    return text_queries.assembled_rows(_parsed(spark, sf_dir)[0])


def _parsed(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    return jobs.parse_responses(rows, corpora.responses_from_results(corpora.results_from_examples(rows)))
