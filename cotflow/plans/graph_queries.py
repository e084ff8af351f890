"""Queries over step graphs, their orderings and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotflow.functions.lambdas import computed_once
from cotflow.functions.text import alt_answer
from cotflow.operators import analysis, cots, datasets, exact_orderings, graphs, orderings, segments
from cotflow.plans import inputs, jobs, oracle_ctes as o
from cotflow.plans.registry import query


def _graphs(spark, sf_dir):
    return graphs.with_graph(inputs.results(spark, sf_dir)).where(F.col("graph").isNotNull())


def _acyclic_graphs(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    checked = computed_once(
        rows, ["example_id", "graph"], orderings.is_acyclic(F.col("graph")).alias("acyclic")
    )
    return checked.where("acyclic")


@query(
    "valid_graph_input",
    o.sql(
        o.GRAPHS,
        """SELECT example_id, valid, CASE WHEN NOT valid THEN 'Invalid input' END error
    FROM inputs""",
    ),
)
def valid_graph_input(spark, sf_dir):
    rows = inputs.results(spark, sf_dir)
    valid = graphs.valid_input(F.col("success"), F.col("nodes"), F.col("edges"))
    return rows.select(
        "example_id", valid.alias("valid"),
        F.when(~valid, graphs.INVALID_INPUT).alias("error"),
    )


@query(
    "value_dependency_edges",
    o.sql(
        o.RESULTS,
        """SELECT 'orders_train_' || example_ord example_id, src, dst FROM links""",
    ),
)
def value_dependency_edges(spark, sf_dir):
    rows = inputs.examples(spark, sf_dir)
    drafted = rows.select(
        "example_id",
        segments.renumbered_nodes(segments.segment_direct(F.col("answer"))).alias("nodes"),
    )
    found = drafted.select(
        "example_id", F.explode(graphs.value_dependency_edges(F.col("nodes"))).alias("e")
    )
    return found.select("example_id", F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"))


@query(
    "value_dependency_edges_lines",
    rf"""WITH doc AS (
      SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') lines FROM documents WHERE text IS NOT NULL),
    steps AS (
      SELECT doc_id, i, length(lines[i // 2]) || ' and ' || (length(lines[i]) % 7) || ' give = ' || length(lines[i]) AS text
      FROM doc, unnest(range(1, len(lines) + 1)) t(i)),
    made AS (SELECT doc_id, i, unnest(regexp_extract_all(text, '=\s*\$?({o.NUMBER})', 1)) v FROM steps WHERE text IS NOT NULL),
    used AS (SELECT doc_id, i, unnest(regexp_extract_all(regexp_replace(text, '=\s*\$?({o.NUMBER})', '=', 'g'), '({o.NUMBER})', 1)) v FROM steps
      WHERE text IS NOT NULL)
    SELECT DISTINCT 'documents_train_' || m.doc_id example_id, 's' || m.i src, 's' || u.i dst
    FROM made m JOIN used u ON u.doc_id = m.doc_id AND u.v = m.v AND m.i < u.i""",
)
def value_dependency_edges_lines(spark, sf_dir):
    """Steps from all lines of a document: each gives its own length and uses that of line i / 2."""
    rows = inputs.line_graphs(spark, sf_dir)

    def length(at):
        return F.length(F.get("nodes", at)["text"])

    def step(n, i):
        before = F.call_function("div", i + 1, F.lit(2)).cast("int") - 1
        text = F.concat(length(before), F.lit(" and "), length(i) % 7, F.lit(" give = "), length(i))
        return F.struct(n["id"].alias("id"), F.when(before >= 0, text).alias("text"))

    steps = rows.select("example_id", F.transform("nodes", step).alias("nodes"))
    return graphs.value_dependency_edge_rows(steps).select("example_id", "src", "dst")


@query(
    "valid_edges",
    o.sql(
        o.RESULTS
        + """,
er AS (SELECT example_id, example_ord, unnest(edges) e FROM results),
nr AS (SELECT DISTINCT example_ord, n.id FROM (SELECT example_ord, unnest(nodes) n FROM results))""",
        """SELECT example_id, e[1] src, e[2] dst FROM er WHERE len(e) = 2
      AND EXISTS (SELECT 1 FROM nr WHERE nr.example_ord = er.example_ord AND nr.id = e[1])
      AND EXISTS (SELECT 1 FROM nr WHERE nr.example_ord = er.example_ord AND nr.id = e[2])""",
    ),
)
def valid_edges(spark, sf_dir):
    rows = inputs.results(spark, sf_dir)
    kept = graphs.valid_edges(F.col("edges"), graphs.node_ids(F.col("nodes")))
    found = rows.select("example_id", F.explode(kept).alias("e"))
    return found.select("example_id", F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"))


@query(
    "build_graph_nodes",
    o.sql(
        o.GRAPHS,
        """SELECT 'orders_train_' || example_ord example_id, v::INT AS position, id, text
    FROM node_ids""",
    ),
)
def build_graph_nodes(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    zipped = F.arrays_zip(F.col("graph.ids").alias("id"), F.col("graph.texts").alias("text"))
    found = rows.select("example_id", F.posexplode(zipped).alias("position", "n"))
    return found.select("example_id", "position", "n.id", "n.text")


@query(
    "build_graph_edges",
    o.sql(
        o.GRAPHS,
        "SELECT 'orders_train_' || example_ord example_id, src_id src, dst_id dst FROM edge_ids",
    ),
)
def build_graph_edges(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    return rows.select("example_id", F.inline(graphs.edge_list(F.col("graph"))))


@query(
    "is_acyclic",
    o.sql(o.GRAPHS, "SELECT 'orders_train_' || example_ord example_id, acyclic FROM shape"),
)
def is_acyclic(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    return rows.select("example_id", orderings.is_acyclic(F.col("graph")).alias("acyclic"))


@query(
    "degrees",
    o.sql(
        o.GRAPHS,
        """SELECT 'orders_train_' || n.example_ord example_id, n.id,
      (SELECT count(*) FROM edge_ids e WHERE e.example_ord = n.example_ord AND e.dst = n.v) in_degree,
      (SELECT count(*) FROM edge_ids e WHERE e.example_ord = n.example_ord AND e.src = n.v) out_degree
    FROM node_ids n""",
    ),
)
def degrees(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    edges = graphs.edge_list(F.col("graph"))
    described = rows.select("example_id", F.col("graph.ids").alias("ids"), edges.alias("edges"))

    def degree(step):
        def count(end):
            return F.size(F.filter("edges", lambda e: e[end] == step)).cast("bigint")

        return F.struct(
            step.alias("id"), count("dst").alias("in_degree"), count("src").alias("out_degree")
        )

    return described.select("example_id", F.inline(F.transform("ids", degree)))


COMPLEXITY = """SELECT 'orders_train_' || example_ord example_id, complexity,
      CASE complexity WHEN 'LOW' THEN '1–10' WHEN 'MEDIUM' THEN '10–1,000'
        WHEN 'HIGH' THEN '1,000–100,000' ELSE '100,000+' END estimated_paths,
      nodes::INT nodes, edges::INT edges, round(ratio, 2) constraint_ratio,
      coalesce(sources, 0)::INT source_nodes, coalesce(sinks, 0)::INT sink_nodes,
      (coalesce(sources, 0) * coalesce(sinks, 0))::INT source_sink_pairs,
      complexity IN ('HIGH', 'VERY HIGH') use_sampling FROM labelled WHERE acyclic"""


@query("complexity_estimate", o.sql(o.GRAPHS, COMPLEXITY))
def complexity_estimate(spark, sf_dir):
    rows = _acyclic_graphs(spark, sf_dir)
    found = rows.select("example_id", graphs.complexity_estimate(F.col("graph")).alias("c"))
    return found.select("example_id", "c.*")


def _plan_sql(samples: int, medium: int, low: int) -> str:
    return o.sql(
        o.GRAPHS,
        f"""SELECT 'orders_train_' || example_ord example_id,
      CASE WHEN complexity IN ('HIGH', 'VERY HIGH') THEN 'sampling' ELSE 'exhaustive' END AS method,
      CASE complexity WHEN 'LOW' THEN {low} WHEN 'MEDIUM' THEN {medium} ELSE {samples} END cap
    FROM labelled""",
    )


def _plan(spark, sf_dir, for_cots):
    rows = _graphs(spark, sf_dir)
    estimated = rows.select("example_id", graphs.complexity_estimate(F.col("graph")).alias("c"))
    plan = orderings.generation_plan(F.col("c"), for_cots)
    return estimated.select("example_id", plan.alias("p")).select("example_id", "p.*")


@query("generation_plan", _plan_sql(500, 1000, 10000))
def generation_plan(spark, sf_dir):
    return _plan(spark, sf_dir, False)


@query("generation_plan_cots", _plan_sql(50, 100, 200))
def generation_plan_cots(spark, sf_dir):
    return _plan(spark, sf_dir, True)


ORDINALS = "array_to_string(path, ',') AS path"


def _ordinal_rows(rows, found):
    listed = rows.select("example_id", F.posexplode(found).alias("at", "o"))
    return listed.select(
        "example_id",
        (F.col("at") + 1).cast("bigint").alias("path_no"),
        F.array_join(F.col("o").cast("array<string>"), ",").alias("path"),
    )


@query(
    "enumerate_orderings",
    o.sql(
        o.GRAPHS + o.orderings(),
        f"""SELECT 'orders_train_' || example_ord example_id, path_no, {ORDINALS}
    FROM orderings WHERE path_no <= 10000""",
    ),
)
def enumerate_orderings(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    return _ordinal_rows(rows, orderings.enumerate_orderings(F.col("graph")))


@query(
    "enumerate_orderings_capped",
    o.sql(
        o.GRAPHS + o.orderings(),
        f"""SELECT 'orders_train_' || example_ord example_id, path_no, {ORDINALS}
    FROM orderings WHERE path_no <= 7""",
    ),
)
def enumerate_orderings_capped(spark, sf_dir):
    rows = _graphs(spark, sf_dir)
    return _ordinal_rows(rows, orderings.enumerate_orderings(F.col("graph"), 7))


@query(
    "sample_orderings",
    o.sql(
        o.GRAPHS + o.samples(5, 11, "acyclic"),
        f"SELECT 'orders_train_' || example_ord example_id, path_no, {ORDINALS} FROM samples",
    ),
)
def sample_orderings(spark, sf_dir):
    rows = _acyclic_graphs(spark, sf_dir)
    found = orderings.sample_orderings(F.col("graph"), F.col("example_id"), 5, 11)
    return _ordinal_rows(rows, found)


def _acyclic_line_graphs(spark, sf_dir):
    rows = graphs.with_graph(inputs.line_graphs(spark, sf_dir)).where(F.col("graph").isNotNull())
    checked = computed_once(
        rows, ["example_id", "graph"], orderings.is_acyclic(F.col("graph")).alias("acyclic")
    )
    return checked.where("acyclic")


def _digests(rows, found):
    """Per example how many orderings there are and a digest of all of them in order."""
    listed = computed_once(rows, ["example_id"], found.alias("o"))
    text = F.transform("o", lambda p: F.array_join(p.cast("array<string>"), ","))
    return listed.select(
        "example_id", F.size("o").cast("bigint").alias("paths"), F.md5(F.array_join(text, "|")).alias("digest")
    )


LINE_DIGESTS = """SELECT 'documents_train_' || k example_id, count(*) paths,
      md5(string_agg(array_to_string(path, ','), '|' ORDER BY path_no)) digest FROM line_paths GROUP BY k"""


@query("enumerate_orderings_wide", o.sql(o.LINE_GRAPHS + o.LINE_ORDERINGS.format(cap=1000), LINE_DIGESTS))
def enumerate_orderings_wide(spark, sf_dir):
    """The first thousand orderings of the lines of every document, also beyond 62 lines."""
    rows = _acyclic_line_graphs(spark, sf_dir)
    return _digests(rows, orderings.enumerate_orderings(F.col("graph"), 1000))


@query("sample_orderings_wide", o.sql(o.LINE_GRAPHS + o.LINE_SAMPLES.format(n=20, attempts=100, seed=11), LINE_DIGESTS))
def sample_orderings_wide(spark, sf_dir):
    rows = _acyclic_line_graphs(spark, sf_dir)
    return _digests(rows, orderings.sample_orderings(F.col("graph"), F.col("example_id"), 20, 11))


@query(
    "step_position_bounds",
    o.sql(
        o.GRAPHS,
        """SELECT i.example_id, a.id step, (SELECT count(*) FROM reach r WHERE r.example_ord = a.example_ord AND r.dst = a.v)::INT earliest,
      (l.nodes - 1 - (SELECT count(*) FROM reach r WHERE r.example_ord = a.example_ord AND r.src = a.v))::INT latest
    FROM node_ids a JOIN labelled l USING (example_ord) JOIN inputs i USING (example_ord) WHERE l.acyclic""",
    ),
)
def step_position_bounds(spark, sf_dir):
    """Exact places of every step, where reports over sampled orderings know a part of them."""
    return exact_orderings.position_bounds(_graphs(spark, sf_dir))


@query(
    "step_position_bounds_wide",
    o.sql(
        o.LINE_GRAPHS,
        """SELECT 'documents_train_' || s.k example_id, 's' || (v + 1) step,
      (SELECT count(*) FROM line_reach r WHERE r.k = s.k AND r.b = s.v)::INT earliest,
      (n - 1 - (SELECT count(*) FROM line_reach r WHERE r.k = s.k AND r.a = s.v))::INT latest FROM line_slots s""",
    ),
)
def step_position_bounds_wide(spark, sf_dir):
    rows = graphs.with_graph(inputs.line_graphs(spark, sf_dir))
    return exact_orderings.position_bounds(rows)


@query(
    "count_orderings_exact",
    o.sql(
        o.PATHS + o.orderings(),
        """SELECT example_id, p.total_paths::INT total_paths, count(x.path)::VARCHAR total_orderings
    FROM paths p LEFT JOIN orderings x USING (example_ord) WHERE error IS NULL OR error = 'Graph contains cycles' GROUP BY ALL""",
    ),
)
def count_orderings_exact(spark, sf_dir):
    """What the capped or sampled run found beside the number of orderings there are."""
    exact = exact_orderings.count_orderings(_graphs(spark, sf_dir))
    found = inputs.paths(spark, sf_dir).select("example_id", "total_paths")
    return exact.join(found, "example_id").select("example_id", "total_paths", "total_orderings")


def _path_records(paths):
    return paths.select(
        "example_id", "error", F.col("complexity_estimate.complexity").alias("complexity"),
        "method", F.col("total_paths").cast("bigint").alias("total_paths"),
    )


@query(
    "reasoning_paths_cots",
    o.sql(o.PATHS, "SELECT example_id, error, complexity, method, total_paths FROM paths"),
)
def reasoning_paths_cots(spark, sf_dir):
    return _path_records(orderings.reasoning_paths(inputs.results(spark, sf_dir), for_cots=True))


# Full mode draws up to 2,500 random orderings per example: too slow to repeat in SQL.
@query("reasoning_paths_full")
def reasoning_paths_full(spark, sf_dir):
    return _path_records(orderings.reasoning_paths(inputs.results(spark, sf_dir)))


def _spelled(rows):
    return rows.select(
        "example_id",
        F.col("path_no").cast("bigint").alias("path_no"),
        F.array_join("sequence", " → ").alias("sequence"),
        F.array_join("texts", "\n").alias("texts"),
    )


@query(
    "path_texts",
    o.sql(
        o.PATHS,
        "SELECT 'orders_train_' || example_ord example_id, path_no, sequence, texts FROM spelled",
    ),
)
def path_texts(spark, sf_dir):
    return _spelled(orderings.path_rows(inputs.paths(spark, sf_dir)))


@query(
    "success_summary",
    o.sql(
        o.RESULTS,
        """SELECT count_if(success)::BIGINT successful, count(*) total,
      count_if(success) * 100 / count(*) AS "percent" FROM results""",
    ),
)
def success_summary(spark, sf_dir):
    return analysis.success_summary(inputs.results(spark, sf_dir))


@query(
    "path_run_summary",
    o.sql(
        o.PATHS,
        """SELECT count_if(error IS NULL)::BIGINT successful, count(*) total,
      sum(total_paths)::BIGINT total_paths FROM paths""",
    ),
)
def path_run_summary(spark, sf_dir):
    return analysis.path_run_summary(inputs.paths(spark, sf_dir))


@query(
    "flexibility_stats",
    o.sql(
        o.PATHS,
        """SELECT count_if(total_paths > 1)::BIGINT examples_with_multiple_paths,
      round(avg(total_paths), 9) avg_paths_per_example, max(total_paths)::BIGINT max_paths
    FROM paths WHERE error IS NULL""",
    ),
)
def flexibility_stats(spark, sf_dir):
    stats = analysis.flexibility_stats(inputs.paths(spark, sf_dir))
    return stats.select(
        "examples_with_multiple_paths",
        F.round("avg_paths_per_example", 9).alias("avg_paths_per_example"),
        F.col("max_paths").cast("bigint").alias("max_paths"),
    )


BUCKET = """CASE WHEN total_paths = 1 THEN 'single_path' WHEN total_paths <= 10 THEN '2-10_paths'
      WHEN total_paths <= 100 THEN '11-100_paths' ELSE '100+_paths' END"""


@query(
    "path_count_distribution",
    o.sql(
        o.PATHS,
        f"SELECT {BUCKET} bucket, count(*) examples FROM paths WHERE error IS NULL GROUP BY 1",
    ),
)
def path_count_distribution(spark, sf_dir):
    return analysis.path_count_distribution(inputs.paths(spark, sf_dir))


@query(
    "method_usage",
    o.sql(o.PATHS, "SELECT method, count(*) examples FROM paths WHERE error IS NULL GROUP BY 1"),
)
def method_usage(spark, sf_dir):
    return analysis.method_usage(inputs.paths(spark, sf_dir))


@query(
    "complexity_distribution",
    o.sql(
        o.PATHS, "SELECT complexity, count(*) examples FROM paths WHERE error IS NULL GROUP BY 1"
    ),
)
def complexity_distribution(spark, sf_dir):
    return analysis.complexity_distribution(inputs.paths(spark, sf_dir))


@query(
    "alt_cot_overview",
    o.sql(
        o.PATHS,
        """SELECT count(*) total_examples, count_if(error IS NULL)::BIGINT successful,
      count_if(error IS NOT NULL)::BIGINT failed, sum(total_paths)::BIGINT total_paths,
      count_if(total_paths > 1)::BIGINT examples_with_multiple,
      round(sum(total_paths) / count_if(error IS NULL), 9) avg_paths FROM paths""",
    ),
)
def alt_cot_overview(spark, sf_dir):
    overview = analysis.alt_cot_overview(inputs.paths(spark, sf_dir))
    return overview.withColumn("avg_paths", F.round("avg_paths", 9))


@query(
    "step_positions",
    o.sql(
        o.PATHS,
        """SELECT 'orders_train_' || example_ord example_id, step, min_pos::INT min_pos,
      max_pos::INT max_pos, positions::INT positions, occurrences::INT occurrences FROM positions""",
    ),
)
def step_positions(spark, sf_dir):
    found = analysis.step_positions(inputs.paths(spark, sf_dir))
    return found.drop("example_ord", "first_path_pos", "last_pos")


CLASSES = """,
classes AS (
  SELECT *, positions = 1 AND min_pos = 0 always_first,
    positions = 1 AND min_pos <> 0 AND min_pos = last_pos always_last, positions > 1 flexible
  FROM positions),
flexibility AS (
  SELECT step, count_if(always_first)::BIGINT always_first,
    count_if(always_last)::BIGINT always_last, count_if(flexible)::BIGINT flexible,
    min(CASE WHEN always_first THEN [example_ord, first_path_pos] END) always_first_seen,
    min(CASE WHEN always_last THEN [example_ord, first_path_pos] END) always_last_seen,
    min(CASE WHEN flexible THEN [example_ord, first_path_pos] END) flexible_seen
  FROM classes GROUP BY step)"""


@query(
    "step_flexibility",
    o.sql(o.PATHS + CLASSES, "SELECT step, always_first, always_last, flexible FROM flexibility"),
)
def step_flexibility(spark, sf_dir):
    positions = analysis.step_positions(inputs.paths(spark, sf_dir))
    found = analysis.step_flexibility(positions)
    return found.select("step", "always_first", "always_last", "flexible")


@query(
    "step_position_variance",
    o.sql(
        o.PATHS,
        """SELECT step, max_by(max_pos - min_pos, example_ord)::INT position_range FROM positions
    WHERE occurrences > 1 GROUP BY step""",
    ),
)
def step_position_variance(spark, sf_dir):
    return analysis.step_position_variance(analysis.step_positions(inputs.paths(spark, sf_dir)))


@query(
    "top_steps",
    o.sql(
        o.PATHS + CLASSES,
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT '{name}' class, row_number() OVER (ORDER BY {name} DESC, "
            f"{name}_seen)::INT AS \"rank\", step, {name} examples FROM flexibility "
            f"WHERE {name} > 0) WHERE \"rank\" <= {k}"
            for name, k in (("always_first", 5), ("always_last", 5), ("flexible", 10))
        ),
    ),
)
def top_steps(spark, sf_dir):
    flexibility = analysis.step_flexibility(analysis.step_positions(inputs.paths(spark, sf_dir)))
    return analysis.top_steps(flexibility)


@query(
    "analysis_summary",
    o.sql(
        o.PATHS + CLASSES,
        f"""SELECT 'totals' section, 'total_examples' AS key, count(*)::DOUBLE AS value FROM paths
    UNION ALL SELECT 'totals', 'successful_examples', count_if(error IS NULL) FROM paths
    UNION ALL SELECT 'flexibility_stats', 'examples_with_multiple_paths',
      count_if(total_paths > 1) FROM paths WHERE error IS NULL
    UNION ALL SELECT 'flexibility_stats', 'avg_paths_per_example', round(avg(total_paths), 9)
      FROM paths WHERE error IS NULL
    UNION ALL SELECT 'flexibility_stats', 'max_paths', max(total_paths) FROM paths
    UNION ALL SELECT 'path_distribution', {BUCKET}, count(*) FROM paths WHERE error IS NULL
      GROUP BY 2
    UNION ALL SELECT 'method_usage', method, count(*) FROM paths WHERE error IS NULL GROUP BY 2
    UNION ALL SELECT 'always_first_steps', step, always_first FROM flexibility WHERE always_first > 0
    UNION ALL SELECT 'always_last_steps', step, always_last FROM flexibility WHERE always_last > 0
    UNION ALL SELECT 'flexible_steps', step, flexible FROM flexibility WHERE flexible > 0""",
    ),
)
def analysis_summary(spark, sf_dir):
    summary = analysis.analysis_summary(inputs.paths(spark, sf_dir))
    return summary.withColumn("value", F.round("value", 9))


# Ten kept paths per example: all, or those with the ten smallest seeded digests.
CAPPED = """,
draws AS (
  SELECT *, row_number() OVER (PARTITION BY example_ord
    ORDER BY md5('5|orders_train_' || example_ord || '|' || path_no), path_no) draw FROM spelled),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY example_ord ORDER BY path_no) cot_no
  FROM draws WHERE draw <= 10),
cots AS (
  SELECT k.*, r.example_id, r.question, coalesce(r.final_answer, '') final_answer, p.total_paths,
    p.method, p.complexity, count(*) OVER (PARTITION BY k.example_ord) cots_kept,
    k.texts || CASE WHEN coalesce(r.final_answer, '') <> ''
      THEN chr(10) || '#### ' || r.final_answer ELSE '' END answer,
    '# Alternative COT ' || cot_no || chr(10) || '# Sequence: ' || sequence || chr(10) || chr(10)
      || k.texts || chr(10) cot_text
  FROM kept k JOIN results r ON r.example_ord = k.example_ord
  JOIN paths p ON p.example_ord = k.example_ord)"""


@query(
    "cap_paths",
    o.sql(
        o.PATHS + CAPPED,
        "SELECT 'orders_train_' || example_ord example_id, path_no, sequence, texts FROM kept",
    ),
)
def cap_paths(spark, sf_dir):
    rows = orderings.path_rows(inputs.paths(spark, sf_dir)).drop("example_ord")
    return _spelled(cots.cap_paths(rows, 10, 5))


@query(
    "number_cots",
    o.sql(
        o.PATHS + CAPPED,
        """SELECT 'orders_train_' || example_ord example_id, path_no, cot_no::INT cot_no
    FROM kept""",
    ),
)
def number_cots(spark, sf_dir):
    rows = orderings.path_rows(inputs.paths(spark, sf_dir)).select("example_id", "path_no")
    numbered = cots.number_cots(cots.cap_paths(rows, 10, 5))
    return numbered.withColumn("path_no", F.col("path_no").cast("bigint"))


@query(
    "preview",
    o.sql(
        o.PATHS,
        """SELECT example_id, error, total_paths::INT total_paths, method, complexity, path_no::INT path_no, sequence, texts,
      CASE WHEN error IS NULL THEN greatest(total_paths - 3, 0)::INT END AS more
    FROM paths LEFT JOIN spelled USING (example_ord) WHERE path_no <= 3 OR path_no IS NULL""",
    ),
)
def preview(spark, sf_dir):
    return cots.preview(inputs.paths(spark, sf_dir), 3)


@query(
    "preview_text",
    o.sql(
        o.PATHS,
        """SELECT example_id, path_no::INT path_no, CASE WHEN error IS NOT NULL THEN example_id || ': ' || error
      ELSE CASE WHEN path_no = 1 THEN repeat('=', 80) || chr(10) || 'EXAMPLE: ' || example_id || chr(10) || 'Total Paths: '
          || total_paths || ' (method: ' || method || ', complexity: ' || complexity || ')' || chr(10) || repeat('=', 80) || chr(10)
        ELSE '' END || 'PREVIEW - Alternative COT ' || path_no || ':' || chr(10) || repeat('-', 50) || chr(10) || 'Sequence: '
        || sequence || chr(10) || chr(10) || '  ' || replace(texts, chr(10), chr(10) || '  ') END AS text
    FROM paths LEFT JOIN spelled USING (example_ord) WHERE path_no <= 3 OR path_no IS NULL""",
    ),
)
def preview_text(spark, sf_dir):
    return cots.preview_text(cots.preview(inputs.paths(spark, sf_dir), 3))


@query(
    "keep_last",
    """SELECT l_orderkey, max_by(l_shipdate, ord) l_shipdate, max_by(l_partkey, ord) l_partkey
    FROM (SELECT *, strftime(l_shipdate, '%Y%m%d') || lpad(l_partkey::VARCHAR, 9, '0')
      || lpad(l_linenumber::VARCHAR, 3, '0') ord FROM lineitem) GROUP BY l_orderkey
    UNION ALL SELECT -1 - o_orderkey, NULL, o_custkey FROM orders""",
)
def keep_last(spark, sf_dir):
    """Line items, and one record without any order per order. Every row comes twice, so every
    winner has an equal."""
    items = inputs.table(spark, sf_dir, "lineitem")
    order = F.concat(
        F.date_format("l_shipdate", "yyyyMMdd"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0"),
    )
    rows = items.select("l_orderkey", "l_shipdate", "l_partkey", order.alias("ord"))
    unplaced = inputs.table(spark, sf_dir, "orders").select(
        (-1 - F.col("o_orderkey")).alias("l_orderkey"), F.lit(None).cast("timestamp_ntz").alias("l_shipdate"),
        F.col("o_custkey").alias("l_partkey"), F.lit(None).cast("string").alias("ord"),
    )
    rows = rows.unionByName(unplaced).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return cots.keep_last(rows, "l_orderkey", "ord").drop("ord")


@query(
    "attach_original",
    o.sql(
        o.EXAMPLES,
        """SELECT d.example_id, coalesce(question, '') question, coalesce(answer, '') answer,
      coalesce(final_answer, '') final_answer
    FROM (SELECT 'orders_train_' || o_orderkey example_id FROM orders
      UNION ALL SELECT 'nobody_' || doc_id FROM documents) d
    LEFT JOIN examples e ON e.example_id = d.example_id""",
    ),
)
def attach_original(spark, sf_dir):
    examples = inputs.examples(spark, sf_dir)
    # Twice the originals: an earlier copy with other texts must lose against the later one.
    older = examples.withColumns(
        {"question": F.lit("old"), "example_ord": -F.col("example_ord") - 1}
    )
    unknown = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("nobody_"), "doc_id").alias("example_id")
    )
    wanted = examples.select("example_id").unionByName(unknown)
    return cots.attach_original(wanted, older.unionByName(examples), "example_ord")


def _records(spark, sf_dir):
    results = inputs.results(spark, sf_dir)
    return cots.cot_records(inputs.paths(spark, sf_dir), results, "example_ord", 10, 5)


def _cots(spark, sf_dir):
    return cots.alternative_cots(_records(spark, sf_dir))


@query(
    "alternative_cots",
    o.sql(
        o.PATHS + CAPPED,
        """SELECT example_id, cot_no::INT cot_no, path_no::INT path_no, question, answer,
      final_answer FROM cots""",
    ),
)
def alternative_cots(spark, sf_dir):
    return _cots(spark, sf_dir).select(
        "example_id", "cot_no", "path_no", "question", "answer", "final_answer"
    )


@query(
    "cot_text", o.sql(o.PATHS + CAPPED, "SELECT example_id, cot_no::INT cot_no, cot_text FROM cots")
)
def cot_text(spark, sf_dir):
    return _cots(spark, sf_dir).select("example_id", "cot_no", "cot_text")


@query(
    "combined_cots_text",
    o.sql(
        o.PATHS + CAPPED,
        """SELECT example_id, 'Alternative Chain-of-Thought Reasoning Paths' || chr(10) || 'Example: '
      || example_id || chr(10) || 'Total Paths Generated: ' || any_value(total_paths)
      || ' (method: ' || any_value(method) || ', complexity: ' || any_value(complexity) || ')'
      || chr(10) || 'COTs Saved: ' || count(*)
      || CASE WHEN any_value(total_paths) > 10 THEN ' (sampled 10 of ' || any_value(total_paths)
        || ' paths)' ELSE '' END || chr(10) || repeat('=', 80) || chr(10) || chr(10)
      || string_agg(cot_text || chr(10) || repeat('-', 60) || chr(10) || chr(10), '' ORDER BY cot_no)
      AS document FROM cots GROUP BY example_id""",
    ),
)
def combined_cots_text(spark, sf_dir):
    return cots.combined_cots_text(_records(spark, sf_dir))


@query(
    "alt_answer",
    o.sql(
        o.RESULTS,
        """SELECT example_id, array_to_string(list_transform(required_segments, lambda s: s.text),
      chr(10)) || CASE WHEN coalesce(final_answer, '') <> '' THEN chr(10) || '#### ' || final_answer
      ELSE '' END answer FROM results""",
    ),
)
def alt_answer_query(spark, sf_dir):
    rows = inputs.results(spark, sf_dir)
    texts = F.transform("required_segments", lambda s: s["text"])
    return rows.select("example_id", alt_answer(texts, F.col("final_answer")).alias("answer"))


@query(
    "alt_cot_metadata",
    o.sql(
        o.PATHS,
        """SELECT example_id, total_paths total_paths_generated, least(total_paths, 10)::INT cots_saved,
      total_paths > 10 sampling_applied, 10 max_cots_limit, method, complexity
    FROM paths WHERE total_paths > 0""",
    ),
)
def alt_cot_metadata(spark, sf_dir):
    found = cots.alt_cot_metadata(inputs.paths(spark, sf_dir), 10)
    return found.select(
        "example_id",
        F.col("total_paths_generated").cast("bigint").alias("total_paths_generated"),
        "cots_saved", "sampling_applied", "max_cots_limit", "method",
        F.col("complexity_estimate.complexity").alias("complexity"),
    )


ALT_RESULTS = """,
alt AS (SELECT example_id, least(coalesce(total_paths, 0), 10)::INT cots_saved, error FROM paths)"""


@query("alt_cot_results", o.sql(o.PATHS + ALT_RESULTS, "SELECT * FROM alt"))
def alt_cot_results(spark, sf_dir):
    return cots.alt_cot_results(inputs.paths(spark, sf_dir), 10)


@query(
    "alt_cot_summary",
    o.sql(
        o.PATHS + ALT_RESULTS,
        """SELECT count(*) total_examples, count_if(error IS NULL)::BIGINT successful_examples,
      sum(cots_saved)::BIGINT total_cots_saved FROM alt""",
    ),
)
def alt_cot_summary(spark, sf_dir):
    return cots.alt_cot_summary(cots.alt_cot_results(inputs.paths(spark, sf_dir), 10))


@query(
    "to_sft_original",
    o.sql(
        o.EXAMPLES,
        "SELECT 'train' split, example_ord::VARCHAR id, question, answer, final_answer FROM examples",
    ),
)
def to_sft_original(spark, sf_dir):
    return datasets.to_sft_original(inputs.examples(spark, sf_dir), "train")


SFT_ALT = "SELECT 'train' split, example_ord::VARCHAR id, question, answer, final_answer FROM cots"


@query("to_sft_alternative", o.sql(o.PATHS + CAPPED, SFT_ALT))
def to_sft_alternative(spark, sf_dir):
    return datasets.to_sft_alternative(_cots(spark, sf_dir))


@query(
    "union_styles",
    o.sql(
        o.PATHS + CAPPED,
        f"""SELECT *, 'alternative_cots_direct' AS type FROM ({SFT_ALT})
    UNION ALL SELECT 'train', example_ord::VARCHAR, question, answer, final_answer, 'original'
    FROM examples""",
    ),
)
def union_styles(spark, sf_dir):
    return datasets.union_styles(
        {
            "original": datasets.to_sft_original(inputs.examples(spark, sf_dir)),
            "alternative_cots_direct": datasets.to_sft_alternative(_cots(spark, sf_dir)),
        }
    )


@query(
    "split_counts",
    o.sql(
        o.EXAMPLES,
        """SELECT CASE WHEN example_ord % 10 = 0 THEN 'test' ELSE 'train' END split,
      count(*) "rows" FROM examples GROUP BY 1""",
    ),
)
def split_counts(spark, sf_dir):
    examples = inputs.examples(spark, sf_dir)
    split = F.when(F.col("example_ord") % 10 == 0, "test").otherwise("train")
    return datasets.split_counts(datasets.to_sft_original(examples, split))


@query(
    "graphs_from_answers",
    o.sql(
        o.RESULTS,
        f"""SELECT example_id, {o.as_json("segments")} segments, {o.as_json("clean_nodes")} nodes,
      {o.as_json("e")} edges, len(clean_nodes) > 0 AND len(e) > 0 success FROM faulty""",
    ),
)
def graphs_from_answers(spark, sf_dir):
    found = jobs.graphs_from_answers(inputs.examples(spark, sf_dir))
    return found.select(
        "example_id", inputs.as_json("segments"), inputs.as_json("nodes"), inputs.as_json("edges"), "success",
    )
