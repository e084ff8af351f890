"""Common table expressions that derive the same corpora in SQL."""

from cotflow.sources.corpora import MAX_STEPS, STYLES

NL = "chr(10)"
STYLE_LIST = "[" + ", ".join(f"'{s}'" for s in STYLES) + "]"


def style(key: str) -> str:
    return f"{STYLE_LIST}[({key} % {len(STYLES)})::INT + 1]"


def loose(text: str) -> str:
    pattern = r"'####\s*([0-9,.-]+)'"
    return (
        f"CASE WHEN regexp_matches({text}, {pattern}) "
        f"THEN replace(regexp_extract({text}, {pattern}, 1), ',', '') END"
    )


def strict(text: str) -> str:
    pattern = r"'(?m)#### (\-?[0-9,]+\.?[0-9]*)\s*$'"
    return (
        f"CASE WHEN regexp_matches({text}, {pattern}) "
        f"THEN replace(regexp_extract({text}, {pattern}, 1), ',', '') ELSE '[invalid]' END"
    )


def normalized(value: str) -> str:
    bare = f"replace(replace({value}, ',', ''), ' ', '')"
    number = f"try_cast({bare} AS DOUBLE)"
    return (
        f"CASE WHEN {value} IS NULL OR {value} IN ('', '[invalid]') OR {number} IS NULL THEN '' "
        f"WHEN {number} = 0 THEN '0' "
        f"WHEN {number} = floor({number}) THEN ({number})::BIGINT::VARCHAR "
        f"ELSE regexp_replace(printf('%.6f', {number}), '\\.?0+$', '') END"
    )


def tag(text: str, name: str) -> str:
    pattern = rf"'(?s)<{name}>\s*(.*?)\s*</{name}>'"
    return (
        f"CASE WHEN regexp_matches({text}, {pattern}) "
        f"THEN regexp_extract({text}, {pattern}, 1) END"
    )


SEGMENT_JSON = """'[{"id":"VARCHAR","text":"VARCHAR","is_required":"INTEGER"}]'"""
NODE_JSON = """'[{"id":"VARCHAR","text":"VARCHAR"}]'"""
EDGE_JSON = """'[["VARCHAR"]]'"""


def parsed(text: str, shape: str) -> str:
    # DuckDB takes a comma after the last entry, the JSON standard does not.
    is_list = f"CASE WHEN json_valid({text}) THEN json_type({text}::JSON) = 'ARRAY' AND NOT contains({text}, ',]') ELSE false END"
    return f"CASE WHEN {is_list} THEN from_json({text}::JSON, {shape}) END"


def as_json(value: str) -> str:
    return f"to_json({value})::VARCHAR"


EXAMPLES = f"""
steps0 AS (
  SELECT o_orderkey k, o_custkey c, o_custkey % 997 + 11 base, j::BIGINT j
  FROM orders, unnest(range(1, (o_orderkey % {MAX_STEPS} + 2)::BIGINT)) t(j)),
steps1 AS (
  SELECT *, base * (1::BIGINT << j::INT) + j x, (c + (k % 13) * j) % j first_at,
         (k // 7 + j * 3) % (j + 2) second_at FROM steps0),
steps2 AS (
  SELECT *, CASE WHEN first_at > 0 THEN base * (1::BIGINT << first_at::INT) + first_at END a,
         CASE WHEN second_at > 0 AND second_at < j AND second_at <> first_at
              THEN base * (1::BIGINT << second_at::INT) + second_at END b FROM steps1),
steps3 AS (
  SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN j + 2 END z FROM steps2),
steps4 AS (
  SELECT *, x - coalesce(a, 0) - coalesce(b, 0) - coalesce(z, 0) r FROM steps3),
lines AS (
  SELECT k, j, x,
    CASE WHEN (k + j) % 6 = 0 THEN 'So ' WHEN (k + j) % 11 = 0 THEN 'This gives ' ELSE '' END
    || 'step ' || j || ': ' || concat_ws(' + ', z, a, b, r) || ' = <<'
    || concat_ws('+', z, a, b, r) || '=' || x || '>>' || format('{{:,}}', x) || ' units' line
  FROM steps4),
bodies AS (
  SELECT k, string_agg(line, {NL} ORDER BY j) body, max_by(x, j) total, max(j) n
  FROM lines GROUP BY k),
ex0 AS (
  SELECT o.*, body, total, n, CASE k % 9
      WHEN 0 THEN '#### ' || format('{{:,}}', total) WHEN 1 THEN '#### -' || total
      WHEN 2 THEN '####' || total WHEN 3 THEN '#### ' || total || '.50'
      WHEN 4 THEN '#### ' || total || 'abc' WHEN 6 THEN '#### ' || total || '  ' || {NL} || 'Done.'
      WHEN 7 THEN '#### ' || total || '.' WHEN 8 THEN '#### ' || total END ending
  FROM bodies JOIN orders o ON o.o_orderkey = k),
ex1 AS (
  SELECT o_orderkey example_ord, 'orders_train_' || o_orderkey example_id,
    'How many units does customer ' || o_custkey || ' get after ' || n || ' steps ('
      || o_orderpriority || ')?' question,
    concat_ws({NL}, CASE WHEN o_orderkey % 5 = 0
      THEN 'We count the units of order ' || o_orderkey || '.' END, body, ending) answer,
    {style("o_orderkey")} style FROM ex0),
examples AS (SELECT *, {loose("answer")} final_answer FROM ex1)"""

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"

RESULTS = EXAMPLES + rf""",
seg0 AS (
  SELECT *, list_filter(list_transform(string_split(answer, {NL}),
      lambda x: trim(regexp_replace(x, '<<[^>]*>>', '', 'g'))),
      lambda x: x <> '' AND NOT starts_with(x, '####')) texts FROM examples),
seg AS (
  SELECT * EXCLUDE (texts), list_transform(texts, lambda x, i: {{'id': 's' || i, 'text': x,
      'is_required': CASE WHEN contains(x, '=') THEN 1 ELSE 0 END}}) segments FROM seg0),
drafted AS (
  SELECT *, list_filter(segments, lambda s: s.is_required = 1) required_segments,
    list_transform(list_filter(segments, lambda s: s.is_required = 1),
      lambda s, i: {{'id': 's' || i, 'text': s.text}}) clean_nodes FROM seg),
nodes0 AS (
  SELECT example_ord, unnest(clean_nodes, recursive := true),
    generate_subscripts(clean_nodes, 1) place FROM drafted),
made AS (
  SELECT example_ord, place, id, replace(unnest(
    regexp_extract_all(text, '=\s*\$?({NUMBER})', 1)), ',', '') v FROM nodes0),
used AS (
  SELECT example_ord, place, id, replace(unnest(regexp_extract_all(
    regexp_replace(text, '=\s*\$?({NUMBER})', '=', 'g'), '({NUMBER})', 1)), ',', '') v FROM nodes0),
links AS (
  SELECT DISTINCT m.example_ord, m.place src_at, u.place dst_at, m.id src, u.id dst
  FROM made m JOIN used u ON u.example_ord = m.example_ord AND u.v = m.v AND m.place < u.place),
linked AS (
  SELECT example_ord, list([src, dst] ORDER BY src_at, dst_at) clean_edges FROM links
  GROUP BY example_ord),
faulty AS (
  SELECT d.*, coalesce(clean_edges, []::VARCHAR[][]) e, example_ord % 23 fault,
    's' || len(clean_nodes) last_id
  FROM drafted d LEFT JOIN linked USING (example_ord)),
results AS (
  SELECT example_ord, example_id, question, answer, final_answer, style,
    regexp_replace(answer, '<<[^>]*>>', '', 'g') cot, segments, required_segments,
    CASE fault WHEN 5 THEN list_append(clean_nodes, {{'id': 's1', 'text': 'again'}})
      WHEN 7 THEN [] ELSE clean_nodes END nodes,
    CASE fault WHEN 1 THEN list_append(e, [last_id, 's1']) WHEN 2 THEN list_append(e, ['s1', 's99'])
      WHEN 3 THEN list_append(e, ['s1']) WHEN 4 THEN list_append(e, ['s1', 's1'])
      WHEN 8 THEN list_concat(e, e) ELSE e END edges,
    example_ord % 31 <> 3 success,
    CASE WHEN style IN ('direct', 'reasoning_only_direct') THEN 'direct_answer_segmentation'
      ELSE 'normal_with_cot_generation' END pipeline_type
  FROM faulty)"""

RESPONSES = RESULTS + f""",
rendered AS (
  SELECT example_id, example_ord k, pipeline_type,
    CASE WHEN example_ord % 17 = 2 THEN '' ELSE cot END cot_body,
    to_json(segments)::VARCHAR segs, to_json(nodes)::VARCHAR ns, to_json(edges)::VARCHAR es
  FROM results),
responses AS (
  SELECT example_id, 'cot' stage, 'Here it is:' || {NL} || '<cot>' || {NL} || cot_body
    || CASE WHEN k % 17 <> 1 THEN {NL} || '</cot>' ELSE '' END response
  FROM rendered WHERE pipeline_type = 'normal_with_cot_generation'
  UNION ALL
  SELECT example_id, 'segments', CASE WHEN k % 19 = 2 THEN segs ELSE '<segments>' || {NL}
    || CASE k % 19 WHEN 1 THEN left(segs, -1) WHEN 3 THEN '[]' WHEN 4 THEN segs || ' and so on'
       WHEN 5 THEN replace(replace(segs, '"is_required":1', '"is_required":true'), '"is_required":0', '"is_required":false')
       WHEN 6 THEN replace(segs, '"', chr(39)) WHEN 7 THEN '{{"list":' || segs || '}}' WHEN 8 THEN left(segs, -1) || ',]'
       ELSE segs END || {NL} || '</segments>' END FROM rendered
  UNION ALL
  SELECT example_id, 'graph', '<nodes>' || {NL} || CASE k % 37 WHEN 5 THEN replace(ns, '"', chr(39)) WHEN 6 THEN '{{"n":' || ns || '}}'
      WHEN 7 THEN left(ns, -1) || ',]' ELSE ns END || {NL} || '</nodes>' || {NL} || {NL}
    || '<edges>' || {NL} || es || CASE WHEN k % 23 <> 6 THEN {NL} || '</edges>' ELSE '' END
  FROM rendered WHERE k % 29 <> 5)"""

# Graphs of the results: node ordinals by first appearance, distinct valid edges.
GRAPHS = RESULTS + """,
inputs AS (
  SELECT *, coalesce(success AND len(nodes) > 0 AND len(edges) > 0, false) valid FROM results),
node_rows AS (
  SELECT example_ord, unnest(nodes, recursive := true), generate_subscripts(nodes, 1) place
  FROM inputs WHERE valid),
node_ids AS (
  SELECT example_ord, id, row_number() OVER (PARTITION BY example_ord ORDER BY min(place)) - 1 v,
    max_by(text, place) text FROM node_rows GROUP BY example_ord, id),
edge_rows AS (SELECT example_ord, unnest(edges) e FROM inputs WHERE valid),
edge_ids AS (
  SELECT DISTINCT r.example_ord, a.v src, b.v dst, a.id src_id, b.id dst_id
  FROM edge_rows r JOIN node_ids a ON a.example_ord = r.example_ord AND a.id = r.e[1]
  JOIN node_ids b ON b.example_ord = r.example_ord AND b.id = r.e[2] WHERE len(r.e) = 2),
reach AS (
  SELECT example_ord, src, dst FROM edge_ids
  UNION
  SELECT r.example_ord, r.src, e.dst FROM reach r
  JOIN edge_ids e ON e.example_ord = r.example_ord AND e.src = r.dst),
cyclic AS (SELECT DISTINCT example_ord FROM reach WHERE src = dst),
shape AS (
  SELECT n.example_ord, n.nodes, coalesce(e.edges, 0) edges, s.sources, t.sinks,
    coalesce(e.edges, 0) / greatest(n.nodes - 1, 1) ratio,
    n.example_ord NOT IN (SELECT example_ord FROM cyclic) acyclic
  FROM (SELECT example_ord, count(*) nodes FROM node_ids GROUP BY 1) n
  LEFT JOIN (SELECT example_ord, count(*) edges FROM edge_ids GROUP BY 1) e USING (example_ord)
  LEFT JOIN (SELECT example_ord, count(*) sources FROM node_ids n WHERE NOT EXISTS (
      SELECT 1 FROM edge_ids e WHERE e.example_ord = n.example_ord AND e.dst = n.v)
      GROUP BY 1) s USING (example_ord)
  LEFT JOIN (SELECT example_ord, count(*) sinks FROM node_ids n WHERE NOT EXISTS (
      SELECT 1 FROM edge_ids e WHERE e.example_ord = n.example_ord AND e.src = n.v)
      GROUP BY 1) t USING (example_ord)),
labelled AS (
  SELECT *, CASE WHEN ratio >= 2 THEN 'LOW' WHEN ratio >= 1 THEN 'MEDIUM'
      WHEN ratio >= 0.5 THEN 'HIGH' ELSE 'VERY HIGH' END complexity FROM shape),
slots AS (
  SELECT n.example_ord, n.v, (1::BIGINT << n.v::INT) AS bit_v,
    coalesce(bit_or(1::BIGINT << e.src::INT), 0) before
  FROM node_ids n LEFT JOIN edge_ids e ON e.example_ord = n.example_ord AND e.dst = n.v
  GROUP BY ALL)"""


# Graphs of all lines of a document; placed lines are bit strings as long as the document.
LINE_GRAPHS = f"""
doc_lines AS (
  SELECT doc_id k, len(list_filter(string_split(text, {NL}), lambda x: x <> '')) n FROM documents WHERE text IS NOT NULL),
line_edges AS (
  SELECT DISTINCT k, a, b FROM (
    SELECT k, i // 2 - 1 a, i - 1 b FROM doc_lines, unnest(range(2, n + 1)) t(i) WHERE k % 3 <> 0
    UNION ALL SELECT k, i - 2, i - 1 FROM doc_lines, unnest(range(2, n + 1)) t(i) WHERE (k + i) % 3 = 0
    UNION ALL SELECT k, n - 1, 0 FROM doc_lines WHERE k % 23 = 1 AND n > 1)),
line_reach AS (
  SELECT k, a, b FROM line_edges
  UNION SELECT r.k, r.a, e.b FROM line_reach r JOIN line_edges e ON e.k = r.k AND e.a = r.b),
line_docs AS (
  SELECT k, n FROM doc_lines WHERE k IN (SELECT k FROM line_edges) AND k NOT IN (SELECT k FROM line_reach WHERE a = b)),
line_slots AS (
  SELECT d.k, d.n, v, coalesce(bit_or(set_bit(bitstring('0', d.n::INT), e.a::INT, 1)), bitstring('0', d.n::INT)) before
  FROM line_docs d, unnest(range(0, d.n)) t(v) LEFT JOIN line_edges e ON e.k = d.k AND e.b = v GROUP BY d.k, d.n, v)"""

LINE_ORDERINGS = """,
line_walk AS (
  SELECT k, n, 0 lvl, bitstring('0', n::INT) placed, []::BIGINT[] path FROM line_docs
  UNION ALL
  SELECT w.k, w.n, lvl + 1, set_bit(placed, v::INT, 1), list_append(path, v)
  FROM line_walk w JOIN line_slots s ON s.k = w.k
  WHERE get_bit(placed, v::INT) = 0 AND (placed & before) = before
  QUALIFY row_number() OVER (PARTITION BY w.k ORDER BY list_append(path, v)) <= {cap}),
line_paths AS (
  SELECT k, path, row_number() OVER (PARTITION BY k ORDER BY path) path_no FROM line_walk WHERE lvl = n)"""

LINE_SAMPLES = """,
line_ready AS (SELECT k, n, list({{'v': v, 'p': before}} ORDER BY v) ready FROM line_slots GROUP BY ALL),
line_walk AS (
  SELECT k, attempt, n, 0 lvl, bitstring('0', n::INT) placed, []::BIGINT[] path, ready,
    ('0x' || substr(md5('{seed}|documents_train_' || k || '|' || attempt), 1, 8))::BIGINT % 2147483646 + 1 rng
  FROM line_ready, range(1, {attempts} + 1) t(attempt)
  UNION ALL
  SELECT k, attempt, n, lvl + 1, set_bit(placed, pick.v::INT, 1), list_append(path, pick.v), ready, rng * 48271 % 2147483647
  FROM (SELECT *, list_filter(ready, lambda s: get_bit(placed, s.v::INT) = 0 AND (placed & s.p) = s.p) open
        FROM line_walk WHERE lvl < n) w, LATERAL (SELECT open[(rng % len(open))::INT + 1] pick)),
line_first AS (SELECT k, path, min(attempt) attempt FROM line_walk WHERE lvl = n GROUP BY k, path),
line_ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY attempt) path_no FROM line_first),
line_paths AS (SELECT k, path, path_no FROM line_ranked WHERE path_no <= {n})"""


def orderings(where: str = "acyclic", name: str = "orderings") -> str:
    """All orderings of the graphs that satisfy ``where``, as lists of node ordinals."""
    return f""",
{name}_walk AS (
  SELECT example_ord, nodes, 0 lvl, 0::BIGINT placed, []::BIGINT[] path FROM labelled WHERE {where}
  UNION ALL
  SELECT w.example_ord, w.nodes, lvl + 1, placed | bit_v, list_append(path, v)
  FROM {name}_walk w JOIN slots s ON s.example_ord = w.example_ord
  WHERE placed & (bit_v | before) = before),
{name} AS (
  SELECT example_ord, path, row_number() OVER (PARTITION BY example_ord ORDER BY path) path_no
  FROM {name}_walk WHERE lvl = nodes)"""


def samples(n: int, seed: int, where: str, name: str = "samples") -> str:
    """The first n distinct of 5n random orderings per graph that satisfies ``where``."""
    return f""",
{name}_walk AS (
  SELECT example_ord, attempt, nodes, 0 lvl, 0::BIGINT placed, []::BIGINT[] path, ready,
    ('0x' || substr(md5('{seed}|orders_train_' || example_ord || '|' || attempt), 1, 8))::BIGINT
      % 2147483646 + 1 rng
  FROM labelled JOIN (SELECT example_ord, list({{'v': v, 'b': bit_v, 'p': before}} ORDER BY v) ready
    FROM slots GROUP BY 1) USING (example_ord), range(1, {5 * n + 1}) t(attempt) WHERE {where}
  UNION ALL
  SELECT example_ord, attempt, nodes, lvl + 1, placed | pick.b, list_append(path, pick.v), ready,
    rng * 48271 % 2147483647
  FROM (SELECT *, list_filter(ready, lambda s: placed & (s.b | s.p) = s.p) open FROM {name}_walk
        WHERE lvl < nodes) w, LATERAL (SELECT open[(rng % len(open))::INT + 1] pick)),
{name}_first AS (
  SELECT example_ord, path, min(attempt) attempt FROM {name}_walk WHERE lvl = nodes
  GROUP BY example_ord, path),
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY example_ord ORDER BY attempt) path_no
  FROM {name}_first),
{name} AS (SELECT example_ord, path, path_no FROM {name}_ranked WHERE path_no <= {n})"""


# Paths as the chain-of-thought run makes them: capped enumeration or samples.
PATHS = (
    GRAPHS
    + orderings("acyclic AND complexity IN ('LOW', 'MEDIUM')", "exhaustive")
    + samples(50, 0, "acyclic AND complexity IN ('HIGH', 'VERY HIGH')", "sampled")
    + """,
all_paths AS (
  SELECT x.* FROM exhaustive x JOIN labelled l USING (example_ord)
  WHERE path_no <= CASE complexity WHEN 'MEDIUM' THEN 100 ELSE 200 END
  UNION ALL SELECT * FROM sampled),
counts AS (SELECT example_ord, count(*) total_paths FROM all_paths GROUP BY 1),
paths AS (
  SELECT i.example_ord, i.example_id,
    CASE WHEN NOT valid THEN 'Invalid input' WHEN NOT acyclic THEN 'Graph contains cycles' END error,
    CASE WHEN acyclic THEN complexity END complexity,
    CASE WHEN acyclic THEN CASE WHEN complexity IN ('HIGH', 'VERY HIGH') THEN 'sampling'
      ELSE 'exhaustive' END END AS method,
    CASE WHEN acyclic THEN l.nodes END node_count, total_paths
  FROM inputs i LEFT JOIN labelled l USING (example_ord) LEFT JOIN counts USING (example_ord)),
path_steps AS (
  SELECT a.example_ord, a.path_no, s.pos, n.id step, n.text
  FROM all_paths a, LATERAL (SELECT unnest(a.path) v, generate_subscripts(a.path, 1) - 1 pos) s
  JOIN node_ids n ON n.example_ord = a.example_ord AND n.v = s.v),
spelled AS (
  SELECT example_ord, path_no, string_agg(step, ' → ' ORDER BY pos) sequence,
    string_agg(text, chr(10) ORDER BY pos) texts FROM path_steps GROUP BY 1, 2),
positions AS (
  SELECT example_ord, step, min(pos) min_pos, max(pos) max_pos, count(DISTINCT pos) positions,
    count(*) occurrences, min(CASE WHEN path_no = 1 THEN pos END) first_path_pos,
    any_value(node_count) - 1 last_pos
  FROM path_steps JOIN paths USING (example_ord) WHERE total_paths > 1 GROUP BY 1, 2)"""
)

DOCUMENT_SEGMENTS = f"""
doc0 AS (
  SELECT doc_id k, text cot, list_filter(string_split(text, {NL}), lambda x: x <> '') lines
  FROM documents),
doc AS (
  SELECT k, 'documents_train_' || k example_id, {style("k")} style, cot,
    list_transform(lines, lambda x, i: {{
      'id': 's' || (i + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END),
      'text': CASE WHEN (k + i - 1) % 13 = 0 THEN x || '!' WHEN (k + i - 1) % 17 = 5 AND i > 1
        THEN substr(lines[i - 1], length(lines[i - 1]) // 2 + 1) ELSE x END,
      'is_required': CASE WHEN length(x) % 3 = 2 THEN NULL ELSE length(x) % 3 END}}) segments
  FROM doc0),
doc_rows AS (
  SELECT k, example_id, style, cot, unnest(segments, recursive := true),
    generate_subscripts(segments, 1) place, len(segments) n FROM doc)"""

TURNS = f"""
turns AS (
  SELECT 'conversations_train_' || u.conv_id || '_' || u.turn example_id, u.text question,
    a.text answer, {loose("a.text")} final_answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

MULTIHOP = f"""
mh0 AS (
  SELECT doc_id k, 'd' || doc_id id, lang, source,
    list_filter(string_split(text, {NL}), lambda x: x <> '') lines FROM documents),
mh AS (
  SELECT k, id, lines[1] question, CASE WHEN k % 5 <> 0 THEN lang END answer,
    CASE WHEN k % 4 <> 0 THEN 'bridge' END AS type, source AS level,
    CASE WHEN k % 8 <> 0 THEN list_transform([1, 2, 3, 4], lambda i:
      {{'title': 'T' || ((k + i) % 6), 'sent_id': (k * i % 4 - 1)::INT}})
      ELSE [] END facts,
    list_transform(lines, lambda x, i:
      {{'title': 'T' || ((i - 1) % 5), 'sentences': string_split(x, '. ')}}) context FROM mh0)"""

TOOLS = """
raw_tools AS (
  SELECT event_id id, 'What did user ' || user_id || ' do?' AS query,
    '[{"name":"' || event_type || '","description":"user ' || user_id || '"},{"parameters":'
      || props || '}]' t,
    '[{"name":"' || event_type || '","arguments":' || props || '},{"name":"log"}]' c FROM events),
tool_rows AS (
  SELECT id, query,
    CASE WHEN id % 11 = 0 THEN left(t, -1) WHEN id % 13 = 0 THEN '' WHEN id % 29 = 1 THEN replace(t, '"', chr(39))
      WHEN id % 29 = 2 THEN '{"tools":' || t || '}' WHEN id % 29 = 3 THEN left(t, -1) || ',]' ELSE t END tools,
    CASE WHEN id % 17 = 0 THEN c || ' done' WHEN id % 19 = 0 THEN '' WHEN id % 31 = 4 THEN left(c, -1) || ',]'
      WHEN id % 31 = 5 THEN 'true' ELSE c END answers
  FROM raw_tools),
checked AS (
  SELECT *, CASE WHEN tools = '' THEN '[]' WHEN contains(tools, ',]') THEN '[' ELSE tools END t,
    CASE WHEN answers = '' THEN '[]' WHEN contains(answers, ',]') THEN '[' ELSE answers END c FROM tool_rows),
tool_lists AS (
  SELECT id, query,
    CASE WHEN CASE WHEN json_valid(t) AND json_valid(c) THEN json_type(t::JSON) = 'ARRAY' ELSE false END THEN from_json(t::JSON,
      '[{"name":"VARCHAR","description":"VARCHAR","parameters":"JSON"}]') ELSE [] END tools,
    CASE WHEN CASE WHEN json_valid(t) AND json_valid(c) THEN json_type(c::JSON) = 'ARRAY' ELSE false END THEN from_json(c::JSON,
      '[{"name":"VARCHAR","arguments":"JSON"}]') ELSE [] END calls FROM checked)"""

SFT_IDS = """
sft_ids AS (
  SELECT f AS file, CASE WHEN doc_id % 101 <> 7 THEN doc_id::VARCHAR END id
  FROM documents, LATERAL (SELECT unnest([
    CASE WHEN doc_id % 97 <> 1 THEN 'original.jsonl' END,
    CASE WHEN doc_id % 89 <> 2 THEN 'alternative_cots_direct.jsonl' END,
    CASE WHEN doc_id % 83 <> 3 THEN 'alternative_cots_regular.jsonl' END]) f) WHERE f IS NOT NULL)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"


def select_of(statement: str, ctes: str) -> str:
    """What a statement made by ``sql`` selects."""
    head = sql(ctes, "")
    if not statement.startswith(head):
        raise ValueError("the statement has other expressions")
    return statement[len(head) :]
