"""The queries of this package by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotflow.llm import (
    contamination, fill_middle, hard_negatives, language, line_crf, near_dup, packing, quality, quotes, sharding, substrings,
    toxicity, url_filter,
)
from cotflow.llm.frames import fold
from cotflow.sources.corpora import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def learnable(labels: DataFrame, parts: int, held_out: int) -> DataFrame:
    """The labels a classifier may learn from: those outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), parts) != held_out)


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = learnable(table(spark, sf_dir, "labels"), 5, 0)
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels))
    return scores.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.line_quality(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, lambda doc_id: fold(doc_id, 5) != 0)
    return language.predict_languages(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "accepted"
    )


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = learnable(table(spark, sf_dir, "labels"), 4, 2)
    scores = quality.score_documents(table(spark, sf_dir, "documents"), labels)
    return scores.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


# Words as the operators see them: runs of anything but space, tab to carriage return.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

CONTAINED = f"""
WITH items AS (
  SELECT item_id, {WORDS.format("lower(text)")} AS w FROM benchmark
), shingles AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS shingle
  FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k
        FROM items WHERE len(w) > 0)
), texts AS (
  SELECT doc_id, {WORDS.format("lower(text)")} AS w FROM documents
), windows AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM texts, (SELECT DISTINCT n FROM shingles))
), sizes AS (
  SELECT item_id, count(*) AS total FROM shingles GROUP BY item_id
)
SELECT doc_id, item_id, count(*) / any_value(total) AS containment
FROM windows JOIN shingles USING (n, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) >= 0.8 * any_value(total)
"""


@query(CONTAINED)
def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.keyed(table(spark, sf_dir, "documents"))
    placed = sharding.apply_plan(rows, sharding.plan_shards(rows, "size", 40))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), digest=True)


@query()
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


# Lines, passages and threads the relational way: numbered rows, running sums, recursion.
LINKED = r"""
WITH RECURSIVE one AS (
  SELECT conv_id, turn, min(text) AS text, min(role) AS role FROM conversations GROUP BY conv_id, turn
), messages AS (
  SELECT c.conv_id, c.turn, row_number() OVER () AS message,
    coalesce(c.text, '') || coalesce(
      chr(10) || chr(10) || a.role || ' wrote:' || chr(10) || '> ' || replace(a.text, chr(10), chr(10) || '> ')
      || coalesce(chr(10) || '> ' || b.role || ' wrote:' || chr(10) || '>> '
                  || replace(b.text, chr(10), chr(10) || '>> '), ''), '') AS text
  FROM conversations c
  LEFT JOIN one a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 - (c.turn % 3 = 2)::INT
  LEFT JOIN one b ON b.conv_id = c.conv_id AND b.turn =
    (c.turn - 1 - (c.turn % 3 = 2)::INT) - 1 - ((c.turn - 1 - (c.turn % 3 = 2)::INT) % 3 = 2)::INT
), numbered AS (
  SELECT message, conv_id, turn, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n
  FROM messages
), levels AS (
  SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, line[length(marks) + 1 :] AS said
  FROM (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+') AS marks FROM numbered)
), introduced AS (
  SELECT *, regexp_matches(said, '(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$')
    AND coalesce(lead(level) OVER (PARTITION BY message ORDER BY n) > level, false) AS intro
  FROM levels
), marked AS (
  SELECT *, coalesce(lag(level) OVER w = level AND trim(lag(content) OVER w) <> '' AND trim(content) <> '', false) AS goes_on
  FROM (SELECT *, CASE WHEN intro THEN '' ELSE said END AS content FROM introduced) WINDOW w AS (PARTITION BY message ORDER BY n)
), runs AS (
  SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY message ORDER BY n) AS run FROM marked
), said AS (
  SELECT message, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(level) AS level,
    trim(regexp_replace(lower(string_agg(content, chr(10) ORDER BY n)), '[ \t\n\x0b\x0c]+', ' ', 'g')) AS passage
  FROM runs GROUP BY message, run
), originals AS (
  SELECT conv_id, passage, min(turn) AS original FROM said WHERE level = 0 AND passage <> '' GROUP BY conv_id, passage
), linked AS (
  SELECT message, count(*) AS n_quoted, count(*) FILTER (original < turn) AS n_linked,
    max(original) FILTER (original < turn AND level = 1) AS parent_turn
  FROM said LEFT JOIN originals USING (conv_id, passage)
  WHERE level > 0 AND passage <> ''
  GROUP BY message
), own AS (
  SELECT message, regexp_replace(string_agg(content, chr(10) ORDER BY n) FILTER (level = 0 AND NOT intro), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS own_text
  FROM marked GROUP BY message
), known AS (
  SELECT m.conv_id, m.turn, l.parent_turn, coalesce(l.n_quoted, 0) AS n_quoted, coalesce(l.n_linked, 0) AS n_linked,
    coalesce(o.own_text, '') AS own_text
  FROM messages m LEFT JOIN linked l USING (message) LEFT JOIN own o USING (message)
), up AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM known WHERE parent_turn IS NULL
  UNION ALL
  SELECT k.conv_id, k.turn, up.thread, up.depth + 1 FROM known k JOIN up ON k.conv_id = up.conv_id AND k.parent_turn = up.turn
)
SELECT conv_id, turn, thread, parent_turn, depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS position, n_quoted, n_linked, own_text
FROM known JOIN up USING (conv_id, turn)
"""


@query(LINKED)
def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the given conversations quote nothing, so they are written as replies first."""
    return quotes.link_quotes(quotes.quoting_messages(table(spark, sf_dir, "conversations")))


# Lines by number, as an array per document.
CUT = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS line,
    sha256('7:' || doc_id) AS h
  FROM documents
), drawn AS (
  SELECT *, len(line) AS n, ('0x' || h[1:8])::BIGINT % (len(line) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(line) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lines
), parts AS (
  SELECT *, array_to_string(line[1 : least(a, b)], '') AS prefix,
    array_to_string(line[least(a, b) + 1 : greatest(a, b)], '') AS middle,
    array_to_string(line[greatest(a, b) + 1 : n], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query(CUT)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


JUDGED = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), listed AS (
  SELECT host || path AS address FROM parts WHERE host <> '' GROUP BY ALL HAVING count(*) > 1
), ruled AS (
  SELECT *, host || path IN (SELECT address FROM listed) AND host <> '' AS on_list,
    CASE
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN on_list THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query(JUDGED)
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.listing_addresses(pages))


MINED = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query(MINED)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, lambda vec_id: vec_id % 100 == 0)
