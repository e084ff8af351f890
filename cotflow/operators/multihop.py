"""Multi-hop question records: raw layouts to one shape, supporting sentences, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotflow.functions.lambdas import empty

FACTS = "array<struct<title:string,sent_id:int>>"
CONTEXT = "array<struct<title:string,sentences:array<string>>>"
PREVIEW = 100


def multihop_from_raw(raw: DataFrame) -> DataFrame:
    """Records whose facts and paragraphs are two-element lists; missing facts become []."""

    def fact(f: Column) -> Column:
        return F.struct(
            F.get(f, F.lit(0)).alias("title"), F.get(f, F.lit(1)).cast("int").alias("sent_id")
        )

    def paragraph(c: Column) -> Column:
        return F.struct(
            F.get(c, F.lit(0)).alias("title"),
            F.from_json(F.get(c, F.lit(1)), "array<string>").alias("sentences"),
        )

    return raw.select(
        F.col("_id").alias("id"), "question", "answer", "type", "level",
        F.coalesce(F.transform("supporting_facts", fact), empty(FACTS)).alias("supporting_facts"),
        F.transform("context", paragraph).alias("context"),
    )


def multihop_from_columnar(df: DataFrame) -> DataFrame:
    """Records whose facts and paragraphs are structs of parallel lists."""

    def zipped(name: str, second: str) -> Column:
        pairs = F.arrays_zip(F.col(name)["title"], F.col(name)[second])
        return F.transform(
            pairs, lambda p: F.struct(p["title"].alias("title"), p[second].alias(second))
        )

    return df.select(
        "id", "question", "answer", "type", "level",
        zipped("supporting_facts", "sent_id").alias("supporting_facts"),
        zipped("context", "sentences").alias("context"),
    )


def multihop_text(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("question").alias("problem_text"), F.col("answer").alias("answer_text"))


def supporting_sentences(facts: Column, context: Column) -> Column:
    """Facts with their sentence, in order; unknown titles and sentence numbers drop out.

    Of paragraphs with one title the last counts. Negative numbers index from the end.
    """

    def resolve(f: Column) -> Column:
        same = F.filter(context, lambda c: c["title"] == f["title"])
        sentences = F.try_element_at(same, F.lit(-1))["sentences"]
        at = F.when(f["sent_id"] < 0, f["sent_id"] + F.size(sentences)).otherwise(f["sent_id"])
        return F.struct(
            f["title"].alias("title"),
            f["sent_id"].alias("sent_id"),
            F.get(sentences, at).alias("sentence"),
        )

    return F.filter(F.transform(facts, resolve), lambda s: s["sentence"].isNotNull())


def supporting_context(df: DataFrame) -> DataFrame:
    found = supporting_sentences(F.col("supporting_facts"), F.col("context"))
    rows = df.select("id", F.posexplode(found).alias("at", "s"))
    return rows.select("id", (F.col("at") + 1).alias("fact_no"), "s.title", "s.sent_id", "s.sentence")


def profile_multihop(df: DataFrame) -> DataFrame:
    """One row per paragraph with a cut preview of its first sentence, and record counts."""
    rows = df.select(
        "id", "type", "level",
        F.size("supporting_facts").alias("facts"),
        F.size("context").alias("paragraphs"),
        F.posexplode_outer("context").alias("at", "p"),
    )
    first = F.get(F.col("p")["sentences"], F.lit(0))
    cut = F.concat(F.substring(first, 1, PREVIEW), F.lit("..."))
    return rows.select(
        "id", "type", "level", "facts", "paragraphs",
        (F.col("at") + 1).alias("paragraph_no"),
        F.col("p")["title"].alias("title"),
        F.size(F.col("p")["sentences"]).alias("sentences"),
        F.when(F.length(first) > PREVIEW, cut).otherwise(first).alias("preview"),
    )
