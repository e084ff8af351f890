"""Every operator against its definition, on odd rows and on given tables."""

from __future__ import annotations

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from cotflow import session  # noqa: E402
from cotflow.llm import (  # noqa: E402
    contamination, language, line_crf, near_dup, packing, quality, quotes, sharding, substrings, toxicity,
)
from cotflow.llm.frames import fold  # noqa: E402
from cotflow.llm.queries import QUERIES, SQL  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

TINY, SMALL, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))

# Columns that an operator might use itself.
CLASH = ["id", "score", "shard", "slot", "unit", "part", "key", "class_id", "n_words", "message", "digest", "ids"]


def vocabulary(seed, n=3000):
    draws = random.Random(seed)
    return ["".join(draws.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draws.randint(2, 9))) for _ in range(n)]


def sentence(draws, words, n):
    return " ".join(draws.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Ids, nulls, blanks, a long text, ties, copies, near copies and shared passages."""
    draws, words = random.Random(1), vocabulary(2)
    passage = sentence(draws, words, 60)
    base = sentence(draws, words, 300)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "one two"), (6, "!!! 123 ...")]
    rows += [(7, sentence(draws, words, 30_000)), (8, "x " * 500), (9, "a\n" * 40), (10, "\n" * 100)]
    rows += [(11 + i, base) for i in range(30)]
    for i in range(30):
        edited = base.split()
        edited[draws.randrange(300)] = f"new{i}"
        rows.append((50 + i, "\n".join([" ".join(edited[:150]), " ".join(edited[150:])])))
    rows += [(100 + i, f"{sentence(draws, words, 80)}  {passage}\n{sentence(draws, words, 80)}") for i in range(20)]
    rows += [(200 + i, sentence(draws, words, draws.randint(1, 200))) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame([(*r, "en" if r[0] % 2 else "fr") for r in odd_rows], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("mine") for c in CLASH}).repartition(5)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def messy(odd):
    """Repeated rows and rows without an id."""
    again = odd.where("doc_id % 3 = 0")
    return odd.unionByName(again).unionByName(again.withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def labels(spark, odd_rows):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in odd_rows] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(spark, sf_dir):
    return [tuple(r) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare.differences(compare.connect(TINY), spark, TINY, QUERIES[name], SQL[name]) == []


# 1 line labels


def test_base_counts(spark, odd, odd_rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs, rows in ((odd, odd_rows), (documents(spark, TINY), texts_of(spark, TINY))):
        got = {r["doc_id"]: r for r in line_crf.line_quality(docs, line_crf.no_field()).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            assert tuple(got[doc_id][n] for n in names) == brute.base(text)
            # Weights of 0 call every line content.
            assert got[doc_id]["kept"] is not got[doc_id]["base_failed"]


def test_line_quality_learns_and_survives(spark, odd, messy, empty, labels):
    none = line_crf.fit(empty, labels)
    assert not none.emission.any() and line_crf.line_quality(empty, none).collect() == []
    model = line_crf.fit(messy, labels)
    assert line_crf.line_quality(messy, model).count() == messy.count()
    result = QUERIES["op1_line_quality"](spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id")
    right = result.where("NOT base_failed").agg(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("int"))).first()[0]
    assert right > 0.85


# 2 language


def test_language_holds_out(spark, odd, messy, empty):
    got = QUERIES["op2_language"](spark, SMALL).join(documents(spark, SMALL).select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() > 0.95 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    assert got.where((zlib_fold(5) == 0) != F.col("held_out")).count() == 0
    model = language.fit(odd, lambda doc_id: F.lit(True))
    rows = {r["doc_id"]: r for r in language.predict_languages(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 6, 10)] == ["und"] * 5 and rows[0]["score"] == 0
    assert rows[3]["lang_pred"] in ("en", "fr") and not rows[0]["accepted"]
    assert language.predict_languages(messy, model).count() == messy.count()
    assert language.fit(empty, lambda doc_id: F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict_languages(odd, None).collect()} == {"und"}


def zlib_fold(parts):
    return F.udf(lambda i: zlib.crc32(str(i).encode()) % parts, "long")(F.col("doc_id"))


def test_fold_is_crc32_of_the_decimal_text(spark):
    ids = [0, 1, 49, 123456789, -5]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect()
    assert {r["doc_id"]: r["f"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 for i in ids}


# 3 quotations


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, text string")


def test_quotes_link_to_their_messages(spark):
    rows = [
        (1, 0, "First   thing said.\n\nSecond thing."),
        (1, 1, "I agree.\n\nuser wrote:\n> First thing\n> said."),
        (1, 2, "Both?\n>> FIRST thing said.\n> I agree.\n\ntail"),
        (1, 3, "> never said by anyone"),
        (1, 4, ">> Second thing."),
        (2, 0, "> First thing said."),
        (2, 1, None),
        (None, None, "> Second thing.\nalone"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(conversation(spark, rows)).collect()}
    view = {k: (r["parent_turn"], r["thread"], r["depth"], r["n_quoted"], r["n_linked"], r["own_text"]) for k, r in got.items()}
    assert view == {
        (1, 0): (None, 0, 0, 0, 0, "First   thing said.\n\nSecond thing."),
        (1, 1): (0, 0, 1, 1, 1, "I agree."),
        (1, 2): (1, 0, 2, 2, 2, "Both?\n\ntail"),
        (1, 3): (None, 3, 0, 1, 0, ""),
        (1, 4): (None, 4, 0, 1, 1, ""),
        (2, 0): (None, 0, 0, 1, 0, ""),
        (2, 1): (None, 1, 0, 0, 0, ""),
        (None, None): (None, None, 0, 1, 0, "alone"),
    }
    assert [got[1, i]["position"] for i in range(5)] == [0, 1, 2, 3, 4]


def test_quotes_in_one_long_conversation(spark):
    """A chain of replies, repeated turns, and positions over several ranges."""
    rows = [(7, 0, "message 0")] + [(7, i, f"message {i}\n> message {i - 1}") for i in range(1, 300)]
    rows += [(7, 299, "message 299 again"), (8, 0, "x\x01y\x02z")]
    got = quotes.link_quotes(conversation(spark, rows).repartition(7)).collect()
    assert {(r["turn"], r["depth"]) for r in got if r["parent_turn"] is not None} == {(i, i) for i in range(1, 300)}
    assert sorted(r["position"] for r in got if r["conv_id"] == 7) == list(range(301))
    assert quotes.link_quotes(conversation(spark, [])).collect() == []


def test_conversation_queries_keep_every_turn(spark):
    turns = spark.read.parquet(f"{TINY}/conversations.parquet")
    result = QUERIES["op3_quotes"](spark, TINY)
    assert result.count() == turns.count()
    assert result.where("n_linked < n_quoted").count() < 0.2 * result.count()


# 4 toxicity


def test_toxicity_holds_out(spark):
    got = QUERIES["op4_toxicity"](spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out")
    caught, alarms = (got.where(f"toxic = {y}").agg(F.avg("predicted")).first()[0] for y in (1, 0))
    assert caught > 0.6 and alarms < 0.03
    assert got.where("score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.5)").count() == 0


def test_toxicity_survives(spark, odd, messy, empty, labels):
    assert toxicity.fit(empty, labels) is None
    assert toxicity.fit(odd, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.toxicity_scores(odd, None).collect()} == {0.0}
    model = toxicity.fit(messy, labels)
    scores = toxicity.toxicity_scores(messy, model)
    assert scores.count() == messy.count() and scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = toxicity.drop_toxic(messy, model)
    assert kept.columns == messy.columns and kept.count() == scores.where("score < 0.5").count()


# 5 substrings


def test_substrings_match_brute_force(spark, odd, odd_rows):
    want = {i: (len(w), sum(g), brute.digest(w, g)) for i, (w, g) in brute.kept_words(odd_rows).items()}
    got = substrings.deduplicated(odd, unit_bytes=3000, digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want and len(got) == len(want)


def test_cut_texts_keep_their_columns(spark, odd, odd_rows):
    want = brute.kept_words(odd_rows)
    got = substrings.cut_repeated(odd, unit_bytes=3000)
    assert got.columns == odd.columns
    texts = dict(odd_rows)
    for r in got.collect():
        found, gone = want[r["doc_id"]]
        assert r["id"] == "mine" and r["lang"] == ("en" if r["doc_id"] % 2 else "fr")
        if not any(gone):
            assert r["text"] == texts[r["doc_id"]]
        assert brute.words(r["text"]) == [w for w, g in zip(found, gone, strict=True) if not g]


def test_units_grow_with_the_table(spark, odd, odd_rows, monkeypatch):
    """Twice the table gives some twice the messages, not four times; the results stay."""
    draws, words = random.Random(5), vocabulary(300)
    rows = [(i, sentence(draws, words, 60)) for i in range(400)]
    monkeypatch.setattr(substrings, "UNIT_BYTES", 1000)
    monkeypatch.setattr(substrings, "RANGE_CELLS", 500)
    sent = []
    for units, n in ((8, 200), (8, 400), (10**9, 200), (10**9, 400)):
        monkeypatch.setattr(substrings, "UNITS", units)
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string").coalesce(1)
        stored, shape = substrings.stored_units(docs, 20, None, "doc_id", "text", [])
        sent.append(substrings.sketched(stored, shape).count())
    grown, more, fixed, many = sent
    assert more < 2.2 * grown and many > 2.5 * fixed
    monkeypatch.setattr(substrings, "UNITS", 8)
    want = {i: sum(g) for i, (_, g) in brute.kept_words(odd_rows).items()}
    assert {r["doc_id"]: r["n_removed"] for r in substrings.deduplicated(odd).collect()} == want


def test_sizes_of_units_and_buckets():
    assert [substrings.unit_size(n) for n in (0, 10**9, 4 * 10**9, 10**14)] == [1_000_000, 1_000_000, 4_000_000, 8_000_000]
    assert [substrings.bucket_count(n, 200) for n in (0, 64 * 10**9, 10**14)] == [200, 1000, 100_000]


def test_stored_units_are_dropped(spark, odd, monkeypatch):
    monkeypatch.setattr(session, "_STAGES", {})
    monkeypatch.setattr(session, "_TABLES", {})
    stored, _ = substrings.stored_units(odd, 20, None, "doc_id", "text", [])
    (name,) = session._TABLES[spark.sparkContext.applicationId]
    assert spark.catalog.tableExists(name) and stored.count()
    session.drop_stages(spark)
    assert not spark.catalog.tableExists(name)


def test_substrings_survive(spark, messy, empty):
    assert substrings.deduplicated(empty).collect() == []
    assert substrings.cut_repeated(empty).collect() == []
    got = substrings.deduplicated(messy, unit_bytes=5000)
    assert got.count() == messy.count()
    # One of the rows with the id 7 keeps the long text.
    assert sorted(r["n_removed"] for r in got.where("n_words = 30000").collect())[1:] == [30000] * (got.where("n_words = 30000").count() - 1)


# 6 packing


def check_pieces(rows, pieces, encode):
    """Every id lies in one piece; sequences are gapless and full, or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for doc_id, text in rows:
        ids = [*np.frombuffer(encode.encode(text or ""), "<u4").tolist(), 1]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_round_trip(spark, odd, odd_rows, messy, empty):
    encode = packing.Encoder(packing.default_tokenizer())
    check_pieces(odd_rows, packing.pack(odd).collect(), encode)
    check_pieces(texts_of(spark, TINY), QUERIES["op6_packing"](spark, TINY).collect(), encode)
    assert packing.pack(empty).collect() == []
    docs = messy.where("doc_id IS NULL").count()
    assert packing.pack(messy).where("doc_id IS NULL AND start = 0").count() == docs
    with_ids = packing.pack(odd.where("doc_id = 4"), with_ids=True).collect()
    assert sum((r["ids"] for r in sorted(with_ids, key=lambda r: r["start"])), []) == [*np.frombuffer(encode.encode("one two"), "<u4").tolist(), 1]


# 7 quality


def test_quality_holds_out(spark):
    got = QUERIES["op7_quality"](spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() > 0.93 * got.count()
    assert got.where((zlib_fold(4) == 2) != F.col("held_out")).count() == 0


def test_quality_survives(odd, messy, empty, labels):
    assert quality.score_documents(empty, labels).collect() == []
    assert {r["score"] for r in quality.score_documents(odd, labels.where("false")).collect()} == {0.0}
    assert {r["score"] for r in quality.score_documents(odd, labels.where("quality = 1")).collect()} == {1.0}
    scores = quality.score_documents(messy, labels)
    assert scores.count() == messy.count() and scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_normal_equations_are_those_of_the_whole(odd, labels):
    """Partition sums give the weights that one solve over all learning rows gives."""
    table = quality.measured(odd).cache()
    model = quality.fit(table, labels)
    rows = table.join(labels.dropna(), "doc_id").withColumn("c", quality.draw(F.col("doc_id"), F.lit("calibrates")) < 0.2)
    learn = rows.where("NOT c").collect()
    z = model.features(np.array([r["measures"] for r in learn]))
    y = np.array([r["quality"] for r in learn], float)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


# 8 shards


def check_shards(rows, shards, tolerance):
    sizes, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(shards))
    assert max(abs(sizes[i] - sum(sizes.values()) / shards) for i in range(shards)) <= tolerance
    return texts


@pytest.mark.parametrize("piece_rows", [sharding.PIECE_ROWS, 100])
def test_shards_have_equal_bytes(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(sharding, "PIECE_ROWS", piece_rows)
    rows = QUERIES["op8_sharding"](spark, LARGE).collect()
    total = sum(r["size"] for r in rows)
    # A splitter lies between documents: at most half of one off at either end.
    texts = check_shards(rows, 40, sharding.TOLERANCE * total / 40 + max(r["size"] for r in rows))
    assert len(rows) == 10_000 and sum(len(s) > 1 for s in texts.values()) <= 5


def test_shards_split_a_hot_text(spark, odd, messy, empty):
    hot = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i}") for i in range(6000)], "doc_id long, text string")
    rows = sharding.keyed(hot)
    found = sharding.apply_plan(rows, sharding.plan_shards(rows, "size", 7)).collect()
    texts = check_shards(found, 7, 60)
    assert max(map(len, texts.values())) >= 4 and sum(len(s) > 1 for s in texts.values()) <= 4
    assert sharding.shard_documents(empty, 3).collect() == []
    whole = sharding.shard_documents(messy, 3)
    assert whole.count() == messy.count() and {r["shard"] for r in whole.select("shard").distinct().collect()} <= {0, 1, 2}
    assert [c for c in whole.columns if c not in ("shard", "slot")] == [c for c in messy.columns if c not in ("shard", "slot")]
    one_id = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")
    assert sharding.shard_documents(one_id, 4).groupBy("shard").count().count() == 1


# 9 contamination


@pytest.mark.parametrize("bytes_copied", [contamination.BROADCAST_BYTES, 0])
def test_contained_items(spark, odd, odd_rows, messy, empty, monkeypatch, bytes_copied):
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", bytes_copied)
    long_text = dict(odd_rows)[7].split()
    items = [
        (0, None), (1, ""), (2, "one"), (3, "ONE two"), (4, " ".join(long_text[20_000:20_005])),
        (5, " ".join(long_text[5000:5040])), (6, " ".join(long_text[:18]) + " not there"), (7, "no such words at all anywhere"),
        (8, " ".join(long_text[100:140] + ["x"] * 30)), (9, "x x x x x x x"), (10, dict(odd_rows)[100]), (11, " ".join(long_text[5000:5040])),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(odd, benchmark).collect()}
    assert got == brute.contained(odd_rows, items)
    bad = {i for i, _ in got}
    kept = contamination.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, _ in odd_rows} - bad
    assert contamination.contained_items(empty, benchmark).collect() == []
    assert contamination.drop_contaminated(messy, benchmark.where("false")).count() == messy.count()
    null_ids = {r["item_id"] for r in contamination.contained_items(messy, benchmark).where("doc_id IS NULL").collect()}
    assert null_ids == {i for d, i in got if d % 3 == 0}


def test_filter_of_item_shingles(spark, monkeypatch):
    draws = np.random.default_rng(4)
    classes, hashes = draws.integers(-1, 12, 5000), draws.integers(-(2**63), 2**63, 5000)
    rows = spark.createDataFrame(pd.DataFrame({"size_class": classes.astype(np.int32), "hash": hashes}))
    strangers = draws.integers(0, 2**64, 100_000, dtype=np.uint64)
    for most, share in ((contamination.FILTER_WORDS, 0.02), (1024, 0.2)):
        monkeypatch.setattr(contamination, "FILTER_WORDS", most)
        bloom = contamination.item_filter(rows)
        assert len(bloom) <= most and contamination.passes(bloom, classes, hashes.view(np.uint64)).all()
        assert contamination.passes(bloom, np.zeros(len(strangers), int), strangers).mean() < share
    assert not contamination.item_filter(rows.where("false")).any()


@pytest.mark.parametrize("bytes_copied", [contamination.BROADCAST_BYTES, 0])
def test_contaminated_rows_go_one_by_one(spark, messy, monkeypatch, bytes_copied):
    """Clean rows stay whose id, or null id, a contaminated row has too."""
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", bytes_copied)
    items = [(3, "ONE two"), (9, "x x x x x x x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = messy.unionByName(messy.where("doc_id = 4").withColumn("text", F.lit("clean")))
    texts = [(i, r["text"]) for i, r in enumerate(rows.select("text").collect())]
    bad = {i for i, _ in brute.contained(texts, items)}
    kept = contamination.drop_contaminated(rows, benchmark)
    assert bad and kept.columns == rows.columns
    assert sorted(r["text"] or "" for r in kept.select("text").collect()) == sorted(t or "" for i, t in texts if i not in bad)


# 10 near duplicates


def test_near_duplicates_match_brute_force(spark, odd, odd_rows):
    for docs, rows in ((odd, odd_rows), (documents(spark, TINY), texts_of(spark, TINY))):
        got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
        assert got == brute.classes(rows)


def test_near_duplicate_chains_and_odd_tables(spark, messy, empty):
    """Neighbours in the chain are similar, its ends are not; still one class."""
    draws, words = random.Random(9), vocabulary(10)
    text = sentence(draws, words, 200).split()
    rows = []
    for i in range(40):
        rows.append((1000 - i, " ".join(text)))
        text[4 * i : 4 * i + 4] = [draws.choice(words) for _ in range(4)]
    chain = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dup.near_duplicates(chain).collect()} == set(brute.classes(rows).values())
    assert near_dup.near_duplicates(empty).collect() == []
    kept = near_dup.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    assert kept.where("doc_id IS NULL").count() == messy.where("doc_id IS NULL").count()
    assert kept.where("doc_id BETWEEN 11 AND 79").count() == 1


def test_near_duplicates_among_strangers(spark):
    """Pairs over the threshold that share with each other what they share with 1,500 strangers of
    0.75 to 0.79 with smaller ids."""
    draws, words = random.Random(19), vocabulary(20)
    rows = []
    for group in range(3):
        template, at = sentence(draws, words, 258), 10_000 * group
        rows += [(at + i, f"{template} {sentence(draws, words, 42)}") for i in range(1500)]
        rows += [(at + 5000 + i, f"{template} {sentence(draws, words, 30)}") for i in range(2)]
    counts = {i: brute.shingles(t) for i, t in rows}
    for x in (5000, 15_000, 25_000):
        assert brute.probability_jaccard(counts[x], counts[x + 1]) >= 0.8
        assert 0.7 < brute.probability_jaccard(counts[x - 5000], counts[x]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: i - (i % 10_000 == 5001) for i in counts}


def test_groups_of_many_strangers_are_refined(spark):
    """Edited copies of a few texts, many of them just under the threshold of each other."""
    draws, words = random.Random(29), vocabulary(30)
    rows = []
    for group in range(6):
        text = sentence(draws, words, 120).split()
        for i in range(40):
            edited = list(text)
            for at in draws.sample(range(120), draws.randint(0, 5)):
                edited[at] = draws.choice(words)
            rows.append((1000 - 40 * group - i, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute.classes(rows)


def test_pairs_to_verify_stay_few(spark, monkeypatch):
    """Copies with five random edits each, nearly all pairs of them alike by 0.6 to 0.8."""
    draws, words, n = random.Random(31), vocabulary(32), 250
    text = sentence(draws, words, 300).split()
    rows = []
    for i in range(n):
        edited = list(text)
        for at in draws.sample(range(300), 5):
            edited[at] = draws.choice(words)
        rows.append((i, " ".join(edited)))
    counts, found = [], near_dup.verified

    def counted(pairs, texts):
        counts.append(pairs.count())
        return found(pairs, texts)

    monkeypatch.setattr(near_dup, "verified", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.classes(rows)
    assert sum(counts) < 60 * n
    assert sum(got[i] == want[i] for i in want) >= 0.98 * n


def test_blocks_are_dealt_by_the_sizes_of_the_members(spark):
    """Every text outside the largest class meets each text of another class in one pair of blocks, blocks
    hold few bytes, and no text is looked up for it: the one join on id is that with the classes."""
    size = near_dup.BLOCK_BYTES // 4
    members = spark.createDataFrame([(k, i, size) for k in (1, 2) for i in range(40 + k)], "key long, id long, size long")
    classes = spark.createDataFrame([(i, 100 + i % 3) for i in range(30)], "id long, class_id long")
    dealt = near_dup.facing_blocks(near_dup.with_classes(members, classes))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, .*\bid#", plan)) == 0
    asks, answers = {}, {}
    for r in dealt.collect():
        side = asks if r["asks"] else answers
        side.setdefault((r["key"], r["asking"], r["facing"]), set()).add((r["id"], r["class_id"]))
    met = Counter((key[0], a[0], b[0]) for key in asks for a in asks[key] for b in answers.get(key, ()))
    for k in (1, 2):
        of = {i: 100 + i % 3 if i < 30 else i for i in range(40 + k)}
        assert {met[k, a, b] for a in of if of[a] != 102 for b in of} == {1}
    assert max(len(x) for x in (*asks.values(), *answers.values())) * 4 < len(members.collect())


def test_no_pair_of_a_large_bucket_is_left_out(spark, monkeypatch):
    """Edited copies, some with a passage twice: every link is found, also where buckets go on in several blocks."""
    draws, words = random.Random(35), vocabulary(36)
    text = sentence(draws, words, 80).split()
    rows = []
    for i in range(70):
        edited = list(text)
        for at in draws.sample(range(80), 2):
            edited[at] = draws.choice(words)
        rows.append((i, " ".join(edited + edited[:6] * (i % 3))))
    monkeypatch.setattr(near_dup, "FACING", 20)
    # Without the rounds before it the full comparison still finds all.
    monkeypatch.setattr(near_dup, "CENTRAL", 0)
    monkeypatch.setattr(near_dup, "LONGER", ())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()} == brute.classes(rows)


def test_unlike_texts_with_one_id_all_stay(spark):
    draws, words = random.Random(33), vocabulary(34)
    texts = [sentence(draws, words, 80) for _ in range(5)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2] + " more"), (8, texts[0]), (8, texts[3]), (9, texts[3]), (9, None), (9, ""), (7, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit("mine")).repartition(3)
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(7, 7)] * 5 + [(8, 7), (8, 8), (9, 8), (9, 9), (9, 9)]
    kept = sorted(((r["doc_id"], r["text"] or "") for r in near_dup.drop_near_duplicates(docs).collect()))
    longer = {t for _, t in kept} & {texts[2], texts[2] + " more"}
    assert len(longer) == 1
    assert kept == sorted([(7, texts[0]), (7, texts[1]), (7, *longer), (8, texts[3]), (9, ""), (9, "")])


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (6, 5), (9, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r["id"]: r["class_id"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 4} | {i: 20 for i in range(20, 26)}


# the pipeline


def test_pipeline_stages(spark):
    """Each stage against brute force on what it was given."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    docs = documents(spark, TINY)
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, TINY), name)
        if name != "packing":
            assert docs.columns == documents(spark, TINY).columns
            texts[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.fit(documents(spark, TINY), spark.read.parquet(f"{TINY}/labels.parquet"))
    clean = toxicity.toxicity_scores(documents(spark, TINY), model).where("score < 0.5")
    assert {i for i, _ in texts["toxicity"]} == {r["doc_id"] for r in clean.collect()}
    assert {i for i, _ in texts["near_duplicates"]} == set(brute.classes(texts["toxicity"]).values())
    cut = brute.kept_words(texts["near_duplicates"])
    assert {i: brute.words(t) for i, t in texts["substring_dedup"]} == {
        i: [w for w, g in zip(found, gone, strict=True) if not g] for i, (found, gone) in cut.items()
    }
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in brute.contained(texts["substring_dedup"], items)}
    assert {i for i, _ in texts["decontamination"]} == {i for i, _ in texts["substring_dedup"]} - bad
    check_pieces(texts["decontamination"], docs.collect(), packing.Encoder(packing.default_tokenizer()))


def test_pipeline_on_odd_tables(spark, messy, tmp_path):
    """Nulls, repeated rows and an empty table go through all stages."""
    for name, rows in (("some", messy), ("none", messy.where("false"))):
        folder = str(tmp_path / name)
        rows.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{TINY}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        spark.read.parquet(f"{TINY}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder)
        for r in pieces.select("ids", "length", "ids_crc32").collect():
            assert (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) == (r["length"], r["ids_crc32"])
        assert pieces.isEmpty() == (name == "none")


def test_pipeline_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"pipeline", *QUERIES} <= set(names) and len(QUERIES) == 13
