"""Tables that appear together, model calls that go on where they stopped, results of streams."""

from __future__ import annotations

import gzip
import json
import os
import pathlib
import random


import pytest


from cotflow.operators import cots, datasets, prompts
from cotflow.plans.catalog import QUERIES
from cotflow.sources import published, writers
from cotflow.streaming.responses import ingest_results_stream, read_results_stream
from pyspark.sql import functions as F


def test_a_broken_run_leaves_the_old_output(spark, tmp_path):
    root = str(tmp_path / "out")
    old = spark.range(3)
    first = published.publish({"a": old, "b": old.withColumn("t", F.lit(None).cast("string"))}, root, {"b": "json"})
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        published.publish({"a": spark.range(9), "b": broken}, root, mode="overwrite")
    assert published.read_published(spark, root, "a").count() == 3
    again = published.read_published(spark, root, "b")
    assert again.dtypes == [("id", "bigint"), ("t", "string")] and again.count() == 3
    with pytest.raises(FileExistsError):
        published.publish({"a": old}, root)
    held = published.read_published(spark, root, "a")
    for n in (7, 8):
        last = published.publish({"a": spark.range(n)}, root, mode="overwrite")
        assert published.read_published(spark, root, "a").count() == n
        if n == 7:
            # Who has begun to read the run before goes on.
            assert held.count() == 3
    assert not os.path.exists(first) and os.path.exists(last)
    with pytest.raises(KeyError):
        published.read_published(spark, root, "b")
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, str(tmp_path / "none"), "a")
    with pytest.raises(ValueError):
        published.publish({"a": old}, str(tmp_path / "x"), {"a": "orc"})
    with pytest.raises(ValueError):
        published.publish({}, str(tmp_path / "x"))


def test_a_run_that_was_overtaken_fails(spark, tmp_path, monkeypatch):
    root, found = str(tmp_path / "out"), published.manifests
    calls = []

    def meanwhile(session, place):
        calls.append(place)
        if len(calls) == 2:
            monkeypatch.setattr(published, "manifests", found)
            published.publish({"a": session.range(2)}, root)
        return found(session, place)

    monkeypatch.setattr(published, "manifests", meanwhile)
    with pytest.raises(FileExistsError):
        published.publish({"a": spark.range(1)}, root)
    assert published.read_published(spark, root, "a").count() == 2


def test_alt_cots_publish_what_is_given(spark, tmp_path):
    rows = spark.range(2)
    root = writers.write_alt_cots(rows, rows, rows, str(tmp_path), "direct", combined=rows)
    assert sorted(n for n in os.listdir(root) if not n.startswith(".")) == ["combined", "cots", "metadata", "summary", "tables.txt"]
    assert published.read_published(spark, str(tmp_path / "alternative_cots_direct"), "combined").count() == 2


def requests_of(spark, n):
    return spark.createDataFrame([(f"e{i}", "cot", "s", f"u{i}") for i in range(n)], "example_id string, stage string, system string, user string")


def test_calls_are_repeated_bounded_and_trimmed(spark):
    def flaky(batch):
        assert len(batch) <= 3
        seen = flaky.__dict__.setdefault("seen", set())
        key = batch["user"].iloc[0]
        if key not in seen:
            seen.add(key)
            raise ConnectionError(key)
        return "  " + batch["user"] + "\n"

    got = prompts.generate_with(requests_of(spark, 20).repartition(3), flaky, in_flight=3, backoff=0.0)
    assert sorted(r["response"] for r in got.collect()) == sorted(f"u{i}" for i in range(20))

    def broken(batch):
        raise ConnectionError("always")

    with pytest.raises(Exception, match="always"):
        prompts.generate_with(requests_of(spark, 2), broken, backoff=0.0).collect()
    with pytest.raises(Exception, match="attempts must be"):
        prompts.generate_with(requests_of(spark, 2), broken, attempts=0).collect()
    assert prompts.generate_with(requests_of(spark, 2).limit(0), broken).collect() == []


def test_a_stopped_run_goes_on(spark, tmp_path):
    path, notes = str(tmp_path / "responses"), tmp_path / "asked"
    notes.mkdir()

    def answer(batch, stop_at=None):
        for user in batch["user"]:
            if user == stop_at:
                raise ConnectionError("stopped")
            with open(notes / user, "a") as f:
                f.write("x")
        return batch["user"] + "!"

    wanted = requests_of(spark, 40)
    place = F.pmod(F.xxhash64("example_id", "stage"), F.lit(4))
    last = wanted.where(place == 3).first()["user"]
    with pytest.raises(Exception, match="stopped"):
        prompts.generate_stored(wanted, lambda b: answer(b, last), path, 4, attempts=1)
    before = {r["example_id"] for r in spark.read.parquet(path).collect()}
    assert before == {r["example_id"] for r in wanted.where(place < 3).collect()}
    for p in notes.iterdir():
        p.unlink()
    got = prompts.generate_stored(wanted, answer, path, 4).collect()
    assert sorted(r["response"] for r in got) == sorted(f"u{i}!" for i in range(40))
    assert {p.name for p in notes.iterdir()} == {r["user"] for r in wanted.where(place == 3).collect()}
    assert all(p.read_text() == "x" for p in notes.iterdir())


def test_filter_stops_without_a_match(spark):
    df = spark.createDataFrame([("Run_1",), ("other",), (None,)], "example_id string")
    assert datasets.filter_examples(df, "rUN", required=True).count() == 1
    assert datasets.filter_examples(df, "zzz").count() == 0
    with pytest.raises(LookupError, match="zzz"):
        datasets.filter_examples(df, "zzz", required=True)


def test_stream_puts_examples_together_once(spark, tmp_path):
    landing, out, mark = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "mark")
    landing.mkdir()
    needed = spark.createDataFrame(
        [("a", ["cot", "segments", "graph"]), ("b", ["segments", "graph"]), ("c", ["segments", "graph"]), ("d", [])],
        "example_id string, needed array<string>",
    )

    def send(name, *rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("example_id", "stage", "response"), r))) for r in rows))
        ingest_results_stream(spark, str(landing), out, mark, needed, 1).awaitTermination()
        return sorted(tuple(r) for r in read_results_stream(spark, out).collect())

    assert send("1.json", ("a", "graph", "ag"), ("b", "graph", "bg"), ("x", "graph", "xg"), ("d", "cot", "dc")) == []
    assert send("2.json", ("a", "cot", "a1"), ("a", "cot", "a2"), ("b", "graph", "bg"), ("c", "segments", None)) == []
    ready = [("b", "graph", "bg"), ("b", "segments", "bs")]
    assert send("3.json", ("b", "segments", "bs"), ("b", "segments", "bs")) == ready
    assert send("4.json", ("b", "segments", "later"), ("c", "graph", "cg")) == ready
    done = sorted([*ready, ("a", "cot", "a2"), ("a", "graph", "ag"), ("a", "segments", "as")])
    assert send("5.json", ("a", "cot", "a0"), ("a", "segments", "as")) == done
    # Nothing new: the same files again under other names, and a run without files.
    assert send("6.json", ("a", "graph", "ag"), ("b", "graph", "bg")) == done
    # A batch that is repeated after a crash replaces its folder.
    rows = spark.read.parquet(out).where("batch = 2").drop("batch")
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    kept.write.mode("overwrite").parquet(f"{out}/batch=2")
    assert sorted(tuple(r) for r in read_results_stream(spark, out).collect()) == done


def test_stream_keeps_its_state_without_python(spark, tmp_path):
    landing, rows = tmp_path / "landing", spark.range(300).selectExpr("concat('e', id) example_id")
    rows.selectExpr("example_id", "explode(array('graph', 'segments')) stage", "'r' response").write.json(str(landing))
    needed = rows.selectExpr("example_id", "array('segments', 'graph') needed")
    query = ingest_results_stream(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "mark"), needed)
    query.awaitTermination()
    assert {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]} == {"stateStoreSave"}
    assert read_results_stream(spark, str(tmp_path / "out")).count() == 600
    lost = rows.limit(1).selectExpr("example_id", "array('segments', 'other') needed")
    query = ingest_results_stream(spark, str(landing), str(tmp_path / "bad"), str(tmp_path / "bad_mark"), lost)
    with pytest.raises(Exception, match="unknown stage"):
        query.awaitTermination()


def test_stream_keeps_what_a_restart_needs(spark, tmp_path):
    landing, out, mark = tmp_path / "landing", str(tmp_path / "out"), tmp_path / "mark"
    landing.mkdir()
    needed = spark.createDataFrame([(f"e{i}", ["segments"]) for i in range(8)], "example_id string, needed array<string>")
    for i in range(8):
        with gzip.open(landing / f"{i}.json.gz", "wt") as f:
            f.write(json.dumps({"example_id": f"e{i}", "stage": "segments", "response": "r"}))
    ingest_results_stream(spark, str(landing), out, str(mark), needed, 1).awaitTermination()
    assert len([p for p in (mark / "commits").iterdir() if p.name.isdigit()]) < 8
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "100"
    # The kept batches are enough to go on: what came before is still known.
    with gzip.open(landing / "again.json.gz", "wt") as f:
        f.writelines(json.dumps({"example_id": f"e{i}", "stage": "segments", "response": "s"}) + "\n" for i in range(8))
    ingest_results_stream(spark, str(landing), out, str(mark), needed, 1).awaitTermination()
    rows = sorted(tuple(r) for r in read_results_stream(spark, out).collect())
    assert rows == [(f"e{i}", "segments", "r") for i in range(8)]


def staged_files(spark, tmp_path, name, stage):
    """Paths of the files that query ``name`` leaves under its folders ``stage`` for a few orders of its own."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    rows = spark.range(1, 40).selectExpr("id o_orderkey", "id * 3 o_custkey", "'1-URGENT' o_orderpriority")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    before = set(shared.glob(stage))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    return [p for d in set(shared.glob(stage)) - before for p in d.rglob("part-*")]


def test_result_stream_files_are_compressed(spark, tmp_path):
    files = staged_files(spark, tmp_path, "ingest_results_stream", "results-stream-*")
    landed = [p for p in files if p.parent.name == "landing"]
    assert landed and all(p.name.endswith(".json.gz") for p in landed)
    assert not [p for p in files if p.parent.name == "responses"]


@pytest.mark.parametrize(("name", "stage", "ending"), [
    ("write_sft", "sft_data-*", ".json.gz"), ("read_pipeline_results", "results-*", ".txt.gz"), ("ingest_responses_stream", "stream-*/landing", ".json.gz"),
])
def test_staged_files_are_compressed(spark, tmp_path, name, stage, ending):
    files = staged_files(spark, tmp_path, name, stage)
    assert files and all(p.name.endswith(ending) for p in files)


def test_preview_says_why_nothing_is_shown(spark):
    rows = [
        ("e1", None, ("LOW",), "exhaustive", 4, ["s1", "s2"], ["one", "two"], [[0, 1], [1, 0], [0, 1], [1, 0]]),
        ("e2", "Invalid input", None, None, None, None, None, None), ("e3", None, ("LOW",), "exhaustive", 0, ["s1"], ["x"], []),
    ]
    paths = spark.createDataFrame(rows, "example_id string, error string, complexity_estimate struct<complexity:string>, method string, total_paths int, node_ids array<string>, node_texts array<string>, orderings array<array<int>>")
    shown = cots.preview(paths, 3)
    got = {(r["example_id"], r["path_no"]): r for r in shown.collect()}
    assert len(got) == 5 and got[("e1", 2)]["texts"] == "two\none" and got[("e1", 1)]["more"] == 1
    assert got[("e2", None)]["error"] == "Invalid input" and got[("e3", None)]["error"] == cots.NO_PATHS
    texts = {(r["example_id"], r["path_no"]): r["text"] for r in cots.preview_text(shown).collect()}
    assert texts[("e2", None)] == "e2: Invalid input" and "Sequence: s2 → s1\n\n  two\n  one" in texts[("e1", 2)]
    assert texts[("e1", 1)].startswith("=" * 80 + "\nEXAMPLE: e1\n") and "EXAMPLE" not in texts[("e1", 2)]


def test_one_last_record_of_equal_ones(spark):
    draws = random.Random(4)
    rows = [(k, draws.choice([None, 1, 2]), draws.choice("ab")) for k in [None, "x", "y"] for _ in range(30)] + [("hot", 5, "z")] * 5000
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(6)
    got = cots.keep_last(df, "k", "o").collect()
    assert sorted(str(r["k"]) for r in got) == ["None", "hot", "x", "y"]
    assert all(r["o"] == max(o or 0 for k, o, _ in rows if k == r["k"]) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, cots.keep_last(df.repartition(3), "k", "o").collect()))
