"""Sampling, id sets, readers, writers, prompts, streams on small fixtures."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cotflow import schemas
from cotflow.functions import tags, text
from cotflow.operators import consistency, cots, datasets, multihop, prompts, sampling, segments, tools
from cotflow.plans import jobs
from cotflow.session import shared_dir
from cotflow.sources import readers, writers
from cotflow.streaming.responses import ingest_responses_stream


def ids(df, name="example_id"):
    return sorted(r[name] for r in df.select(name).collect())


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(5000).select(F.concat(F.lit("e_"), "id").alias("example_id")).repartition(5)


@pytest.mark.parametrize("n", [0, 1, 37, 4999, 5000])
@pytest.mark.parametrize("prefix", [1, 4])
def test_sample_is_the_smallest_digests(many, monkeypatch, n, prefix):
    monkeypatch.setattr(sampling, "PREFIX", prefix)
    keys = sorted((hashlib.md5(f"7|e_{i}".encode()).hexdigest(), f"e_{i}") for i in range(5000))
    assert ids(sampling.sample_n(many.repartition(2), n, 7)) == sorted(k for _, k in keys[:n])


def test_sample_too_large(many):
    with pytest.raises(ValueError):
        sampling.sample_n(many, 5001, 7)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_keys_and_rows(spark, seed):
    """Rows that share a key are told apart, equal rows are counted."""
    shared = spark.range(1400).select((F.col("id") % 20).alias("example_id"), F.col("id").alias("row"))
    for n in (0, 1, 69, 70, 71, 700, 1400):
        got = [r["row"] for r in sampling.sample_n(shared, n, seed).collect()]
        assert len(got) == len(set(got)) == n
        again = [r["row"] for r in sampling.sample_n(shared.repartition(3), n, seed).collect()]
        assert sorted(again) == sorted(got)
    same = spark.range(100).select(F.lit("x").alias("example_id"), (F.col("id") % 3).alias("v"))
    for n in (3, 33, 50, 99):
        assert sampling.sample_n(same, n, seed).count() == n
        parts = sampling.train_val_split(same, n / 100, seed)
        assert parts.where("part = 'validation'").count() == n
        assert {r["v"]: r["count"] for r in parts.groupBy("v").count().collect()} == {0: 34, 1: 33, 2: 33}


def test_split_sizes_and_groups(many):
    parts = sampling.train_val_split(many, 0.1, 42).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 4500, "validation": 500}
    assert sampling.train_val_split(many.limit(11), 0.1).where("part = 'validation'").count() == 2
    rows = many.withColumn("g", F.abs(F.hash("example_id")) % 50)
    grouped = sampling.train_val_split(rows, 0.2, 1, group_col="g")
    assert grouped.select("g", "part").distinct().count() == rows.select("g").distinct().count()


def test_head(many):
    rows = many.withColumn("example_ord", F.substring_index("example_id", "_", -1).cast("int"))
    assert ids(sampling.head_n(rows, 3)) == ["e_0", "e_1", "e_2"]
    assert sampling.head_n(rows, None).count() == 5000
    sparse = rows.withColumn("example_ord", F.struct((F.col("example_ord") * 10).alias("block"), F.lit(1).alias("row")))
    assert ids(sampling.head_n(sparse, 20)) == sorted(f"e_{i}" for i in range(20))


def test_id_differences(spark):
    rows = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("a", "10"), ("b", "1"), ("b", "3"), ("c", "1"), ("c", "2"),
         ("c", "10"), ("c", "10"), ("b", None)],
        "file string, id string",
    )
    found = consistency.sorted_differences(consistency.id_differences(rows))
    assert [tuple(r) for r in found.collect()] == [
        ("b", "missing", "10"), ("b", "missing", "2"), ("b", "extra", "3"),
    ]
    only = rows.where("file <> 'b'")
    assert consistency.ids_consistent(consistency.id_differences(only)).first()["consistent"]
    single = rows.where("file = 'a'")
    assert consistency.ids_consistent(consistency.id_differences(single)).first()["consistent"]
    other = consistency.id_differences(rows, reference_file="b")
    assert other.where("file = 'a' AND side = 'extra'").count() == 2


@pytest.mark.parametrize("kind", ["json", "jsonl", "csv"])
def test_write_samples(spark, tmp_path, kind):
    rows = [(f"e{i}", 'q "x",\nüß', None if i % 2 else "5") for i in range(7)]
    df = spark.createDataFrame(rows, "example_id string, question string, final_answer string")
    path = str(tmp_path / kind)
    writers.write_samples(df.repartition(3), path, kind)
    if kind == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'}
        back = spark.read.options(**options).schema(df.schema).csv(path)
    else:
        back = spark.read.option("multiLine", kind == "json").schema(df.schema).json(path)
    assert sorted(back.collect()) == sorted(df.collect()) if kind != "csv" else back.count() == 7
    if kind == "json":
        files = [json.loads(p.read_text()) for p in (tmp_path / kind).glob("part-*")]
        assert sum(len(f) for f in files) == 7
        assert all("final_answer" in r for f in files for r in f)


def test_write_samples_format(many, tmp_path):
    with pytest.raises(ValueError):
        writers.write_samples(many, str(tmp_path / "x"), "xml")


def test_read_examples_numbers_rows_across_files(spark, tmp_path):
    path = str(tmp_path / "qa")
    rows = spark.range(100).select(
        F.concat(F.lit("q"), "id").alias("question"), F.concat(F.lit("#### "), "id").alias("answer")
    )
    rows.repartition(4).write.parquet(path)
    got = readers.read_examples(spark, path, "math", "test").collect()
    assert sorted(r["example_ord"] for r in got) == list(range(100))
    again = readers.read_examples(spark, path, "math", "test").collect()
    assert sorted(got) == sorted(again)
    assert all(r["final_answer"] == r["question"][1:] for r in got)
    assert {r["example_id"] for r in got} == {f"math_test_{i}" for i in range(100)}


def test_read_sft_marks_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"split":"train","id":"1","question":"q","answer":"ä"}\n{"id": "2"\n{"question":"x"}\n'
    )
    (tmp_path / "b.jsonl").write_text('{"split":"train","id":"1","question":"q"}\n')
    rows = readers.read_sft(spark, f"{tmp_path}/*.jsonl")
    good = {(r["file"], r["id"], r["answer"]) for r in readers.good_lines(rows).collect()}
    assert good == {("a.jsonl", "1", "ä"), ("a.jsonl", None, ""), ("b.jsonl", "1", "")}
    assert [tuple(r) for r in readers.bad_lines(rows).collect()] == [("a.jsonl", 1)]
    counted = {r["file"]: tuple(r)[1:] for r in consistency.ids_per_file(rows).collect()}
    assert counted == {"a.jsonl": (1, 1, 1), "b.jsonl": (1, 0, 0)}
    with pytest.raises(Exception):
        readers.read_sft(spark, f"{tmp_path}/a.jsonl", strict=True).collect()
    checked = jobs.check_ids(rows)
    assert checked["consistent"].first()["consistent"]


def test_read_stored_files(spark, tmp_path):
    result = {
        "example_id": "e1", "question": "q", "answer": "a", "final_answer": None, "cot": "c",
        "segments": [{"id": "s1", "text": "t", "is_required": 1}], "required_segments": [],
        "nodes": [{"id": "s1", "text": "t"}], "edges": [["s1", "s2"], ["s1"]], "success": True,
    }
    (tmp_path / "r.json").write_text(json.dumps([result, {**result, "example_id": "e2"}], indent=2))
    back = readers.read_pipeline_results(spark, str(tmp_path / "r.json")).collect()
    assert [r["example_id"] for r in back] == ["e1", "e2"]
    assert back[0]["edges"] == [["s1", "s2"], ["s1"]] and back[0]["pipeline_type"] is None
    stored = [
        {"example_id": "e1", "method": "exhaustive", "total_paths": 2,
         "complexity_estimate": {"complexity": "MEDIUM", "constraint_ratio": 1.0},
         "paths": [{"sequence": ["s1", "s2"], "texts": ["t1", "t2"]},
                   {"sequence": ["s2", "s1"], "texts": ["t2", "t1"]}]},
        {"example_id": "e2", "error": "Invalid input"},
    ]
    (tmp_path / "p.json").write_text(json.dumps(stored))
    paths = readers.read_reasoning_paths(spark, str(tmp_path / "p.json"))
    originals = readers.read_pipeline_results(spark, str(tmp_path / "r.json"))
    kept = cots.alternative_cots(cots.cot_records(paths, originals, "example_ord"))
    assert [r["answer"] for r in kept.orderBy("cot_no").collect()] == ["t1\nt2", "t2\nt1"]
    tables = jobs.analyze_paths(paths)
    assert tables["steps"].count() == 2


def test_last_record_in_file_order_wins(spark, tmp_path):
    lines = [json.dumps({"example_id": "e", "question": f"q{i}", "answer": "x" * 50}) for i in range(3000)]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = readers.read_pipeline_results(spark, str(tmp_path / "r.jsonl"), array_file=False)
        assert rows.rdd.getNumPartitions() > 3
        last = cots.keep_last(rows, "example_id", "example_ord").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert last["question"] == "q2999"


def test_multihop(spark, tmp_path):
    raw = [
        {"_id": "a", "question": "q", "answer": "x", "type": "t", "level": "l",
         "supporting_facts": [["A", 0], ["A", 9], ["Z", 0], ["B", -1], ["B", -5]],
         "context": [["A", ["old"]], ["B", ["b0", "b1"]], ["A", ["new", "n" * 101]], ["C", []]]},
        {"_id": "b", "question": "q2", "context": []},
    ]
    (tmp_path / "m.json").write_text(json.dumps(raw))
    df = readers.read_multihop_json(spark, str(tmp_path / "m.json"))
    assert df.where("id = 'b'").first()["supporting_facts"] == []
    assert df.where("id = 'b'").first()["answer"] is None
    found = [tuple(r)[1:] for r in multihop.supporting_context(df).orderBy("fact_no").collect()]
    assert found == [(1, "A", 0, "new"), (2, "B", -1, "b1")]
    profile = multihop.profile_multihop(df.where("id = 'a'")).orderBy("paragraph_no").collect()
    assert [r["sentences"] for r in profile] == [1, 2, 2, 0]
    assert readers.read_multihop_json(spark, str(tmp_path / "m.json"), 1).count() == 1


def test_tool_rows(spark):
    good = '[{"name": "f", "parameters": {"b": 1, "a": 2}}, {"description": "d"}]'
    calls = '[{"name": "f", "arguments": {"b": 1, "a": [1, 2]}}]'
    rows = [(1, "q", good, calls), (2, "q", good, "[oops"), (3, "q", "", calls), (4, "q", good, "[] x")]
    df = tools.parse_tool_calls(spark.createDataFrame(rows, schemas.TOOL_ROW))
    sizes = {r["id"]: (len(r["tools"]), len(r["answers"])) for r in df.collect()}
    assert sizes == {1: (2, 1), 2: (0, 0), 3: (0, 1), 4: (0, 0)}
    loose = [(1, "q", good, "[{'name': 'f'}]"), (2, "q", good, '{"name": "f"}'), (3, "q", "[1,]", calls), (4, "q", good, "x")]
    df2 = tools.parse_tool_calls(spark.createDataFrame(loose, schemas.TOOL_ROW))
    assert {r["id"]: (len(r["tools"]), len(r["answers"])) for r in df2.collect()} == {1: (0, 0), 2: (2, 0), 3: (0, 0), 4: (0, 0)}
    first = [tuple(r) for r in tools.explode_tools(df.where("id = 1")).orderBy("tool_no").collect()]
    assert first == [(1, 1, "f", "No description"), (1, 2, "Unknown", "d")]
    assert tools.explode_calls(df.where("id = 1")).first()["arguments"] == '{"b":1,"a":[1,2]}'


def test_tags(spark):
    rows = [
        ("<cot>\n a b \n</cot> <cot>x</cot>", "a b"), ("<cot></cot>", ""), ("<cot>a", None), ("", None),
    ]
    df = spark.createDataFrame(rows, "r string, want string")
    assert all(r[0] == r[1] for r in df.select(tags.extract_cot(F.col("r")), "want").collect())
    edges = [
        ('<edges>[["a","b"],"x",["c"]]</edges>', [["a", "b"], None, ["c"]]),
        ('<edges>[["a","b"]] and more</edges>', None), ('<edges>{"a":1}</edges>', None),
        ("<edges>[]</edges>", []), ("<edges></edges>", None),
    ]
    df = spark.createDataFrame([(r,) for r, _ in edges], "r string")
    got = [r[0] for r in df.select(tags.extract_edges(F.col("r"))).collect()]
    assert got == [want for _, want in edges]
    segments = [
        ('[{"id":"a","text":"t","is_required":true},{"id":"b","text":"u","is_required":0}]', [1, 0]),
        ('[{"id":"a","text":"t","is_required":1.0},{"id":"b","text":"u"}]', [1, None]),
        ("[{'id':'a','text':'t','is_required':1}]", None), ('[{"id":"a"}, /* b */ {"id":"c"}]', None),
        ('[{"id":"a","text":"tab\there"}]', None), ('[{"id":"a"},]', None),
    ]
    df = spark.createDataFrame([(f"<segments>{r}</segments>",) for r, _ in segments], "r string")
    got = [r[0] for r in df.select(tags.extract_segments(F.col("r"))).collect()]
    assert [g and [s["is_required"] for s in g] for g in got] == [want for _, want in segments]


def test_prompts(spark, tmp_path):
    cut = spark.range(1).select(
        text.split_prompt(F.lit(" sys \n---USER--- a ---USER--- b ")).alias("p"),
        text.split_prompt(F.lit(" only ")).alias("d"),
    ).first()
    assert tuple(cut["p"]) == ("sys", "a ---USER--- b")
    assert tuple(cut["d"]) == (text.DEFAULT_SYSTEM, "only")
    (tmp_path / "one.txt").write_text("Hi {question} {{x}}")
    stored = readers.read_prompt_templates(spark, str(tmp_path), ["one"])
    assert readers.template_dict(stored, ["one"]) == {"one": "Hi {question} {{x}}"}
    with pytest.raises(KeyError):
        readers.template_dict(stored, ["one", "two"])
    with pytest.raises(FileNotFoundError):
        readers.read_prompt_templates(spark, str(tmp_path), ["one", "two"])
    df = spark.createDataFrame([("{answer} }}",)], "q string")
    filled = text.render_template("Hi {question} {{x}}", {"question": F.col("q")})
    assert df.select(filled).first()[0] == "Hi {answer} }} {x}"
    listed = spark.sql("SELECT array(named_struct('id','s1','text','a\"b','is_required',1)) s")
    got = listed.select(text.indented_json(F.col("s"))).first()[0]
    assert got == json.dumps([{"id": "s1", "text": 'a"b', "is_required": 1}], indent=2)


def test_generate_and_assemble(spark):
    examples = spark.createDataFrame(
        [("e1", "q1", "1 + 1 = 2\n#### 2", "2", "regular")], f"{schemas.EXAMPLE}, style string"
    )
    replies = {
        "cot": "<cot>one. two.</cot>",
        "segments": '<segments>[{"id":"s1","text":"one","is_required":1}]</segments>',
        "graph": '<nodes>[{"id":"s1","text":"one"}]</nodes><edges>[]</edges>',
    }
    requests = spark.createDataFrame(
        [("e1", s, "sys", s) for s in replies], "example_id string, stage string, system string, user string"
    )
    responses = prompts.generate_with(requests, lambda batch: batch["user"].map(replies))
    row, summary = jobs.parse_responses(examples, responses)
    found = row.first()
    assert found["cot"] == "one. two." and len(found["segments"]) == 1
    assert found["failed_stage"] == "graph" and found["nodes"] is None and not found["success"]
    assert tuple(summary.first()) == (0, 1, 0.0)


def test_segments_of_an_answer(spark):
    answer = "Tom has 3 apples.\nHe buys 2: 3+2=<<3+2=5>>5.\n\n#### 5"
    examples = spark.createDataFrame([("e", "q", answer, "5")], schemas.EXAMPLE)
    row = jobs.graphs_from_answers(examples).first()
    assert [tuple(s) for s in row["segments"]] == [
        ("s1", "Tom has 3 apples.", 0), ("s2", "He buys 2: 3+2=5.", 1),
    ]
    assert row["success"] is False
    with pytest.raises(ValueError):
        datasets.to_sft_original(examples, "dev")


def test_overlap_rule(spark):
    made = [("s1", "abc", 1), ("s2", "bc", 1), ("s3", "d", 1), ("s4", "zz", 1)]
    df = spark.createDataFrame(
        [("e", "abcd", made)], f"example_id string, cot string, segments {schemas.SEGMENTS}"
    )
    found = segments.check_contracts(df, ("non_overlap", "exact_excerpt"))
    assert {(r["rule"], r["detail"]) for r in found.collect()} == {
        ("non_overlap", "s2"), ("exact_excerpt", "s4"),
    }


def test_cap_in_row_equals_cap_by_window(spark):
    rows = spark.range(1, 31).select(F.lit("e").alias("example_id"), F.col("id").cast("int").alias("path_no"))
    window = sorted(r["path_no"] for r in cots.cap_paths(rows, 10, 5).collect())
    in_row = spark.range(1).select(cots.kept_numbers(F.lit(30), 10, 5, F.lit("e"))).first()[0]
    assert in_row == window and len(window) == 10


def test_paths_and_rows_are_read_once(spark, tmp_path):
    """The report and the split read what is stored, not their input again for each of their parts."""
    rows = [
        (i, f"e{i}", None if i % 3 else "Invalid input", ("LOW",), "exhaustive", 2, ["s1", "s2"], ["one", "two"], [[0, 1], [1, 0]] if i % 3 else None)
        for i in range(12)
    ]
    kinds = "example_ord bigint, example_id string, error string, complexity_estimate struct<complexity:string>, method string, total_paths int, node_ids array<string>, node_texts array<string>, orderings array<array<int>>"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))

    def reads(df):
        return str(tmp_path) in df._jdf.queryExecution().executedPlan().toString()

    assert reads(given)
    report = jobs.analyze_paths(given)["report"]
    lines = [r["line"] for r in report.collect()]
    assert not reads(report) and "Total Examples: 12" in lines and "  s1: 8 examples (variance: 1)" in lines
    sft = given.select(F.lit("train").alias("split"), F.lit("one").alias("id"), F.col("example_id").alias("question"), F.lit("a").alias("answer"))
    parted = jobs.export_training(sft, frac=0.25)
    assert not reads(parted)
    assert sorted(r["part"] for r in parted.collect()) == ["train"] * 9 + ["validation"] * 3

    originals = given.select("example_id", "example_ord", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("7").alias("final_answer"))
    held = []
    kept = cots.cot_records(given, originals, "example_ord", 1, 3, lambda joined: held.append(joined) or joined)
    assert len(held) == 1 and "cots" not in held[0].columns
    same = cots.cot_records(given, originals, "example_ord", 1, 3)
    assert sorted(map(str, kept.collect())) == sorted(map(str, same.collect()))
    # What is moved for the join are numbers: the texts of an example once, not once per ordering.
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "cots" not in plan.split("Join", 1)[1]


def test_sft_layout_and_alt_cots(spark, tmp_path):
    rows = spark.createDataFrame([("train", "1", "q", "a", None)], schemas.SFT)
    path = writers.write_sft(rows, str(tmp_path), "math", 10, "original")
    assert path.endswith("math/10/original.jsonl")
    assert readers.good_lines(readers.read_sft(spark, path)).first()["final_answer"] == ""
    root = writers.write_alt_cots(rows, rows, rows, str(tmp_path), "direct")
    assert spark.read.parquet(f"{root}/cots").count() == 1
    writers.write_report({"summary": rows}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).count() == 1


def test_stream_appends_each_file_once(spark, tmp_path):
    landing, target, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    one = spark.createDataFrame([("e1", "cot", "<cot>x</cot>")], schemas.RESPONSE)
    one.write.json(landing)
    for _ in range(2):
        ingest_responses_stream(spark, landing, target, mark).awaitTermination()
    assert spark.read.parquet(target).count() == 1
    one.withColumn("example_id", F.lit("e2")).write.mode("append").json(landing)
    ingest_responses_stream(spark, landing, target, mark).awaitTermination()
    assert ids(spark.read.parquet(target)) == ["e1", "e2"]


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_last_record_without_order_and_ties(spark):
    rows = [("a", None, "x"), ("b", 1, "old"), ("b", None, "none"), ("b", 2, "new"), (None, 1, "null key")]
    rows += [("c", 1, "one"), ("c", 1, "two"), ("d", 1, "same"), ("d", 1, "same")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = [{r["k"]: r["v"] for r in cots.keep_last(df.repartition(n), "k", "o").collect()} for n in (1, 4)]
    assert got[0] == got[1] and cots.keep_last(df, "k", "o").count() == 5
    assert got[0] | {"c": ""} == {"a": "x", "b": "new", "c": "", "d": "same", None: "null key"}


def test_missing_template_is_an_error(spark):
    df = spark.createDataFrame([("e", "direct", "q", "a", "1")], "example_id string, style string, question string, answer string, final_answer string")
    with pytest.raises(KeyError):
        prompts.render_requests(df, {}, "segments")
    only = {"segment_cot": "Q {question}"}
    with pytest.raises(Exception, match="segment_cot_direct"):
        prompts.render_requests(df, only, "segments").collect()
    assert prompts.render_requests(df.withColumn("style", F.lit("regular")), only, "segments").first()["user"] == "Q q"


def test_repeated_responses_do_not_repeat_requests(spark):
    requests = spark.createDataFrame([("e", "cot"), ("f", "cot")], "example_id string, stage string")
    responses = spark.createDataFrame([("e", "cot", "a"), ("e", "cot", "b")], "example_id string, stage string, response string")
    got = {r["example_id"]: r["response"] for r in prompts.attach_responses(requests, responses).collect()}
    assert got == {"e": "b", "f": None} and prompts.attach_responses(requests, responses).count() == 2


def test_reference_file_and_single_file(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "file string, id string")
    with pytest.raises(ValueError, match="'b'"):
        consistency.id_differences(rows, reference_file="b")
    assert jobs.check_ids(rows)["consistent"].first()["consistent"] is None
    two = rows.union(spark.createDataFrame([("b", "1")], "file string, id string"))
    assert jobs.check_ids(two)["consistent"].first()["consistent"] is False


def test_prompt_json_is_ascii(spark):
    texts = ["plain \"quoted\" \n", "é ü", "日本 😀 x", ""]
    segments = F.array(*[F.struct(F.lit(f"s{i}").alias("id"), F.lit(t).alias("text"), F.lit(i).alias("is_required")) for i, t in enumerate(texts)])
    want = [{"id": f"s{i}", "text": t, "is_required": i} for i, t in enumerate(texts)]
    row = spark.range(1).select(text.indented_json(segments).alias("a"), text.indented_json(segments, False).alias("b")).first()
    assert row["a"] == json.dumps(want, indent=2) and row["b"] == json.dumps(want, indent=2, ensure_ascii=False)


def test_first_multihop_records(spark, tmp_path):
    rows = [{"_id": f"r{i}", "question": "q", "context": []} for i in range(200)]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    got = readers.read_multihop_json(spark, str(tmp_path / "m.jsonl"), 7, array_file=False)
    assert {r["id"] for r in got.collect()} == {f"r{i}" for i in range(7)}


def test_writers_do_not_overwrite_unasked(spark, tmp_path):
    rows = spark.range(3)
    writers.write_report({"t": rows}, str(tmp_path / "r"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_report({"t": rows}, str(tmp_path / "r"))
    writers.write_report({"t": rows}, str(tmp_path / "r"), mode="overwrite")


def test_separate_cuts_of_a_repeated_sentence_do_not_overlap(spark):
    def late(cot, cuts):
        made = F.array(*[F.struct(F.lit(f"s{i + 1}").alias("id"), F.lit(c).alias("text"), F.lit(1).alias("is_required")) for i, c in enumerate(cuts)])
        df = spark.range(1).select(F.lit("e").alias("example_id"), F.lit(cot).alias("cot"), made.alias("segments"))
        return [r["detail"] for r in segments.check_contracts(df, ("non_overlap",)).collect()]

    assert late("ab. cd. ab.", ["ab.", "cd.", "ab."]) == []
    assert late("ab. cd.", ["ab.", "b. c", "cd."]) == ["s2"]
    assert late("ab. cd.", ["cd.", "ab."]) == ["s2"]
    assert late("ab.", ["ab.", "", "zz"]) == []


def test_differences_come_in_report_order(spark):
    ids = [str(i) for i in range(60)] + ["Z", "a", "é"]
    rows = [(f, i) for k, f in enumerate(("b.jsonl", "a.jsonl", "c.jsonl")) for n, i in enumerate(ids) if n % (k + 2)]
    df = spark.createDataFrame(rows, "file string, id string").repartition(7)
    found = consistency.sorted_differences(consistency.id_differences(df))
    got = [(r["file"], r["side"], r["id"]) for r in found.collect()]
    assert len(got) > 40 and {s for _, s, _ in got} == {"missing", "extra"}
    assert got == sorted(got, key=lambda r: (r[0], r[1] != "missing", r[2]))


def test_last_record_is_made_and_moved_once(spark):
    """The rows are neither computed again for a join nor sent more than one per key and task."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 3000, 1, 3).selectExpr("id % 2 AS k", "id AS o", "concat('v', id) AS v")
    got = cots.keep_last(rows.mapInArrow(count, rows.schema), "k", "o").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [(0, "v2998"), (1, "v2999")]
    assert made.value == 3000
