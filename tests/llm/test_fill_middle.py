"""Cuts by skip list against plain slices of lines."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from cotflow.llm import fill_middle  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 17, 300, 5000])
def test_every_rank_is_exact(n):
    widths = np.random.default_rng(n).integers(1, 90, n)
    lines = fill_middle.LineSkipList(widths)
    sums = np.concatenate([[0], np.cumsum(widths)])
    ranks = range(n + 1) if n < 1000 else random.Random(n).sample(range(n + 1), 300)
    assert [lines.points_before(r) for r in ranks] == [sums[r] for r in ranks]
    assert all(int(u.sum()) == n and int(p.sum()) == sums[-1] for u, p, _ in lines.lanes)


def test_lanes_thin_out():
    sizes = [len(u) for u, _, _ in fill_middle.LineSkipList(np.ones(100_000, int)).lanes]
    assert all(small < large / 3 for large, small in zip(sizes[:-2], sizes[1:-1]))
    assert sizes[-1] <= fill_middle.LINK


def test_code_points_of_lines():
    text = "a\u00e9\n\n\U0001f600\u4e2d\r\nx\u2028y\x85z"
    data = np.frombuffer(text.encode(), np.uint8)
    assert fill_middle.line_points(data).tolist() == [3, 1, 4, 5]


@pytest.fixture(scope="module")
def rows():
    draws = random.Random(3)
    letters = "ab \u00e9\u4e2d\U0001f600\n\n\r\t<>PSM"
    found = [(i, "".join(draws.choice(letters) for _ in range(draws.randint(0, 400)))) for i in range(300)]
    found += [(1000, None), (1001, ""), (1002, "\n"), (1003, "\n\n"), (1004, "no end"), (1005, "has <M> in it"), (None, "a\nb")]
    found += [(1006, "line\u00fc\n" * 300_000), (1007, "x" * 3_000_000), (-5, "a\nb\nc")]
    return found + found[:9]


@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0), (30, 100), (0, 50)])
def test_cuts_match_slices(spark, rows, percent, spm):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "h1", "form", "output")})
    cut = fill_middle.fill_in_middle(docs.repartition(4), percent=percent, spm_percent=spm)
    back = cut.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r[0]), *map(str, r[1:6])) for r in back) == sorted(
        (str(i), *map(str, brute.cut_lines(i, t, 7, percent, spm))) for i, t in rows
    )
    assert sorted(r["back"] for r in back) == sorted(t or "" for _, t in rows)
    assert fill_middle.fill_in_middle(docs.where("false")).collect() == []


def test_marks_are_a_parameter(spark):
    marks = ("[a|", ".*", "^$")
    docs = spark.createDataFrame([(i, f"one {i}\ntwo\nthree.\n*a|") for i in range(40)], "doc_id int, text string")
    cut = fill_middle.fill_in_middle(docs, marks=marks)
    back = cut.select(F.col("form") != "plain", fill_middle.restored(F.col("output"), F.col("form"), marks) == F.format_string("one %s\ntwo\nthree.\n*a|", "doc_id"))
    assert {tuple(r) for r in back.collect()} == {(True, True)}
