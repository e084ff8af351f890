from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cotflow.functions import answers

# One case per rule of the strict pattern: marker, blank, sign, commas, point, what may follow.
CASES = [
    ("so it costs 17 in all\n#### 17", "17"), ("#### -306", "-306"), ("#### 12,500.75", "12500.75"),
    ("#### 8.", "8"), ("#### 0.250", "0.25"), ("#### -0.0", "0"), ("#### 90 \t", "90"),
    ("#### 61\nmore text", "61"), ("### 5", ""), ("####  5", ""), ("#### +5", ""), ("#### 5 apples", ""),
    ("#### five", ""), ("five", ""), ("####", ""),
]

STRICT = [
    ("#### ,", ""), ("####42", "[invalid]"), ("#### 42.", "42."), ("####  42", "[invalid]"),
    ("a #### 5 \n\nfoo", "5"), ("#### 1\n#### 2", "1"), ("#### x\n#### 7", "7"),
    ("#### 5\r\nx", "5"), ("#### 5 ", "5"), (None, "[invalid]"),
]
LOOSE = [
    ("####42", "42"), ("#### 42abc", "42"), ("#### 42.", "42."), ("none", None),
    ("####\n\n 1,000", "1000"), ("#### --", "--"), (None, None),
]
NUMBERS = [
    ("", ""), ("[invalid]", ""), (None, ""), ("1e3", "1000"), ("2.50", "2.5"), ("007", "7"),
    ("1,000", "1000"), ("1 000", "1000"), ("-0", "0"), ("0.0", "0"), ("0.0000001", "0"),
    ("-0.0000001", "-0"), ("1.23456789", "1.234568"), ("abc", ""), ("1f", ""), ("1d", ""),
    ("0x10", ""), ("1_000", "1000"), ("_1", ""), (".5", "0.5"), ("5.", "5"), ("+5", "5"),
    ("inf", "inf"), ("-Infinity", "-inf"), ("nan", "nan"), ("--", ""), (".", ""),
    ("1152921504606846976", "1152921504606846976"), ("1e22", "10000000000000000000000"),
    ("1e23", "99999999999999991611392"), ("-1e25", "-10000000000000000905969664"),
    ("9223372036854775808", "9223372036854775808"), ("0.0000005", "0"), ("0.0000015", "0.000002"),
    ("0.0078125", "0.007812"), ("0.0234375", "0.023438"), ("-2.0000005", "-2.000001"), ("1234567.0000005", "1234567"),
    ("0.1234565", "0.123456"), ("2.6754325", "2.675432"), ("12345678.6543215", "12345678.654321"),
]


def _apply(spark, fn, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_extraction_cases(spark):
    got = _apply(
        spark,
        lambda t: answers.normalize_number(answers.final_answer_strict(t)),
        [t for t, _ in CASES],
    )
    assert got == [want for _, want in CASES]


@pytest.mark.parametrize(
    "fn, cases",
    [
        (answers.final_answer_strict, STRICT),
        (answers.final_answer_loose, LOOSE),
        (answers.normalize_number, NUMBERS),
    ],
    ids=["strict", "loose", "normalize"],
)
def test_edges(spark, fn, cases):
    assert _apply(spark, fn, [t for t, _ in cases]) == [want for _, want in cases]


def test_match_rules(spark):
    rows = [("42", "42.0"), ("[invalid]", "[invalid]"), ("", "[invalid]"), ("x", "y"), ("1", "2")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = [r[0] for r in df.select(answers.answers_match(F.col("p"), F.col("t"))).collect()]
    assert got == [True, False, True, True, False]
