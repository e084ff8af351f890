"""Runs a query in Spark and its SQL in DuckDB and compares rows regardless of order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# DuckDB type -> Spark type of the same column.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(con, spark, sf_dir: str, fn, sql: str) -> list[str]:
    """What differs, as messages; empty when the results agree."""
    df = fn(spark, sf_dir)
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    described = {d[0]: str(d[1]) for d in expected.description}
    spark_types = dict(df.dtypes)
    for name, kind in described.items():
        wanted = TYPES.get(kind.upper())
        if wanted is not None and spark_types[name].replace("timestamp_ntz", "timestamp") != wanted:
            problems.append(f"type of {name}: {spark_types[name]} != {kind}")
    want = _rows(names, expected.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if not want:
        problems.append("the SQL gives no rows")
    if want != got:
        lost, extra = want - got, got - want
        problems.append(
            f"rows: spark {sum(got.values())}, sql {sum(want.values())}; "
            f"only sql {list(lost.items())[:2]}; only spark {list(extra.items())[:2]}"
        )
    return problems
