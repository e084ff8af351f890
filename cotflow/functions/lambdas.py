"""Small helpers around Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without this a costly column used inside a lambda is inlined by the optimizer and
    evaluated again on every iteration.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def upto(n: Column) -> Column:
    """1..n as an int array, empty when n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(empty("array<int>"))


def computed_once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``keep`` plus costly columns that later steps may filter on or use many times.

    The columns come out of a one-element generator. Without it the optimizer may move a
    later filter below the projection, and with it a second copy of the computation.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
