"""Reproducible exact-size samples and splits on any keys.

Rows are ranked by the seeded digest of their key, rows of one key by the digest of the whole row,
and equal rows count as many times as they occur. The first n by that rank are a uniform random
sample that does not depend on partitioning. The edge is found with histograms of digest prefixes
over a narrow stored table (at most 65,536 counts reach the driver per round), so no task ever
sorts the sample, whatever its size. The rows are read twice: for their digests and for the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cotflow.functions.hashing import hash_key
from cotflow.session import stage_path

PREFIX = 4
DIGEST = 32


def _row_digest(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"}))


def _edge(digests: DataFrame, column: str, n: int) -> tuple[str, int]:
    """(bound, left): the n smallest are the digests below ``bound`` and ``left`` rows of it.

    Each round counts rows by the next digits after the bound and moves the bound to the digits
    at which the count passes n. A bound of fewer digits than a digest leaves no rows.
    """
    bound = ""
    while len(bound) < DIGEST:
        inside = digests.where(F.startswith(F.col(column), F.lit(bound))) if bound else digests
        part = F.substring(column, len(bound) + 1, PREFIX)
        counts = inside.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()
        for row in sorted(counts, key=lambda r: r["part"]):
            if row["rows"] > n:
                bound += row["part"]
                break
            n -= row["rows"]
            if n == 0:
                return bound + row["part"] + "~", 0  # above every digest that starts so
        else:
            return "~", 0
    return bound, n


def _digests(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Digest columns of all rows, stored: counting them and cutting them reads nothing else."""
    path = stage_path(df.sparkSession, "digests")
    narrow = df.select(*[c.alias(name) for name, c in columns.items()])
    narrow.write.parquet(path)
    return df.sparkSession.read.schema(narrow.schema).parquet(path)


def _chosen(df: DataFrame, key: list[str], digests: DataFrame, n: int, seed: int) -> DataFrame:
    """df with a boolean ``chosen`` that holds for exactly n rows, or all if there are fewer.

    ``digests`` holds the rows' key digests. Whole rows are only looked at where rows of one key
    stand at the edge.
    """
    if n <= 0:
        return df.withColumn("chosen", F.lit(False))
    digest = _key_digest(key, seed)
    bound, left = _edge(digests, "key", n)
    if not left:
        return df.withColumn("chosen", digest < bound)
    # Rows of one key stand at the edge: rank them by their own digest.
    row = _row_digest(df)
    edge = _digests(df.where(digest == bound), {"row": row})
    inner, rest = _edge(edge, "row", left)
    below = (digest < bound) | ((digest == bound) & (row < inner))
    if not rest:
        return df.withColumn("chosen", below)
    # Equal rows stand at the edge: one of them, as often as it occurs, in either part.
    equal = (digest == bound) & (row == inner)
    times = edge.where(F.col("row") == inner).count()
    copies = df.where(equal).limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return df.where(~equal).withColumn("chosen", below).unionByName(
        copies.withColumn("chosen", F.col("copy") <= rest).drop("copy")
    )


def _key_digest(key: list[str], seed: int) -> Column:
    return hash_key(seed, *[F.col(c) for c in key])


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sample_n(df: DataFrame, n: int, seed: int, key: str | list[str] = "example_id") -> DataFrame:
    """Exactly n rows without replacement; asking for more than there are is an error."""
    digests = _digests(df, {"key": _key_digest(_columns(key), seed)})
    available = digests.count()
    if n > available:
        raise ValueError(f"requested {n} samples but only {available} are available")
    return _chosen(df, _columns(key), digests, n, seed).where("chosen").drop("chosen")


def head_n(df: DataFrame, n: int | None, index: str = "example_ord") -> DataFrame:
    """The first n rows in source order, by any index that sorts so; all rows without n."""
    return df.orderBy(index).limit(n) if n else df


def train_val_split(
    df: DataFrame,
    frac: float = 0.1,
    seed: int = 42,
    key: str | list[str] = "example_id",
    group_col: str | None = None,
) -> DataFrame:
    """Add ``part``: exactly ceil(frac x rows) validation rows, the rest training rows.

    Rows are split one by one, also those that share their key. With ``group_col`` whole groups
    go to one side by digest, so related rows do not leak across; the sizes are then close to
    the fraction but not exact.
    """
    if group_col is not None:
        share = F.conv(F.substring(hash_key(seed, F.col(group_col)), 1, 8), 16, 10).cast("bigint")
        parted = df.withColumn("chosen", share < int(frac * 2**32))
    else:
        digests = _digests(df, {"key": _key_digest(_columns(key), seed)})
        parted = _chosen(df, _columns(key), digests, math.ceil(frac * digests.count()), seed)
    return parted.withColumn("part", F.when(F.col("chosen"), "validation").otherwise("train")).drop("chosen")
