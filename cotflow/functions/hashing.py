"""Seeded pseudo-random keys that depend on the row alone, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Park-Miller generator: full period on 1..MODULUS-1, exact in 64-bit integers.
MULTIPLIER, MODULUS = 48271, 2147483647


def hash_key(seed: int, *keys: Column) -> Column:
    """Hex digest of the seed and the keys; uniform, so it can order a random sample."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def start_state(seed: int, *keys: Column) -> Column:
    """A generator state in 1..MODULUS-1."""
    prefix = F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return prefix % F.lit(MODULUS - 1).cast("bigint") + F.lit(1).cast("bigint")


def next_state(state: Column) -> Column:
    return (state * F.lit(MULTIPLIER).cast("bigint")) % F.lit(MODULUS).cast("bigint")
