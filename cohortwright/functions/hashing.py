"""Seeded, engine-independent hash order used wherever a random draw is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def stable_hash(seed: int | str | Column, *keys: Column | str) -> Column:
    """First 32 bits of ``md5('seed:key[:key]')`` as a bigint in [0, 2**32)."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [head.cast("string"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")
