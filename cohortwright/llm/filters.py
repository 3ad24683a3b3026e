"""A membership filter of fixed size: hashed keys as bits, built by Spark and sent to every task.

Its size is a parameter and does not grow with the data. A bit of two keys only lets a row pass that a
later exact join removes, so it decides cost, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PER_ROW = 15  # Spark's bitmaps hold 2^15 bits


def build_filter(df: DataFrame, key: str, log2_bits: int = 27) -> np.ndarray:
    """Bytes of the filter over a long column; null keys are left out. At most ``2 ** (log2_bits - 3)`` bytes."""
    bit = F.shiftrightunsigned(F.col(key), 64 - log2_bits)
    rows = (
        df.filter(F.col(key).isNotNull())
        .select(F.shiftright(bit, _PER_ROW).cast("int").alias("part"), bit.bitwiseAND((1 << _PER_ROW) - 1).alias("at"))
        .distinct()
        .groupBy("part")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )
    out = np.zeros(1 << max(log2_bits - 3, _PER_ROW - 3), np.uint8)
    width = 1 << (_PER_ROW - 3)
    for part, bits in rows.collect():
        out[part * width : part * width + width] = np.frombuffer(bits, np.uint8)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit key may be in the filter."""
    log2_bits = len(bits).bit_length() - 1 + 3
    at = h >> np.uint64(64 - log2_bits)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def count_table(df: DataFrame, key: str, log2_slots: int = 20) -> np.ndarray:
    """Rows by the first bits of a hashed long column, ``2 ** log2_slots`` counts however many keys there are."""
    slot = F.shiftrightunsigned(F.col(key), 64 - log2_slots)
    counted = df.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << log2_slots, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return out


def counts_of(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The count that stands for each unsigned 64-bit key."""
    return table[h >> np.uint64(64 - (len(table).bit_length() - 1))]
