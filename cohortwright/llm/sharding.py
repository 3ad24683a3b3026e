"""Sharding by jump consistent hashing: a row's id and the shard count decide, without a ring table.

Adding one shard moves only the rows that go into it, 1/(n + 1) of them. ``slot`` numbers the rows of a shard
from 0 without gaps, in the order of a second hash: rows are dealt to ranges of that hash, ranges are counted (a
combined aggregate), and a window numbers within one range only. The number of ranges follows the row count, so
a range stays near RANGE_ROWS rows. The hash is of id, text and a number among exact repeats, so slots don't follow the
files and no row can fill a range with its copies.

A null id is one key of its own; its rows are spread over ranges by text and number. Null texts have no bytes: size 1, CRC 0.
Repeated rows get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, numbered_copies, text_key, texts
from .words import mix

RANGE_ROWS = 20_000
NULL_KEY = 0x5DEECE66D


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: the last jump below ``shards``."""
    keys, at, to = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.float64)
    going = np.arange(len(keys))
    while len(going):
        at[going] = to[going].astype(np.int64)
        keys[going] = keys[going] * np.uint64(2862933555777941757) + np.uint64(1)
        to[going] = np.floor((at[going] + 1) * ((1 << 31) / ((keys[going] >> np.uint64(33)).astype(np.float64) + 1)))
        going = going[to[going] < shards]
    return at


def _assigned(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").fill_null(NULL_KEY).to_numpy().view(np.uint64)
        keys = mix(mix(ids) + np.uint64(0x9E3779B97F4A7C15))
        yield batch.append_column("shard", pa.array(jump(keys, shards), pa.int32())).append_column("grown_shard", pa.array(jump(keys, shards + 1), pa.int32()))


def _placed(own: DataFrame, shards: int) -> DataFrame:
    """Rows of (doc_id, text_hash, ...) with shard, slot and grown_shard."""
    given = own.schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given)
    placed = own.mapInArrow(lambda it: _assigned(it, shards), f"{kept}, shard int, grown_shard int")
    placed = materialize(placed.withColumn("__uid", F.monotonically_increasing_id()))
    ranges = max(1, placed.count() // (shards * RANGE_ROWS))
    placed = numbered_copies(placed, "__uid", ["doc_id", "text_hash"], "__copy").withColumn("__order", F.xxhash64("doc_id", "text_hash", "__copy"))
    # Ranges are equal parts of the hash's order.
    placed = materialize(placed.withColumn("__part", F.floor((F.shiftrightunsigned("__order", 33) * F.lit(ranges)) / F.lit(float(1 << 31))).cast("int")))
    counts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    here = Window.partitionBy("shard", "__part").orderBy(F.shiftrightunsigned("__order", 33), "__order", "doc_id", "text_hash", "__copy")
    slot = (F.col("__before") + F.row_number().over(here) - 1).cast("bigint")
    return placed.join(before, ["shard", "__part"]).select(*given.names, "shard", slot.alias("slot"), "grown_shard")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    own = texts(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("text_hash")
    )
    return _placed(own, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def with_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The documents, all columns and repeated rows kept, with ``shard`` and ``slot`` (which replace columns so named)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("row"))
    own = own.withColumn("nth", F.monotonically_increasing_id())
    own = materialize(own.withColumns({"doc_id": F.col("row.doc_id").cast("bigint"), "text_hash": text_key(F.col("row.text").cast("string"))}))
    slots = _placed(own.select("doc_id", "text_hash", "nth"), shards)
    return own.select("row", "nth").join(slots.select("nth", "shard", "slot"), "nth").select("row.*", "shard", "slot")
