"""Cross-site boilerplate: lines that many distinct sites share, counted by HyperLogLog sketches per line hash.

Each distinct line (two 64-bit hashes) gets a sketch of its sites; sketches merge in the aggregation, so a line of a
third of all rows is combined before the shuffle and its state has a fixed size. Estimates below or above the band
around the threshold (BAND, many standard errors) decide at once; lines inside it are counted exactly by a second
aggregate of their distinct sites. Lines of at least ``min_sites`` sites are removed.

Lines are the ``\\n``-split parts of a text that hold a word ``[^\\x20\\x09-\\x0D]+``; lines without one always stay. A null
site is one site of its own. Null texts have no lines and stay empty. Repeated rows count as one site and lose the same
lines. Documents whose text is null or empty keep the empty text's digest. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

MIN_SITES, LG_K, BAND = 8, 12, 0.2


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(97), line).alias("h2")]


def _exploded(docs: DataFrame, site: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("-")).alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line"),
    )
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("doc_id", "text_hash", "site", "at", *_line_key(F.col("line")))


def widespread(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that at least ``min_sites`` distinct sites hold."""
    lines = _exploded(docs, site).select("h1", "h2", "site")
    spread = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    # A line has no more sites than places, so the others need no estimate.
    spread = spread.filter(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
    spread = materialize(spread.filter(F.col("sites") >= min_sites * (1 - BAND)))
    sure = spread.filter(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2")
    near = spread.filter(F.col("sites") <= min_sites * (1 + BAND)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return sure.union(exact.filter(F.col("sites") >= min_sites).select("h1", "h2"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per document row: doc_id, n_lines (with a word), n_removed, kept_text."""
    wide = materialize(widespread(docs, site, min_sites))
    places = _exploded(docs, site).select("doc_id", "text_hash", "at", "h1", "h2").join(wide, ["h1", "h2"], "left_semi")
    places = places.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone")).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    joined = own.join(places, own["doc_id"].eqNullSafe(F.col("_id")) & (own["text_hash"] == F.col("_hash")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    lines = F.split(F.col("text"), "\n")
    kept = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    return joined.select(
        "doc_id",
        F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_removed"),
        kept.alias("kept_text"),
    )
