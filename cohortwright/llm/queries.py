"""One query for each operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, licenses, lines, lm, mixing, neardup, quality, search, sharding, substrings, toxicity, wrappers
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that benchmark windows of ten words hit."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with licence phrases, labels and the greatest share of a licence text that they cover."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least eight sources share."""
    out = lines.without_boilerplate(table(spark, sf_dir, "documents"), site="source", min_sites=8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their counts and the verdict of the quality rules."""
    out = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their unigram base score and the context-tree model's log10 probability."""
    return lm.score(table(spark, sf_dir, "documents"), lm.MAX_DEPTH)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that a mix of all sources takes of them."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 15 by jump consistent hashing of their ids."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that an earlier document has too."""
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their toxicity score; labels are learnt from rows that aren't held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on 4-word shingles."""
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, with shared parts of the items evaluated once."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under two tokenizers: their token groups, links, and corpus-wide counts of linked id pairs."""
    return alignment.align(table(spark, sf_dir, "documents")).documents().drop("groups")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by wrappers of its host."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_licenses, op3_lines, op4_quality, op5_lm, op6_mixing, op7_sharding, op8_substrings,
        op9_toxicity, op10_minhash, op11_search, op12_alignment, op13_html,
    )
}
