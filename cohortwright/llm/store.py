"""Shared pieces of the operators: stored tables, keys of rows, and unions of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwright.operators.distributed import discard, materialize, number_rows, shuffles_deleted

__all__ = ["discard", "keyed", "materialize", "merged_length", "shuffles_deleted", "texts"]

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns; columns the operators don't know are left out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``uid``, one for each row. Store the table before it is read twice."""
    return docs.withColumn("uid", F.monotonically_increasing_id())


def whole(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all columns as one struct ``row``, so that no column's name can clash."""
    return texts(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def numbered_copies(rows: DataFrame, row: str, keys: list[str], name: str) -> DataFrame:
    """Stored ``rows`` with a number from 0 on among rows of equal keys; ``row`` is any unique column.

    Which copy gets which number is open, so only the keys and the numbers decide what is made of them.
    """
    key = F.xxhash64(*[F.col(k) for k in keys], *[F.col(k).isNull() for k in keys])
    keyed_ = rows.withColumn("__key", key)
    repeated = keyed_.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key")
    copies = number_rows(keyed_.join(repeated, "__key", "left_semi"), ["__key"], [row], name)
    copies = copies.withColumn(name, (F.col(name) - 1).cast("bigint"))
    single = keyed_.join(repeated, "__key", "left_anti").withColumn(name, F.lit(0).cast("bigint"))
    return single.unionByName(copies.select(*single.columns)).drop("__key")


def merged_length(spans: DataFrame, by: str, name: str) -> DataFrame:
    """Positions in the union of a document's intervals (``first`` to ``last``, exclusive)."""
    before = Window.partitionBy(by).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(0))
    return (
        spans.select(by, "first", "last")
        .distinct()
        .withColumn("_new", F.greatest(F.lit(0), F.col("last") - F.greatest("first", reached)))
        .groupBy(by)
        .agg(F.sum("_new").alias(name))
    )
