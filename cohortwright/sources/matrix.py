"""Wide matrices to the long form ``(sample_id, gene, value)``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwright.functions.arithmetic import to_number
from cohortwright.functions.identifiers import BARCODE_PREFIX
from cohortwright.operators.distributed import lookup_join

from .tables import MISSING_TOKENS


def looks_like_sample(label: str, prefix: str = BARCODE_PREFIX) -> bool:
    return label.strip().replace(".", "-").upper().startswith(prefix)


def is_gene_by_sample(columns: list[str], prefix: str = BARCODE_PREFIX) -> bool:
    """At least max(3, half) of the columns after the first are sample identifiers."""
    if len(columns) < 3:
        return False
    hits = sum(looks_like_sample(c, prefix) for c in columns[1:])
    return hits >= max(3, len(columns[1:]) // 2)


def matrix_to_long(df: DataFrame, id_col: str | None = None, prefix: str = BARCODE_PREFIX) -> DataFrame:
    """Long form of a wide matrix in either orientation, decided from the column labels."""
    if is_gene_by_sample(df.columns, prefix):
        key, name, label = df.columns[0], "gene", "sample_id"
    else:
        key, name, label = id_col or df.columns[0], "sample_id", "gene"
    values = [c for c in df.columns if c != key]
    numbers = df.select(
        F.col(f"`{key}`").cast("string").alias(name), *[to_number(F.col(f"`{c}`")).alias(c) for c in values]
    )
    return numbers.unpivot([name], [f"`{c}`" for c in values], label, "value").select(
        "sample_id", "gene", "value"
    )


def read_wide_matrix(
    spark: SparkSession, path: str, sep: str = ",", prefix: str = BARCODE_PREFIX, position: str | None = None
) -> DataFrame:
    """Long form of delimited matrices with too many columns for a table schema.

    Each line is one text value. Every file has its own header, its first line, which gives its labels and its
    orientation; a line with another number of cells is an error, and a later line equal to the header is
    data like any other. Lines get their file's labels as one array (a table of headers, broadcast if it measures small
    enough), and a row's cells and labels are zipped in place: no cell is shuffled or joined. Cells must not contain the separator.
    ``position`` adds a column that orders cells as they lie in the files.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"),
    )
    cells = F.split("value", re.escape(sep))
    headers = lines.filter("start = 0").groupBy("file").agg(F.min(F.struct("nth", "value")).alias("first"))
    headers = headers.select("file", F.col("first.nth").alias("header_nth"), F.col("first.value").alias("header"))
    labels = F.transform(F.split("header", re.escape(sep)), lambda x: F.trim(x, F.lit(' "')))
    headers = headers.select("file", "header_nth", labels.alias("labels")).withColumn("n", F.size("labels"))
    after = F.slice("labels", 2, F.col("n"))
    samples = F.size(F.filter(after, lambda x: F.upper(F.replace(x, F.lit("."), F.lit("-"))).startswith(prefix)))
    # The same rule as ``is_gene_by_sample``, for each file.
    by_gene = (F.col("n") >= 3) & (samples >= F.greatest(F.lit(3), F.floor((F.col("n") - 1) / 2)))
    headers = headers.select("file", "header_nth", "n", by_gene.alias("by_gene"), after.alias("labels"))
    body = lookup_join(lines, headers, "file", "inner").filter((F.col("nth") != F.col("header_nth")) & (F.trim("value") != ""))
    wrong = F.raise_error(F.concat(F.lit("Line with another number of cells than the header of "), F.col("file")))
    checked = F.when(F.size(cells) == F.col("n"), cells).otherwise(wrong.cast("array<string>"))
    body = body.select("by_gene", "labels", checked.alias("cells"), F.struct("file", "start", "nth").alias("line"))
    key = F.trim(F.get("cells", F.lit(0)), F.lit(' "'))
    pairs = F.arrays_zip(F.col("labels").alias("label"), F.slice("cells", 2, F.size("cells")).alias("cell"))
    long = body.select("by_gene", "line", key.alias("key"), F.posexplode(pairs).alias("column", "c")).select(
        "by_gene", F.struct("line", "column").alias("at"), "key", F.col("c.label").alias("label"), F.trim("c.cell", F.lit(' "')).alias("text")
    )
    long = long.withColumn("value", to_number(F.when(~F.col("text").isin(*MISSING_TOKENS), F.col("text"))))
    sample, gene = (F.when(F.col("by_gene"), F.col(x)).otherwise(F.col(y)) for x, y in (("label", "key"), ("key", "label")))
    return long.select(sample.alias("sample_id"), gene.alias("gene"), "value", *([F.col("at").alias(position)] if position else []))


def name_unnamed(label: str) -> bool:
    """Whether a label is a left-over index column of a CSV export."""
    return bool(re.match(r"^unnamed:\s*\d+$", label.strip(), flags=re.IGNORECASE))
