"""Gene sets in tab-separated GMT lines: name, description, genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_gene_sets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows ``(pathway, gene)`` from GMT lines; short lines and blank genes are skipped."""
    fields = F.split(F.regexp_replace(column, r"[\r\n]+$", ""), "\t")
    sets = lines.select(fields.alias("f")).filter(F.size("f") >= 3)
    return (
        sets.select(F.col("f")[0].alias("pathway"), F.explode(F.array_distinct(F.slice("f", 3, 1 << 30))).alias("gene"))
        .filter(F.col("gene") != "")
    )


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Read a GMT file; a set named twice is an error, since file order decides nothing in Spark."""
    lines = spark.read.text(path)
    names = lines.select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 3).groupBy(F.col("f")[0].alias("n"))
    repeated = [r["n"] for r in names.count().filter("count > 1").limit(10).collect()]
    if repeated:
        raise ValueError(f"Gene sets named more than once: {repeated}")
    return parse_gene_sets(lines)
