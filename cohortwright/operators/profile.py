"""Missing-value profiles, label detection and run summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label columns tried first, in this order.
LABEL_CANDIDATES = (
    "vital_status", "survival_status", "tumor_grade", "grade", "sample_type", "project_id", "primary_diagnosis",
    "state",
)


def missing_profile(df: DataFrame, dataset: str = "table") -> DataFrame:
    """Missing count, fraction and type of every column, from one aggregate."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    return (
        counts.unpivot(["_rows"], [f"`{c}`" for c in df.columns], "column", "missing_count")
        .select(
            F.lit(dataset).alias("dataset"),
            "column",
            "missing_count",
            (F.col("missing_count") / F.nullif(F.col("_rows"), F.lit(0))).alias("missing_fraction"),
            types[F.col("column")].alias("dtype"),
        )
        .orderBy(F.desc("missing_count"), "column")
    )


def missing_total(dfs: Mapping[str, DataFrame]) -> DataFrame:
    """Missing cells per dataset."""
    def cells(df: DataFrame) -> Column:
        return F.sum(sum((F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint")))

    rows = [
        df.agg(F.coalesce(cells(df), F.lit(0).cast("bigint")).alias("missing_values")).select(
            F.lit(name).alias("dataset"), "missing_values"
        )
        for name, df in dfs.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def usable_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column whether it has more than one distinct value (its minimum and maximum differ)."""
    row = df.agg(*[F.coalesce(F.min(f"`{c}`") != F.max(f"`{c}`"), F.lit(False)).alias(c) for c in cols])
    return row.unpivot([], [f"`{c}`" for c in cols], "column", "usable")


def detect_label(
    df: DataFrame, candidates: Sequence[str] = LABEL_CANDIDATES, exclude: Sequence[str] = (), choice: str | None = None
) -> str:
    """Label column: the caller's choice, else the first usable candidate, else the first usable column."""
    if choice:
        if choice not in df.columns or choice in exclude:
            raise KeyError(f"'{choice}' cannot be the label column")
        return choice
    cols = [c for c in df.columns if c not in exclude]
    usable = {r["column"] for r in usable_labels(df, cols).collect() if r["usable"]}
    for c in [*candidates, *cols]:
        if c in usable:
            return c
    raise ValueError("No usable label column; name one explicitly")


def run_summary(source: DataFrame, metrics: Mapping[str, Column | str | int | float]) -> DataFrame:
    """Metric/value rows as text; columns are aggregates over ``source``, other values are literals."""
    cells = [(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in metrics.items()]
    return source.agg(*cells).unpivot([], list(metrics), "metric", "value")
