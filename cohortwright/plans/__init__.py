"""The five steps end to end, each a function from tables to named tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from cohortwright.sources.tables import write_table


def write_outputs(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write every table under its name; nested summaries become JSON."""
    for name, df in tables.items():
        nested = any(kind.startswith(("struct", "map", "array")) for _, kind in df.dtypes)
        write_table(df, f"{folder}/{name}", "json" if nested and fmt == "csv" else fmt)
