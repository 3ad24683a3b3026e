"""Table scans, sinks and schema checks."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwright.functions.arithmetic import to_number

# CSV cells read as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def blank_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing tokens in text columns and NaN in float columns become NULL."""
    changes: dict[str, Column] = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            changes[field.name] = F.when(~c.isin(*tokens), c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changes[field.name] = F.when(~F.isnan(c), c)
    return df.withColumns(changes) if changes else df


def numeric_columns(df: DataFrame, id_col: str | Sequence[str], coerce: bool = False) -> tuple[list[str], list[str]]:
    """Split columns other than the key into numeric and other, by declared type.

    With ``coerce`` a text column also counts as numeric when every non-missing value reads as a
    number, which takes one aggregate over the text columns.
    """
    ids = {id_col} if isinstance(id_col, str) else set(id_col)
    fields = [f for f in df.schema.fields if f.name not in ids]
    numeric = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if coerce and text:
        row = df.agg(
            *[F.count(F.when(F.col(f"`{c}`").isNotNull() & to_number(F.col(f"`{c}`")).isNull(), 1)).alias(str(i))
              for i, c in enumerate(text)],
            *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(text)],
        ).first()
        numeric |= {c for i, c in enumerate(text) if row[str(i)] == 0 and row[f"n{i}"] > 0}
    return [f.name for f in fields if f.name in numeric], [f.name for f in fields if f.name not in numeric]


def infer_numbers(df: DataFrame) -> DataFrame:
    """Cast the text columns that hold only numbers to double."""
    numeric, _ = numeric_columns(df, (), coerce=True)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in numeric if c in text})


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None
) -> DataFrame:
    """Scan a CSV (header line) or Parquet table with missing tokens and NaN as NULL.

    Give ``schema`` for large CSV inputs: without it the text columns are typed by one extra pass.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        return blank_missing(spark.read.parquet(path))
    if fmt != "csv":
        return blank_missing(spark.read.format(fmt).load(path))
    if schema is None:
        return infer_numbers(blank_missing(spark.read.csv(path, header=True)))
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = blank_missing(spark.read.csv(path, header=True, schema=text))
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_labelled(spark: SparkSession, path: str, position: str | None = None) -> tuple[DataFrame, list[str]]:
    """CSV with positional column names and the header labels kept apart, so labels may repeat.

    ``position`` adds a last column that orders rows as they lie in the files.
    """
    labels = next(csv.reader([spark.read.text(path).first()[0]]))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(labels))])
    raw = spark.read.csv(path, header=True, schema=schema)
    if position:
        raw = raw.select("*", file_position().alias(position))
    return blank_missing(raw), [name.strip() for name in labels]


def file_position() -> Column:
    """Orders rows of a file scan by file, block and place in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")
    )


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType, fmt: str | None = None) -> DataFrame:
    """Like ``read_table``, but an absent path gives an empty table."""
    if path:
        try:
            return read_table(spark, path, schema=schema, fmt=fmt)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
    return spark.createDataFrame([], schema)


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, cols: Sequence[str], name: str = "table") -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"{name} is missing required columns: {missing}")
    return df


def project_canonical(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order; absent ones are NULL of the declared type."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write many files in parallel; nothing is gathered into one task."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Nested summary rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
