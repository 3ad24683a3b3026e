"""Steps 1 and 2 from raw delimited files: matrices in either orientation and one clinical table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwright.operators import keys
from cohortwright.sources.matrix import read_wide_matrix
from cohortwright.sources.tables import infer_numbers, read_labelled

from .cohort import build_cohort
from .preprocess import preprocess


@dataclass(frozen=True)
class Inputs:
    """Long matrices, the clinical table with one row per key, its key column, and what merging repeated columns met."""

    counts: DataFrame
    normalized: DataFrame
    clinical: DataFrame
    id_col: str
    merged_columns: DataFrame | None


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(sample_id, gene, value)`` of a wide matrix; where a sample or a gene repeats, the first cell in file order counts."""
    cells = read_wide_matrix(spark, path, sep, position="_at").filter(F.col("sample_id").isNotNull())
    return cells.groupBy("sample_id", "gene").agg(F.min_by("value", "_at").alias("value"))


def read_clinical(spark: SparkSession, path: str, id_col: str | None = None) -> tuple[DataFrame, str, DataFrame | None]:
    """Clinical rows, one per key in file order, the key column, and the report on repeated column labels.

    Repeated labels are merged, numbers typed, and an unnamed index column that holds identifiers named; the key
    is the caller's or the best candidate.
    """
    raw, labels = read_labelled(spark, path, position="_at")
    merged, report = keys.resolve_duplicate_columns(raw, [*labels, "_at"])
    table = keys.name_unnamed_key(infer_numbers(merged))
    key = keys.detect_key([table.drop("_at")], id_col)
    return keys.dedupe_first(table.filter(F.col(key).isNotNull()), key, ["_at"]).drop("_at"), key, report


def read_inputs(spark: SparkSession, counts: str, normalized: str, clinical: str, id_col: str | None = None, sep: str = ",") -> Inputs:
    table, key, report = read_clinical(spark, clinical, id_col)
    return Inputs(read_matrix(spark, counts, sep), read_matrix(spark, normalized, sep), table, key, report)


def _with_report(tables: dict[str, DataFrame], given: Inputs) -> dict[str, DataFrame]:
    return tables | ({"merged_columns": given.merged_columns} if given.merged_columns is not None else {})


def preprocess_files(spark: SparkSession, counts: str, normalized: str, clinical: str, id_col: str | None = None, **options) -> dict[str, DataFrame]:
    """``preprocess`` from raw files; ``options`` are its own."""
    given = read_inputs(spark, counts, normalized, clinical, id_col)
    return _with_report(preprocess(given.counts, given.normalized, given.clinical, given.id_col, **options), given)


def build_cohort_files(spark: SparkSession, counts: str, normalized: str, clinical: str, id_col: str | None = None, **options) -> dict[str, DataFrame]:
    """``build_cohort`` from raw files; ``options`` are its own."""
    given = read_inputs(spark, counts, normalized, clinical, id_col)
    return _with_report(build_cohort(given.counts, given.normalized, given.clinical, given.id_col, **options), given)
