"""Cohort selection, its counters and the histogram data behind its figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.functions.arithmetic import as_column
from cohortwright.functions.hashing import stable_hash

from .distributed import materialize, bottom_by_hash
from .metadata import COMPLETENESS_FIELDS

ENVIRONMENTS = ("env_sex", "env_smoking", "env_histology", "env_stage", "env_country_or_region")


def representative_order(
    completeness: str = "metadata_completeness_score", full_id: str = "original_id", key: str = "sample_id"
) -> Column:
    """Ascending sort key of the preferred sample: most complete, has a full id, smallest sample id."""
    return F.struct(
        F.coalesce(-F.col(completeness), F.lit(float("inf"))).alias("a"),
        F.col(full_id).isNull().alias("b"),
        F.coalesce(F.col(key), F.lit("")).alias("c"),
    )


def mark_representatives(
    df: DataFrame,
    keys: Sequence[str] = ("patient_id", "disease_label_name"),
    order: Column | None = None,
    key: str = "sample_id",
) -> DataFrame:
    """Flag one row per patient and class; the others carry a reason.

    Several rows (aliquots) may share ``key``, so rows are numbered and stored, and the choice is a
    combinable minimum of (order, row content, number): exactly one row of each group is flagged, and
    a patient with very many samples costs no more than any other.
    """
    order = representative_order(key=key) if order is None else order
    df = df.drop("representative_selected")
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    content = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])
    best = rows.groupBy(*keys).agg(F.min_by("_row", F.struct(order.alias("order"), content.alias("content"), "_row")).alias("_row"))
    marked = rows.join(best.select("_row", F.lit(True).alias("representative_selected")), "_row", "left").drop("_row")
    reason = F.concat(F.lit("duplicate_"), F.col(keys[-1]).cast("string"), F.lit("_sample_within_patient"))
    marked = marked.fillna(False, ["representative_selected"])
    return marked.withColumn("exclusion_reason", F.when(~F.col("representative_selected"), reason))


def pick_representative(
    df: DataFrame,
    keys: Sequence[str] = ("patient_id", "disease_label_name"),
    order: Column | None = None,
    key: str = "sample_id",
) -> tuple[DataFrame, DataFrame]:
    """The representative samples, and the others with their reason."""
    marked = mark_representatives(df, keys, order, key)
    return marked.filter("representative_selected"), marked.filter("NOT representative_selected")


def duplicate_patients(df: DataFrame, patient: str = "patient_id", kept: Sequence[str] = ("patient_id", "disease_label_name")) -> DataFrame:
    """Patients with several samples, and samples dropped by keeping one per patient and class."""
    per_class = df.groupBy(*kept).agg(F.count("*").alias("n"))
    per_patient = per_class.groupBy(patient).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra"))
    return per_patient.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_patient_count"),
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_sample_reductions"),
    )


def fold_distribution(
    df: DataFrame, fold: str = "outer_fold", label: str = "disease_label", labels: Sequence[int] = (0, 1)
) -> DataFrame:
    """Rows per fold and class, zero where a class is absent."""
    return df.groupBy(fold).agg(*[F.count_if(F.col(label) == v).alias(f"label_{v}") for v in labels])


def category_counts(df: DataFrame, cols: Sequence[str] = ENVIRONMENTS) -> DataFrame:
    """Rows per level of each column, missing levels included as NULL."""
    have = [c for c in cols if c in df.columns]
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in have]).unpivot([], have, "column", "level")
    return pairs.groupBy("column", "level").agg(F.count("*").alias("n"))


def available_counts(df: DataFrame, cols: Sequence[str] = COMPLETENESS_FIELDS) -> DataFrame:
    have = [c for c in cols if c in df.columns]
    return df.agg(*[F.count(c).alias(c) for c in have]).unpivot([], have, "field", "available")


def excluded_by_reason(log: DataFrame) -> DataFrame:
    return log.groupBy("exclusion_reason").agg(F.count("*").alias("n"))


def cohort_summary(
    cohort: DataFrame, excluded: DataFrame, matched: dict[str, DataFrame], folds: DataFrame, everything: DataFrame,
    candidates: DataFrame, fields: Sequence[str] = COMPLETENESS_FIELDS,
) -> DataFrame:
    """The nested one-row summary of a cohort build.

    ``matched`` names the counts of matched samples. The maps are keyed by reasons, ``fields`` and folds. Environments
    can have any number of levels, so their counts are a long table of their own (``category_counts``).
    """

    def entries(df: DataFrame, key: str, value: Column | str) -> Column:
        pair = F.struct(F.coalesce(F.col(key).cast("string"), F.lit("missing")).alias("k"), as_column(value).alias("v"))
        return F.map_from_entries(F.sort_array(F.collect_list(pair)))

    counts = cohort.agg(
        F.count_if(F.col("disease_label_name") == "tumor").alias("tumor_count"),
        F.count_if(F.col("disease_label_name") == "normal").alias("normal_count"),
        F.count_distinct("patient_id").alias("unique_patient_count"),
    )
    reasons = excluded_by_reason(excluded).agg(entries(excluded_by_reason(excluded), "exclusion_reason", "n").alias("m"))
    per_fold = fold_distribution(folds).withColumn("c", F.struct("label_0", "label_1"))
    available = available_counts(everything, fields)
    return counts.select(
        F.struct(*[df.agg(F.count("*")).scalar().alias(name) for name, df in matched.items()]).alias("matched_sample_counts"),
        "tumor_count",
        "normal_count",
        "unique_patient_count",
        duplicate_patients(candidates).select("duplicate_patient_count").scalar().alias("duplicate_patient_count"),
        reasons.scalar().alias("excluded_sample_counts_by_reason"),
        available.agg(entries(available, "field", "available")).scalar().alias("available_confounder_counts"),
        per_fold.agg(entries(per_fold, "outer_fold", "c")).scalar().alias("fold_distribution"),
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value, the last one closed; empty bins count 0."""
    low = df.agg(F.min(col)).scalar().cast("double")
    high = df.agg(F.max(col)).scalar().cast("double")
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    # A constant column gets a unit-wide range centred on its value.
    start = F.when(low == high, low - 0.5).otherwise(low)
    width = F.when(low == high, F.lit(1.0)).otherwise(high - low) / F.lit(float(bins))
    index = F.least(F.floor((F.col("v") - start) / width).cast("int"), F.lit(bins - 1))
    counts = values.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (start + F.col("bin") * width).alias("bin_start"),
        (start + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def capped_sample(
    df: DataFrame, label: str, cap: int, seed: int | str | Column, key: str = "sample_id", by: Sequence[str] = ()
) -> DataFrame:
    """Up to ``cap`` rows per class (and per ``by`` group), without replacement, the first in seeded hash order.

    No class is sorted: counted hash prefixes cut it (``bottom_by_hash``).
    """
    hashed = df.withColumn("_h", stable_hash(seed, key))
    return bottom_by_hash(hashed, [*by, label], "_h", [key], cap).drop("_h")
