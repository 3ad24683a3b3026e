"""Equi-joins, key sets and tagged unions with the checks that guard them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.functions.arithmetic import as_column

from .distributed import lookup_join, materialize
from .keys import assert_unique

# The tiers of a barcode match and the id names that allow the patient tier.
TIERS = (
    ("exact barcode match", "harmonized_id"),
    ("sample barcode match", "harmonized_sample_id"),
    ("patient barcode fallback", "harmonized_patient_id"),
)
PATIENT_ID_NAMES = ("patient", "bcr_patient_barcode", "patient_id", "patientid")


def tiers_for(id_col: str) -> tuple[tuple[str, str], ...]:
    return TIERS if id_col in PATIENT_ID_NAMES else TIERS[:2]


def tier_facts(left: DataFrame, right: DataFrame, tiers: Sequence[tuple[str, str]] = TIERS) -> DataFrame:
    """Per tier (its place in ``tiers``): left rows with a partner, and the most rows of one key on either side."""

    def keyed(df: DataFrame, left_: int, right_: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("tier"), F.col(key).cast("string").alias("key")) for i, (_, key) in enumerate(tiers)])
        rows = df.select(F.explode(pairs).alias("t")).select("t.*").filter(F.col("key").isNotNull())
        return rows.withColumns({"n_left": F.lit(left_), "n_right": F.lit(right_)})

    per_key = keyed(left, 1, 0).union(keyed(right, 0, 1)).groupBy("tier", "key").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return per_key.groupBy("tier").agg(
        F.sum(F.when(F.col("n_right") > 0, F.col("n_left")).otherwise(0)).alias("matches"),
        F.max("n_left").alias("most_left"), F.max("n_right").alias("most_right"),
    )


def tiered_join(
    left: DataFrame, right: DataFrame, tiers: Sequence[tuple[str, str]] = TIERS, one_to_one: bool = True
) -> DataFrame:
    """Inner join on the first tier with any match; one tier serves the whole table.

    The result carries ``merge_strategy`` and ``match_count`` (left rows with a partner). Right
    columns that also exist on the left get the suffix ``_metadata``. One aggregate over the keys of all tiers and
    both sides gives every tier's matches and repeats, so each side is read once before the join itself.
    """
    facts = {r["tier"]: r for r in tier_facts(left, right, tiers).collect()}  # one row per tier
    for i, (strategy, key) in enumerate(tiers):
        matches = facts[i]["matches"] if i in facts else 0
        if not matches:
            continue
        keyed_left, keyed_right = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
        if one_to_one:
            for side, df in (("left", keyed_left), ("right", keyed_right)):
                if facts[i][f"most_{side}"] > 1:
                    assert_unique(df, key, f"{side} table")  # names the keys
        renamed = keyed_right.select(
            *[F.col(c).alias(f"{c}_metadata" if c in left.columns and c != key else c) for c in right.columns]
        )
        return keyed_left.join(renamed, key).withColumns(
            {"merge_strategy": F.lit(strategy), "match_count": F.lit(matches).cast("bigint")}
        )
    raise ValueError(f"No tier of {[k for _, k in tiers]} matches any row")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each side without a partner; a missing key counts as unmatched."""
    return left.join(right.select(key), key, "left_anti"), right.join(left.select(key), key, "left_anti")


def shared_keys(*dfs: DataFrame, key: str = "sample_id", require: bool = False) -> DataFrame:
    """Distinct non-missing keys present in every table."""
    keys = reduce(lambda a, b: a.intersect(b), [d.select(key).filter(F.col(key).isNotNull()) for d in dfs])
    if require and keys.isEmpty():
        raise ValueError(f"No shared values of '{key}' across {len(dfs)} tables")
    return keys


def restrict(df: DataFrame, keys: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def attach_folds(cohort: DataFrame, folds: DataFrame, key: str = "sample_id") -> DataFrame:
    """Cohort rows with their fold columns; a column both sides carry keeps the cohort's value."""
    extra = [c for c in folds.columns if c == key or c not in cohort.columns]
    return cohort.join(folds.select(*extra), key)


def align_matrix(
    long: DataFrame, cohort: DataFrame, key: str = "sample_id", order: Column | str | None = None
) -> DataFrame:
    """Matrix rows of exactly the cohort's samples; a cohort sample without rows is an error.

    With ``order`` (the source row position) repeated samples keep their first row. The matrix is shuffled once, for
    that; the check reads its combined sample ids, and the cohort is a lookup table whose size decides the join.
    """
    wanted = materialize(cohort.select(key).distinct())
    present = long.select(key).distinct()
    missing = [r[0] for r in wanted.join(present, key, "left_anti").limit(10).collect()]
    if missing:
        raise ValueError(f"Matrix lacks cohort samples: {missing}")
    aligned = lookup_join(long, wanted, key, "left_semi", stored=True)
    if order is None:
        return aligned
    return aligned.groupBy(key, "gene").agg(F.min_by("value", as_column(order)).alias("value"))


def enrich(df: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join of a dimension; the planner picks the strategy from the measured size."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(dim.select(*keys, *[c for c in dim.columns if c not in df.columns]), keys, "left")


def fuse_evidence(
    attribution: DataFrame,
    gates: DataFrame,
    stability: DataFrame,
    invariance: DataFrame | None = None,
    perturbation: DataFrame | None = None,
    key: str = "gene",
) -> DataFrame:
    """One row per entity seen in any score part; missing scores are 0, side evidence joins left."""
    fused = attribution.join(gates, key, "full").join(stability, key, "full")
    for part in (invariance, perturbation):
        if part is not None:
            fused = fused.join(part, key, "left")
    scores = [c for c in fused.columns if c.endswith("_score")]
    return fused.fillna(0.0, subset=scores)


def join_1to1(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    assert_unique(left, key, "left table")
    assert_unique(right, key, "right table")
    return left.join(right, [key] if isinstance(key, str) else list(key), how)


def union_logs(logs: Sequence[tuple[DataFrame, str | None]], column: str = "exclusion_reason") -> DataFrame:
    """Bag union of excluded rows; a tag fills the reason column, ``None`` keeps the rows' own."""
    tagged = [df if tag is None else df.withColumn(column, F.lit(tag)) for df, tag in logs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_runs(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sorted_output(df: DataFrame, keys: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Total order for a sink, missing values last; end ``keys`` with a unique id."""
    return df.orderBy(*[F.desc_nulls_last(k) if k in descending else F.asc_nulls_last(k) for k in keys])


def primary_rows(df: DataFrame, supported: str = "primary_supported_sample", patient: str = "patient_id") -> DataFrame:
    """Rows of a supported type; a missing patient key anywhere in the table is an error."""
    lost = df.agg(F.count_if(F.col(patient).isNull()).alias("n")).first()["n"]
    if lost:
        raise ValueError(f"{lost} rows have no '{patient}'")
    return df.filter(F.col(supported))
