"""Group-safe stratified folds and the checks for leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.functions.hashing import stable_hash

from .distributed import number_by_hash


def labelled_groups(df: DataFrame, group: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with its label (see ``assert_group_pure``)."""
    return df.filter(F.col(group).isNotNull()).groupBy(*by, group).agg(F.max(label).alias(label))


def impure_groups(df: DataFrame, group: str = "patient_id", label: str = "disease_label") -> DataFrame:
    """Groups carrying more than one label; minimum and maximum suffice to tell."""
    return (
        df.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(F.min(label).alias("min_label"), F.max(label).alias("max_label"))
        .filter("min_label <> max_label")
    )


def assert_group_pure(df: DataFrame, group: str = "patient_id", label: str = "disease_label") -> DataFrame:
    bad = [r[0] for r in impure_groups(df, group, label).limit(10).collect()]
    if bad:
        raise ValueError(f"Groups with more than one label: {bad}")
    return df


def grouped_folds(
    df: DataFrame, group: str = "patient_id", label: str = "disease_label", k: int = 5, seed: int = 42,
    name: str = "outer_fold", check: bool = True,
) -> DataFrame:
    """Assign every row a fold; all rows of a group share it and each class is dealt round robin.

    Groups are dealt in seeded hash order within their label, so the classes of two folds differ by
    at most one group. Sizes of groups are not balanced.
    """
    if check:
        assert_group_pure(df, group, label)
        few = labelled_groups(df, group, label).limit(k).count()
        if few < k:
            raise ValueError(f"Cannot deal {few} groups into {k} folds")
    return df.join(deal_groups(labelled_groups(df, group, label), group, label, k, seed, name).select(group, name), group)


def deal_groups(
    groups: DataFrame, group: str, label: str, k: int | Column, seed: int, name: str, by: Sequence[str] = ()
) -> DataFrame:
    hashed = groups.withColumn("_h", stable_hash(seed, *by, group))
    placed = number_by_hash(hashed, [*by, label], "_h", [group], "_place")
    size = F.lit(k) if isinstance(k, int) else k
    return placed.withColumn(name, ((F.col("_place") - 1) % size + 1).cast("int")).drop("_h", "_place")


def leaking_groups(df: DataFrame, group: str = "patient_id", fold: str = "outer_fold") -> DataFrame:
    """Groups found in more than one fold."""
    return (
        df.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(F.min(fold).alias("min_fold"), F.max(fold).alias("max_fold"))
        .filter("min_fold <> max_fold")
    )


def fold_facts(df: DataFrame, label: str = "disease_label", fold: str = "outer_fold") -> DataFrame:
    """One row: rows without a fold, rows with a non-binary label, and whether there are two folds."""
    return df.agg(
        F.count_if(F.col(fold).isNull()).alias("missing_fold"),
        F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("bad_label"),
        F.coalesce(F.min(fold) != F.max(fold), F.lit(False)).alias("several_folds"),
    )


def assert_no_leakage(
    df: DataFrame, group: str = "patient_id", label: str = "disease_label", fold: str = "outer_fold"
) -> DataFrame:
    facts = fold_facts(df, label, fold).first()
    if facts["missing_fold"]:
        raise ValueError(f"{facts['missing_fold']} rows have no fold")
    if facts["bad_label"]:
        raise ValueError("Labels must be 0 or 1")
    if not facts["several_folds"]:
        raise ValueError("At least two folds are required")
    assert_group_pure(df, group, label)
    bad = [r[0] for r in leaking_groups(df, group, fold).limit(10).collect()]
    if bad:
        raise ValueError(f"Groups in more than one fold: {bad}")
    return df


def expand_folds(df: DataFrame, folds: Sequence[int], fold: str = "outer_fold", name: str = "held_out") -> DataFrame:
    """Every row once per held-out fold, with its role there.

    The folds are a literal array, so no join takes place; ``k`` copies are the point of the result.
    An empty side is an error.
    """
    present = {r[0] for r in df.filter(F.col(fold).isin(*folds)).select(fold).distinct().limit(len(folds)).collect()}
    if present != set(folds) or len(folds) < 2:
        raise ValueError(f"Folds {sorted(set(folds) - present) or list(folds)} leave an empty train or test side")
    role = F.when(F.col(fold) == F.col(name), "test").otherwise("train")
    return df.withColumn(name, F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn("role", role)


def inner_folds(
    df: DataFrame, folds: Sequence[int], k: int = 3, seed: int = 42,
    group: str = "patient_id", label: str = "disease_label", fold: str = "outer_fold",
) -> DataFrame:
    """Inner folds of each outer training part, for groups: ``(held_out, group, label, inner_fold)``.

    The number of inner folds is ``min(k, groups, smallest class)`` per outer fold; under two is an
    error. Only one row per group is expanded, never the samples.
    """
    groups = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max(label).alias(label), F.max(fold).alias(fold))
    train = groups.withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in folds]))).filter(
        F.col("held_out") != F.col(fold)
    )
    sizes = train.groupBy("held_out", label).agg(F.count("*").alias("n")).groupBy("held_out").agg(
        F.min("n").alias("smallest"), F.sum("n").alias("all_groups")
    )
    feasible = {r["held_out"]: min(k, r["smallest"], r["all_groups"]) for r in sizes.collect()}
    short = sorted(f for f in folds if feasible.get(f, 0) < 2)
    if short:
        raise ValueError(f"Outer folds {short} have fewer than two groups per class for inner folds")
    size = F.create_map(*[F.lit(x) for f in folds for x in (f, feasible[f])])[F.col("held_out")]
    dealt = deal_groups(train, group, label, size, seed, "inner_fold", by=["held_out"])
    return dealt.select("held_out", group, label, "inner_fold")
