"""Imputation, scaling, selection and splits over the long matrix ``(sample_id, gene, value)``.

Statistics are combinable aggregates, stored once and looked up by each row. Train-only statistics
of all folds come from one pass over the matrix: what a fold's training part holds is the total
minus that fold, so rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.functions.hashing import stable_hash

from .distributed import (
    lookup_join,
    materialize,
    number_by_hash,
    number_rows,
    value_counts,
)
from .joins import join_1to1
from .selection import Quantile, exact_quantiles, order_statistics

# Share of extreme genes that marks an outlier, and the log-scale range test.
OUTLIER_SHARE = 0.01
NORMALIZED_RANGE = (0.0, 50.0)
MIN_VARIANCE = 1e-12


def impute(long: DataFrame, by: str = "gene", stat: str = "mean") -> DataFrame:
    """Fill missing values with the group's mean or median."""
    if stat == "mean":
        fill = long.groupBy(by).agg(F.avg("value").alias("_fill"))
    else:
        fill = exact_quantiles(long, [by], "value", {"_fill": 0.5})
    return lookup_join(long, fill, by).withColumn("value", F.coalesce("value", "_fill")).drop("_fill")


def metadata_fills(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: strategy (median or mode), fill value as text and number of missing cells.

    Ties for the mode go to the smallest value; a column without values is filled with ``Unknown``.
    """
    numeric = [c for c, kind in df.dtypes if c in cols and kind not in ("string", "boolean")]
    text = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        pairs = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column", "v")
        medians = exact_quantiles(pairs, ["column"], "v", {"fill": 0.5})
        parts.append(medians.select("column", F.lit("median").alias("strategy"), F.col("fill").cast("string")))
    if text:
        pairs = df.select(*[F.col(c).cast("string").alias(c) for c in text]).unpivot([], text, "column", "v")
        modes = (
            value_counts(pairs, ["column"], "v").groupBy("column")
            .agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("fill"))
        )
        parts.append(modes.select("column", F.concat(F.lit("mode:"), "fill").alias("strategy"), "fill"))
    fills = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "filled_values"
    )
    kinds = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(c in numeric))])
    plain = F.when(kinds[F.col("column")], "median").otherwise("mode:Unknown")
    return missing.join(fills, "column", "left").select(
        "column",
        F.coalesce("strategy", plain).alias("strategy"),
        F.coalesce("fill", F.when(~kinds[F.col("column")], "Unknown")).alias("fill"),
        "filled_values",
    )


def impute_metadata(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Median for numeric and mode for text columns; returns the filled table and the log of fills."""
    log = materialize(metadata_fills(df, cols))
    kinds = dict(df.dtypes)
    # One value per column of the schema comes back to the driver.
    fills = {r["column"]: r["fill"] for r in log.collect() if r["fill"] is not None}
    filled = df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v).cast("double" if kinds[c] not in ("string", "boolean") else kinds[c]))
            for c, v in fills.items()
        }
    )
    return filled, log.select("column", "strategy", "filled_values")


def auto_log2(long: DataFrame, force: bool = False) -> DataFrame:
    """``log2(x + 1)`` unless the whole matrix already lies in the log-scale range."""
    low, high = NORMALIZED_RANGE
    if force:
        return long.withColumns({"value": F.log2(F.col("value") + 1.0), "method": F.lit("log2(x + 1)")})
    normalized = long.agg(((F.min("value") >= low) & (F.max("value") <= high)).alias("n")).scalar()
    return long.withColumns(
        {
            "value": F.when(normalized, F.col("value")).otherwise(F.log2(F.col("value") + 1.0)),
            "method": F.when(normalized, "pre-normalized input retained").otherwise("log2(x + 1)"),
        }
    )


def gene_moments(long: DataFrame) -> DataFrame:
    return long.groupBy("gene").agg(
        F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_std"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    )


def scale(long: DataFrame, method: str = "zscore") -> DataFrame:
    """Z-score (population std) or min-max per gene; a constant gene or a missing value gives 0."""
    if method == "none":
        return long
    stats = gene_moments(long)
    if method == "zscore":
        shift, width = F.col("_mean"), F.col("_std")
    elif method == "minmax":
        shift, width = F.col("_min"), F.col("_max") - F.col("_min")
    else:
        raise ValueError(f"Unknown scaling method '{method}'")
    # The per-gene table holds the shift and a non-zero width only: the smallest lookup that serves.
    table = stats.select("gene", shift.alias("_shift"), F.nullif(width, F.lit(0.0)).alias("_width"))
    scaled = F.coalesce((F.col("value") - F.col("_shift")) / F.col("_width"), F.lit(0.0))
    return lookup_join(long, table, "gene").withColumn("value", scaled).drop("_shift", "_width")


def variance_ranks(long: DataFrame) -> DataFrame:
    """Genes by falling sample variance, with rank and number of genes."""
    variances = long.groupBy("gene").agg(F.var_samp("value").alias("variance"))
    return number_rows(variances, [], [F.desc_nulls_last("variance"), "gene"], "rank", total=True)


def top_variance(long: DataFrame, percent: float) -> DataFrame:
    """Rows of the top ``ceil(n * percent / 100)`` genes by sample variance, at least one."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in (0, 100]")
    keep = F.greatest(F.lit(1), F.ceil(F.col("rank_total") * (percent / 100.0)))
    chosen = variance_ranks(long).filter(F.col("rank") <= keep).select("gene")
    return lookup_join(long, chosen, "gene", "left_semi")


def outlier_scores(long: DataFrame, t: float = 3.0) -> DataFrame:
    """Per sample the share of genes with ``abs(z) > t``, flagged above one percent."""
    z = scale(long, "zscore")
    return z.groupBy("sample_id").agg(F.avg((F.abs("value") > t).cast("int")).alias("extreme_fraction")).withColumn(
        "is_outlier", F.col("extreme_fraction") > OUTLIER_SHARE
    )


def drop_outliers(long: DataFrame, t: float = 3.0) -> DataFrame:
    """Rows of the samples that are not outliers; an empty result is an error."""
    # One row per kept sample: far smaller than the matrix, but not bounded, so its size decides the join.
    kept = materialize(outlier_scores(long, t).filter(~F.col("is_outlier")).select("sample_id"))
    if kept.isEmpty():
        raise ValueError("Outlier filtering removed every sample")
    return lookup_join(long, kept, "sample_id", "left_semi", stored=True)


def stratified_split(
    df: DataFrame, label: str, frac: float, seed: int, key: str = "sample_id"
) -> DataFrame:
    """Mark ``ceil(frac * n)`` rows per class as test, in seeded hash order.

    Without two classes of at least two rows each the split is not stratified.
    """
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).count()
    facts = sizes.agg(F.count("*").alias("classes"), F.min("count").alias("smallest")).first()
    by = [label] if facts["classes"] > 1 and facts["smallest"] >= 2 else []
    hashed = df.withColumn("_h", stable_hash(seed, key))
    placed = number_by_hash(hashed, by, "_h", [key], "_place", total=True)
    test = F.col("_place") <= F.ceil(F.col("_place_total") * F.lit(frac))
    return placed.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_place", "_place_total")


def fold_ids(df: DataFrame, fold: str = "outer_fold", most: int = 1000) -> list[int]:
    """Sorted fold ids of a fold table (a handful by design; a large number is an error)."""
    ids = sorted(r[0] for r in df.filter(F.col(fold).isNotNull()).select(fold).distinct().limit(most + 1).collect())
    if len(ids) > most:
        raise ValueError(f"'{fold}' has more than {most} values and is no fold column")
    return ids


def _train_part(name: str, fold: int) -> Column:
    others = F.filter("_parts", lambda p: p["fold"] != fold)
    n = F.aggregate(others, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    rows = F.aggregate(others, F.lit(0).cast("bigint"), lambda a, p: a + p["rows"])
    total = F.aggregate(others, F.lit(0.0), lambda a, p: a + F.coalesce(p["n"] * p["mean"], F.lit(0.0)))
    return F.struct(F.lit(fold).alias("outer_fold"), n.alias("n"), rows.alias("rows"), total.alias("total")).alias(name)


def training_stats(
    long: DataFrame, folds: Sequence[int], fold: str = "outer_fold", medians: bool = False
) -> DataFrame:
    """For every held-out fold and gene, statistics of the other folds' rows.

    Columns: ``n`` observed and ``missing`` training values, ``mean``, ``variance`` (sample) and with
    ``medians`` also ``median`` and the mean and population std after median imputation.
    """
    per_fold = long.groupBy("gene", fold).agg(
        F.count("value").alias("n"),
        F.count("*").alias("rows"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
    )
    # One short array per gene, with one entry per fold.
    parts = per_fold.groupBy("gene").agg(
        F.collect_list(F.struct(F.col(fold).alias("fold"), "n", "rows", "mean", "var")).alias("_parts")
    )
    trains = parts.withColumn("_train", F.explode(F.array(*[_train_part("t", f) for f in folds])))
    trains = trains.select(
        "gene", F.col("_train.outer_fold").alias("outer_fold"), F.col("_train.n").alias("n"),
        (F.col("_train.rows") - F.col("_train.n")).alias("missing"),
        (F.col("_train.total") / F.nullif(F.col("_train.n"), F.lit(0))).alias("mean"), "_parts",
    )
    # Spread within the other folds plus spread of their means around the training mean.
    spread = F.aggregate(
        F.filter("_parts", lambda p: p["fold"] != F.col("outer_fold")),
        F.lit(0.0),
        lambda a, p: a + F.coalesce(p["n"] * (p["var"] + F.pow(p["mean"] - F.col("mean"), 2)), F.lit(0.0)),
    )
    stats = trains.withColumn("_spread", spread).select(
        "gene", "outer_fold", "n", "missing", "mean", "_spread",
        (F.col("_spread") / F.nullif(F.col("n") - 1, F.lit(0))).alias("variance"),
    )
    if not medians:
        return stats.drop("_spread")
    middle = training_medians(long, folds, fold)
    joined = stats.join(middle, ["gene", "outer_fold"], "left")
    rows = F.col("n") + F.col("missing")
    fill = F.coalesce(F.col("missing") * F.col("median"), F.lit(0.0))
    joined = joined.withColumn("mean_imputed", (F.col("n") * F.col("mean") + fill) / F.nullif(rows, F.lit(0)))
    shift = F.col("n") * F.pow(F.col("mean") - F.col("mean_imputed"), 2)
    filled = F.col("missing") * F.pow(F.col("median") - F.col("mean_imputed"), 2)
    return joined.withColumn(
        "std_imputed", F.sqrt((F.col("_spread") + shift + filled) / F.nullif(rows, F.lit(0)))
    ).drop("_spread")


def training_medians(long: DataFrame, folds: Sequence[int], fold: str = "outer_fold") -> DataFrame:
    """Exact training median per gene and held-out fold: ranks among all rows minus the fold's own."""
    counts = {"n": F.lit(1)} | {f"n_{f}": F.when(F.col(fold) == f, 1).otherwise(0) for f in folds}
    medians = order_statistics(long, ["gene"], "value", {str(f): Quantile(0.5, "n", minus=f"n_{f}") for f in folds}, counts)
    return medians.unpivot(["gene"], [f"`{f}`" for f in folds], "_fold", "median").select(
        "gene", F.col("_fold").cast("int").alias("outer_fold"), "median"
    )


def select_features(
    stats: DataFrame, top: int = 5000, least: int = 1000, most: int = 8000
) -> DataFrame:
    """Genes kept per held-out fold: varying in training, the ``max(top, least)`` most variable, at most ``most``."""
    if top > most:
        raise ValueError(f"top={top} exceeds most={most}; raise ``most`` to keep more genes")
    varying = stats.filter(F.col("variance") > MIN_VARIANCE)
    ranked = number_rows(varying, ["outer_fold"], [F.desc("variance"), "gene"], "rank", total=True)
    return ranked.filter(F.col("rank") <= min(max(top, least), most)).withColumnRenamed("rank_total", "retained")


def fit_prep(long: DataFrame, folds: Sequence[int], fold: str = "outer_fold") -> DataFrame:
    """Training median, and mean and population std after imputation, per (held-out fold, gene)."""
    return training_stats(long, folds, fold, medians=True)


def apply_prep(long: DataFrame, stats: DataFrame, on: Sequence[str] = ("gene", "outer_fold")) -> DataFrame:
    """Impute and standardize rows with fitted statistics; genes without statistics drop out."""
    table = stats.select(*on, "median", "mean_imputed", "std_imputed")
    joined = lookup_join(long, table, list(on), "inner")
    width = F.coalesce(F.nullif(F.col("std_imputed"), F.lit(0.0)), F.lit(1.0))
    value = (F.coalesce("value", "median") - F.col("mean_imputed")) / width
    return joined.withColumn("value", value).drop("median", "mean_imputed", "std_imputed")


def labelled_set(x: DataFrame, y: DataFrame, key: str | Sequence[str] = "sample_id") -> DataFrame:
    """Features with their labels; a repeated key on either side is an error."""
    return join_1to1(x, y, key)


