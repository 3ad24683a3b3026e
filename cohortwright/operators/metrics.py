"""Exact binary-classification metrics, curves and robustness tables, grouped by any columns.

Every threshold-free metric starts from ``score_table``: one row per distinct score of a group with
running class counts. Equal scores are combined map-side, and the running counts are built over
score ranges, so one group may hold any share of the rows. Group columns may be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.functions.arithmetic import ratio

from .distributed import lookup_join, materialize, running_totals
from .selection import Quantile, order_statistics

METRICS = ("auroc", "auprc", "balanced_accuracy", "mcc", "f1", "sensitivity", "specificity", "brier_score")
COUNTS = ("tn", "fp", "fn", "tp")
# The column names that may hold a subgroup, best first.
SUBGROUPS = {
    "sex": ("env_sex", "sex_raw", "sex"),
    "smoking": ("env_smoking", "smoking_raw", "smoking_status"),
    "histology": ("env_histology", "histology_clean", "histology_raw", "histology"),
    "stage": ("env_stage", "stage_raw", "stage"),
    "country_or_region": ("env_country_or_region", "country_raw", "country_or_region"),
}


def score_table(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distinct scores per group, highest first: ``pos``/``neg`` here, ``tp``/``fp`` at or above it.

    ``weight`` is the number of samples a row stands for.
    """
    n = F.lit(1) if weight is None else weight
    counts = df.groupBy(*by, "y_prob").agg(
        F.sum(n * F.col("y_true")).cast("bigint").alias("pos"),
        F.sum(n * (1 - F.col("y_true"))).cast("bigint").alias("neg"),
    )
    return running_totals(
        counts, by, [F.col("y_prob").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, totals=True
    )


def _auroc() -> Column:
    """From score rows: share of (positive, negative) pairs in the right order, ties half."""
    above = F.col("tp") - F.col("pos")
    pairs = F.sum(F.col("neg") * (above + F.col("pos") / F.lit(2.0)))
    return ratio(pairs, F.max("tp_total").cast("double") * F.max("fp_total"))


def _average_precision() -> Column:
    gain = F.sum(F.col("pos") * ratio("tp", F.col("tp") + F.col("fp")))
    return F.when(F.max("fp_total") > 0, ratio(gain, F.max("tp_total")))


def auroc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; NULL when a class is absent."""
    return score_table(df, by).groupBy(*by).agg(_auroc().alias("auroc"))


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision; NULL when a class is absent."""
    return score_table(df, by).groupBy(*by).agg(_average_precision().alias("auprc"))


def confusion(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col("y_prob") >= threshold, F.col("y_true") == 1
    return df.groupBy(*by).agg(
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & pos).alias("tp"),
    )


def _from_confusion() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "balanced_accuracy": F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2.0),
        "mcc": F.coalesce(ratio(tp * tn - fp * fn, spread), F.lit(0.0)),
        "f1": F.coalesce(ratio(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)),
        "sensitivity": sens,
        "specificity": spec,
    }


def threshold_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    return confusion(df, by, threshold).withColumns(_from_confusion())


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), 2)).alias("brier_score"))


def _all_metrics(table: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Metrics and confusion counts of each group of a score table, in one aggregate."""
    score, hit = F.col("y_prob"), F.col("y_prob") >= threshold
    squared = F.sum(F.col("pos") * F.pow(1.0 - score, 2) + F.col("neg") * F.pow(score, 2))
    size = F.sum(F.col("pos") + F.col("neg"))

    def at(test: Column, c: str) -> Column:
        return F.sum(F.when(test, F.col(c)).otherwise(0))

    rows = table.groupBy(*by).agg(
        size.alias("n_samples"),
        F.max("tp_total").alias("n_pos"),
        F.max("fp_total").alias("n_neg"),
        _auroc().alias("auroc"),
        _average_precision().alias("auprc"),
        ratio(squared, size).alias("brier_score"),
        at(~hit, "neg").alias("tn"),
        at(hit, "neg").alias("fp"),
        at(~hit, "pos").alias("fn"),
        at(hit, "pos").alias("tp"),
    )
    return rows.withColumns(_from_confusion())


def binary_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """All metrics and confusion counts of each group, from one score table."""
    return _all_metrics(score_table(df, by), by, threshold).select(*by, "n_samples", *METRICS, *COUNTS)


def roc_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, plus (0, 0); ``threshold`` is NULL there."""
    table = score_table(df, by)
    points = table.select(
        *by, F.col("y_prob").alias("threshold"), ratio("fp", "fp_total").alias("fpr"), ratio("tp", "tp_total").alias("tpr")
    )
    start = table.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per distinct score, plus (precision 1, recall 0)."""
    table = score_table(df, by)
    points = table.select(
        *by,
        F.col("y_prob").alias("threshold"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", "tp_total").alias("recall"),
    )
    start = table.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(start)


def quantile_edges(df: DataFrame, by: Sequence[str], bins: int, adapt: bool) -> DataFrame:
    """Bin edges per group: ``bins + 1`` linear quantiles of the score, as an array.

    ``adapt`` uses ``min(bins, distinct scores)`` bins and drops repeated edges. The quantiles are
    selected among the distinct scores and their counts.
    """
    counts = df.groupBy(*by, "y_prob").agg(F.count("*").alias("n"))
    used = F.least(F.lit(bins).cast("bigint"), F.col("_rows")) if adapt else F.lit(bins).cast("bigint")
    # Beyond the group's own number of bins the last edge repeats and is dropped below.
    wanted = {f"e{i}": Quantile(F.least(F.lit(float(i)) / used, F.lit(1.0))) for i in range(bins + 1)}
    array = F.array(*wanted)
    edges = order_statistics(counts, by, "y_prob", wanted, {"n": F.col("n")})
    return edges.select(*by, (F.array_distinct(array) if adapt else array).alias("edges"))


def calibration(df: DataFrame, by: Sequence[str] = (), bins: int = 10, adapt: bool = True) -> DataFrame:
    """Mean score, observed fraction and size of each quantile bin.

    Bins are closed on the right and the first also holds the lowest score. ``adapt`` drops
    repeated edges and keeps empty bins (NULL means, 0 samples); without it empty bins are dropped.
    """
    edges = materialize(quantile_edges(df, by, bins, adapt).withColumn("_by", F.struct(*by, F.lit(1).alias("_all"))))
    scores = df.groupBy(*by, "y_prob").agg(F.sum("y_true").alias("pos"), F.count("*").alias("n"))
    scores = scores.select(F.struct(*by, F.lit(1).alias("_all")).alias("_by"), "y_prob", "pos", "n")
    placed = lookup_join(scores, edges.select("_by", "edges"), "_by", "inner", stored=True)
    # Bin = inner edges below the score; a score equal to an edge belongs to the bin it closes.
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    below = F.size(F.filter(inner, lambda e: e < F.col("y_prob")))
    filled = placed.groupBy("_by", below.alias("bin")).agg(
        (F.sum(F.col("y_prob") * F.col("n")) / F.sum("n")).alias("mean_predicted_probability"),
        (F.sum("pos").cast("double") / F.sum("n")).alias("observed_fraction"),
        F.sum("n").alias("samples"),
    )
    if adapt:
        last = F.greatest(F.size("edges") - 2, F.lit(0))
        every = edges.select("_by", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
        filled = every.join(filled, ["_by", "bin"], "left").fillna(0, subset=["samples"])
    return filled.select(
        *[F.col(f"_by.{c}") for c in by], "bin", "mean_predicted_probability", "observed_fraction", "samples"
    )


def summarize_models(fold_metrics: DataFrame, oof: DataFrame, model: str = "model_name") -> DataFrame:
    """Mean and sample std of the fold metrics per model, with metrics of the pooled predictions."""
    folds = fold_metrics.groupBy(model).agg(
        *[f(m).alias(f"{m}_{s}") for m in METRICS for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    )
    pooled = binary_metrics(oof, [model])
    return folds.join(pooled.select(model, *[F.col(c).alias(f"pooled_{c}") for c in (*METRICS, *COUNTS)]), model, "left")


def summary_long(fold_metrics: DataFrame, oof: DataFrame, model: str = "model_name") -> DataFrame:
    """Long form ``(model, summary_type, metric, value, std)``: fold means with population std, and pooled values."""
    means = fold_metrics.groupBy(model).agg(*[F.avg(m).alias(m) for m in METRICS])
    stds = fold_metrics.groupBy(model).agg(*[F.stddev_pop(m).alias(m) for m in METRICS])
    names = list(METRICS)
    folds = means.unpivot([model], names, "metric", "value").join(
        stds.unpivot([model], names, "metric", "std"), [model, "metric"]
    )
    pooled = binary_metrics(oof, [model]).select(model, *names).unpivot([model], names, "metric", "value")
    return folds.withColumn("summary_type", F.lit("fold_seed_mean")).unionByName(
        pooled.withColumns({"std": F.lit(None).cast("double"), "summary_type": F.lit("pooled_oof")})
    ).select(model, "summary_type", "metric", "value", "std")


def by_level(df: DataFrame, by: Sequence[str], dims: Sequence[str], column: str, level: str, missing: str | None) -> DataFrame:
    """Scores per (group, dimension, level), combined before the dimensions are stacked."""
    combined = df.groupBy(*by, *dims, "y_prob", "y_true").agg(F.count("*").alias("n"))
    long = combined.select(
        *by, "y_prob", "y_true", "n", *[F.col(d).cast("string").alias(d) for d in dims]
    ).unpivot([*by, "y_prob", "y_true", "n"], list(dims), column, level)
    return long.fillna(missing, subset=[level]) if missing is not None else long


def level_metrics(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """All metrics over rows that carry a multiplicity ``n``."""
    return _all_metrics(score_table(df, by, F.col("n")), by, threshold)


def _only_if(rows: DataFrame, usable: Column) -> DataFrame:
    return rows.withColumns({m: F.when(usable, F.col(m)) for m in (*METRICS, *COUNTS)})


def first_columns(df: DataFrame, dims: Sequence[str] | Mapping[str, Sequence[str]]) -> dict[str, str]:
    """For each dimension the first of its column names that ``df`` has; dimensions without any are left out."""
    options = dims if isinstance(dims, Mapping) else {d: (d,) for d in dims}
    return {d: next(c for c in names if c in df.columns) for d, names in options.items() if set(names) & set(df.columns)}


def subgroup_metrics(
    df: DataFrame, dims: Sequence[str] | Mapping[str, Sequence[str]] = SUBGROUPS, by: Sequence[str] = ("model_name", "seed"),
    min_samples: int = 10, min_class: int = 3,
) -> DataFrame:
    """Metrics per subgroup level, a missing level as ``unknown``; small levels get a status only.

    ``dims``: column names, or for each subgroup its possible column names, of which the first present one is taken.
    """
    columns = first_columns(df, dims)
    own = df.select(*by, "y_prob", "y_true", *[F.col(c).alias(f"_{d}") for d, c in columns.items()])
    long = by_level(own, by, [f"_{d}" for d in columns], "subgroup_name", "subgroup_value", "unknown")
    long = long.withColumn("subgroup_name", F.expr("substr(subgroup_name, 2)"))
    rows = level_metrics(long, [*by, "subgroup_name", "subgroup_value"])
    small = (F.col("n_samples") < min_samples) | (F.least("n_pos", "n_neg") < F.greatest(F.lit(1), F.lit(min_class)))
    rows = _only_if(rows.withColumn("status", F.when(small, "too_small").otherwise("ok")), F.col("status") == "ok")
    return rows.select(*by, "subgroup_name", "subgroup_value", "n_samples", "status", *METRICS, *COUNTS)


def environment_metrics(
    df: DataFrame, dims: Sequence[str], by: Sequence[str] = ("seed", "outer_fold"), min_size: int = 5
) -> DataFrame:
    """Metrics per environment level; statuses ``evaluated``, ``skipped_small`` and ``missing`` (no such column)."""
    have = [d for d in dims if d in df.columns]
    keys = [*by, "environment_column", "environment_level"]
    absent = [d for d in dims if d not in df.columns]
    parts = []
    if have:
        rows = level_metrics(by_level(df, by, have, "environment_column", "environment_level", "Unknown"), keys)
        small = (F.col("n_samples") < min_size) | (F.least("n_pos", "n_neg") == 0)
        rows = rows.withColumn("status", F.when(small, "skipped_small").otherwise("evaluated"))
        rows = _only_if(rows, F.col("status") == "evaluated")
        parts.append(rows.select(*keys, "n_samples", "status", *METRICS, *COUNTS))
    if absent:
        runs = df.select(*by).distinct().withColumn(
            "environment_column", F.explode(F.array(*[F.lit(d) for d in absent]))
        )
        parts.append(runs.withColumns(
            {"environment_level": F.lit("missing"), "n_samples": F.lit(0).cast("bigint"), "status": F.lit("missing")}
        ))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def invariance_summary(env: DataFrame, by: Sequence[str] = ("seed", "outer_fold")) -> DataFrame:
    """Spread over environment levels, for columns with at least two scored levels."""
    return (
        env.groupBy(*by, "environment_column")
        .agg(
            F.count("auroc").alias("n_levels"),
            F.var_pop("balanced_accuracy").alias("environment_risk_variance"),
            (F.max("auroc") - F.min("auroc")).alias("environment_auroc_spread"),
        )
        .filter("n_levels >= 2")
    )


# Fixed value: distance kept from 0 and 1 before taking a logarithm.
CLIP = 1e-15


def risk_variance(df: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Variance over levels of the mean log loss, per environment, and its mean over environments.

    A level needs two rows; an environment needs four known rows and two such levels, else its
    variance is NULL and it does not enter the mean (0 if none is left).
    """
    p = F.least(F.greatest(F.col("y_prob"), F.lit(CLIP)), F.lit(1.0 - CLIP))
    loss = F.when(F.col("y_true") == 1, -F.log(p)).otherwise(-F.log(1.0 - p))
    long = df.select(*by, loss.alias("loss"), *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(
        [*by, "loss"], list(dims), "environment_column", "level"
    )
    known = F.col("level").isNotNull() & ~F.lower(F.trim("level")).isin("unknown", "", "nan", "none")
    levels = long.groupBy(*by, "environment_column", F.when(known, F.trim("level")).alias("level")).agg(
        F.avg("loss").alias("mean_loss"), F.count("*").alias("n")
    )
    coded = F.col("level").isNotNull()
    usable = coded & (F.col("n") >= 2)
    per_env = levels.groupBy(*by, "environment_column").agg(
        F.coalesce(F.sum(F.when(coded, F.col("n"))), F.lit(0)).alias("n_coded"),
        F.count_if(usable).alias("n_levels"),
        F.var_pop(F.when(usable, F.col("mean_loss"))).alias("v"),
    )
    per_env = per_env.select(
        *by, "environment_column", "n_coded", "n_levels",
        F.when((F.col("n_coded") >= 4) & (F.col("n_levels") >= 2), F.col("v")).alias("risk_variance"),
    )
    overall = per_env.groupBy(*by).agg(
        F.lit("all").alias("environment_column"),
        F.sum("n_coded").alias("n_coded"),
        F.sum("n_levels").alias("n_levels"),
        F.coalesce(F.avg("risk_variance"), F.lit(0.0)).alias("risk_variance"),
    )
    return per_env.unionByName(overall)


def _first(model: str, *order: Column) -> Column:
    return F.min_by(model, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(model).alias("name")))


def _desc(c: str) -> Column:
    """Ascending key for a descending order, missing last."""
    return F.coalesce(-F.col(c), F.lit(float("inf")))


def _asc(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(float("inf")))


def pick_winners(summary: DataFrame, model: str = "model_name") -> DataFrame:
    """Best by the five metric keys, best calibrated, and most stable model; ties by name."""
    spread = F.coalesce("auroc_std", F.lit(float("inf"))) + F.coalesce("auprc_std", F.lit(float("inf")))
    return summary.agg(
        _first(
            model, _desc("auroc_mean"), _desc("auprc_mean"), _desc("balanced_accuracy_mean"), _desc("mcc_mean"),
            _asc("brier_score_mean"),
        ).alias("best_baseline"),
        _first(model, _asc("brier_score_mean"), _desc("auroc_mean")).alias("best_calibrated"),
        _first(model, spread, _desc("auroc_mean")).alias("most_stable"),
    )


def long_to_wide(summary: DataFrame, metrics: Sequence[str] = METRICS, model: str = "model_name") -> DataFrame:
    return summary.groupBy(model).pivot("metric", list(metrics)).agg(F.first("value"))


def compare(baseline: DataFrame, candidate: DataFrame, model: str = "model_name") -> DataFrame:
    """The best baseline (wide) beside the candidates (long, pooled), with the AUROC gain over it.

    ``baseline`` may carry pooled columns, plain metric columns, or the long form.
    """
    if {"metric", "value"} <= set(baseline.columns):
        wide = long_to_wide(baseline, model=model)
    elif "pooled_auroc" in baseline.columns:
        wide = baseline.select(model, *[F.col(f"pooled_{m}").alias(m) for m in METRICS])
    else:
        wide = baseline.select(model, *METRICS)
    keys = ("auroc", "auprc", "balanced_accuracy", "mcc")
    best = wide.orderBy(*[F.desc_nulls_last(k) for k in keys], model).limit(1)
    deep = long_to_wide(candidate.filter(F.col("summary_type") == "pooled_oof"), model=model)
    both = best.withColumn("model_family", F.lit("baseline")).unionByName(deep.withColumn("model_family", F.lit("candidate")))
    top = best.select("auroc").scalar()
    return both.withColumn("delta_vs_best_baseline_auroc", F.col("auroc") - top)


def top_models(summary: DataFrame, k: int = 3, keys: Sequence[str] = ("auroc_mean", "auprc_mean"), model: str = "model_name") -> DataFrame:
    return summary.orderBy(*[F.desc_nulls_last(c) for c in keys], model).limit(k).select(model)


def top_calibration(calibration_rows: DataFrame, summary: DataFrame, k: int = 3, model: str = "model_name") -> DataFrame:
    """Mean observed fraction at each mean score, for the top models."""
    kept = calibration_rows.join(top_models(summary, k, model=model), model, "left_semi")
    return kept.filter(F.col("mean_predicted_probability").isNotNull()).groupBy(model, "mean_predicted_probability").agg(
        F.avg("observed_fraction").alias("observed_fraction")
    )


def top_subgroups(subgroups: DataFrame, k: int = 3, model: str = "model_name") -> DataFrame:
    """Mean subgroup AUROC over runs for the models with the best mean."""
    ok = subgroups.filter(F.col("status") == "ok")
    ranking = ok.groupBy(model).agg(F.avg("auroc").alias("auroc_mean"))
    kept = ok.join(top_models(ranking, k, ("auroc_mean",), model), model, "left_semi")
    return kept.groupBy(model, "subgroup_name", "subgroup_value").agg(F.avg("auroc").alias("auroc"))


def env_mean(env: DataFrame) -> DataFrame:
    return env.filter(F.col("status") == "evaluated").groupBy("environment_column").agg(
        F.avg("balanced_accuracy").alias("balanced_accuracy")
    )


def top_weights(weights: DataFrame, k: int = 20) -> DataFrame:
    means = weights.groupBy("gene").agg(F.avg("abs_gate_weight").alias("abs_gate_weight"))
    return means.orderBy(F.desc("abs_gate_weight"), "gene").limit(k)
