"""Steps 3 and 4: nested grouped evaluation of classifiers and of the sparse linear model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwright.operators import joins, metrics, models
from cohortwright.operators.cohort import ENVIRONMENTS
from cohortwright.operators.distributed import materialize
from cohortwright.operators.folds import assert_no_leakage
from cohortwright.operators.keys import assert_unique
from cohortwright.operators.metadata import encodable
from cohortwright.operators.prepare import apply_prep

RUN = ["model_name", "seed", "outer_fold"]


def align(cohort: DataFrame, folds: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cohort with folds and the matrix rows of the samples all three tables share, checked for leakage."""
    assert_unique(cohort, "sample_id", "cohort")
    assert_unique(folds, "sample_id", "folds")
    shared = materialize(
        joins.shared_keys(cohort, folds, matrix.select("sample_id").distinct(), require=True)
    )
    aligned = materialize(joins.restrict(joins.attach_folds(cohort, folds), shared))
    assert_no_leakage(aligned)
    return aligned, joins.restrict(matrix, shared)


def fold_facts(cohort: DataFrame, log: DataFrame) -> DataFrame:
    """Per (model, seed, fold): train and test samples and patients, and the chosen parameters.

    Patients never cross folds, so the training side is the total minus the fold.
    """
    per_fold = cohort.groupBy("outer_fold").agg(
        F.count("*").alias("n_test_samples"), F.count_distinct("patient_id").alias("n_test_patients")
    )
    samples = per_fold.agg(F.sum("n_test_samples")).scalar()
    patients = per_fold.agg(F.sum("n_test_patients")).scalar()
    sizes = per_fold.withColumns(
        {
            "n_train_samples": samples - F.col("n_test_samples"),
            "n_train_patients": patients - F.col("n_test_patients"),
        }
    )
    return log.select(*RUN, "best_params_json").distinct().join(sizes, "outer_fold")


def latent_space(cohort: DataFrame, matrix: DataFrame, prep: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Two-dimensional projection of every sample, prepared with the statistics of its held-out fold."""
    placed = matrix.join(cohort.select("sample_id", "patient_id", "disease_label", "outer_fold"), "sample_id")
    keys = ["sample_id", "patient_id", "disease_label", "outer_fold"]
    vectors = materialize(models.assemble(apply_prep(placed, prep), genes, keys))
    return models.pca2(vectors).select(*keys, "latent_1", "latent_2")


def evaluate_baselines(
    cohort: DataFrame,
    folds: DataFrame,
    matrix: DataFrame,
    grids: Mapping[str, Mapping | Sequence[dict] | None] | None = None,
    seeds: Sequence[int] = (42, 52, 62, 72, 82),
    dims: Sequence[str] | Mapping[str, Sequence[str]] = metrics.SUBGROUPS,
    bins: int = 10,
    save_to: str | None = None,
    **search,
) -> dict[str, DataFrame]:
    """Out-of-fold predictions of every model with metrics, calibration, subgroups and winners."""
    aligned, long = align(cohort, folds, matrix)
    grids = grids or {name: None for name in models.DEFAULT_MODELS}
    out = models.oof_predict(long, aligned, grids, seeds, save_to=save_to, **search)
    scored = out["predictions"]
    per_fold = materialize(metrics.binary_metrics(scored, RUN).join(fold_facts(aligned, out["log"]), RUN))
    have = metrics.first_columns(aligned, dims)
    placed = joins.enrich(scored, aligned.select("sample_id", *dict.fromkeys(have.values())), "sample_id")
    summary = materialize(metrics.summarize_models(per_fold, scored))
    winners = materialize(metrics.pick_winners(summary))
    best = scored.filter(F.col("model_name") == winners.select("best_baseline").scalar())
    tables = {
        "predictions": scored,
        "fold_metrics": per_fold,
        "search_log": out["log"],
        "feature_summary": out["feature_summary"],
        "calibration": metrics.calibration(scored, RUN, bins),
        "summary": summary,
        "winners": winners,
        "best_confusion": metrics.confusion(best, ["model_name"]),
        "roc": metrics.roc_points(scored, ["model_name"]),
        "pr": metrics.pr_points(scored, ["model_name"]),
    }
    if have:
        tables["subgroups"] = metrics.subgroup_metrics(placed, {d: (c,) for d, c in have.items()})
    return tables


def evaluate_sparse(
    cohort: DataFrame,
    folds: DataFrame,
    matrix: DataFrame,
    baselines: DataFrame,
    grid: Mapping | Sequence[dict] | None = None,
    seeds: Sequence[int] = (42, 52, 62, 72, 82),
    dims: Sequence[str] = ENVIRONMENTS,
    **search,
) -> dict[str, DataFrame]:
    """The sparse linear model: weights per run, environment robustness and gain over the baselines."""
    aligned, long = align(cohort, folds, matrix)
    out = models.oof_predict(long, aligned, {"LR_L1": grid}, seeds, **search)
    scored = out["predictions"]
    per_fold = materialize(metrics.binary_metrics(scored, RUN))
    have = [d for d in dims if d in aligned.columns]
    placed = joins.enrich(scored, aligned.select("sample_id", *have), "sample_id")
    env = materialize(metrics.environment_metrics(placed, dims))
    used = metrics.invariance_summary(env).withColumns({"status": F.lit("used"), "reason": F.lit("evaluated")})
    skipped = encodable(aligned, dims).filter("reason <> 'usable'").select(
        F.col("column").alias("environment_column"), F.lit("skipped").alias("status"), "reason"
    )
    gates = materialize(models.flag_top(out["weights"].drop("model_name")))
    summary = metrics.summary_long(per_fold, scored)
    sparsity = models.sparsity_share(gates)
    facts = fold_facts(aligned, out["log"]).join(out["feature_summary"], "outer_fold").join(
        sparsity, ["seed", "outer_fold"]
    )
    # Genes every fold selected: a subset of one fold's selection, so its bound holds here too.
    n_folds = gates.select("outer_fold").distinct().count()
    common = gates.groupBy("gene").agg(F.size(F.collect_set("outer_fold")).alias("n")).filter(F.col("n") == n_folds)
    genes = sorted(r["gene"] for r in common.collect())
    tables = {
        "predictions": scored,
        "fold_metrics": per_fold.join(facts, RUN),
        "search_log": out["log"],
        "gate_weights": gates,
        "sparsity": sparsity,
        "latent": latent_space(aligned, long, out["prep"], genes) if len(genes) > 1 else None,
        "roc": metrics.roc_points(scored, ["model_name"]),
        "pr": metrics.pr_points(scored, ["model_name"]),
        "calibration": metrics.calibration(scored, ["model_name"], 8, adapt=False),
        "history": out["history"],
        "environment_metrics": env,
        "invariance": used.unionByName(skipped, allowMissingColumns=True),
        "summary": summary,
        "comparison": metrics.compare(baselines, summary),
        "prep": out["prep"],
    }
    return {name: table for name, table in tables.items() if table is not None}
