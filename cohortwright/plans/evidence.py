"""Step 5: fuse attribution, weights, stability, invariance and perturbation into one ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwright.operators import cohort as c
from cohortwright.operators import joins
from cohortwright.operators import ranking as r
from cohortwright.operators.distributed import lookup_join, materialize
from cohortwright.operators.prepare import apply_prep


def rank_evidence(
    cohort: DataFrame,
    matrix: DataFrame,
    gates: DataFrame,
    prep: DataFrame | None = None,
    sets: DataFrame | None = None,
    dims: Sequence[str] = c.ENVIRONMENTS,
    methods: Sequence[str] = r.METHODS,
    weights: Mapping[str, float] = r.WEIGHTS,
    cap_per_class: int | None = None,
    n_perturb: int | None = None,
    q: float = 0.1,
    min_rows: int = 10,
    n_boot: int = 100,
    seed: int = 42,
    normalize: bool = False,
) -> dict[str, DataFrame]:
    """Ranked genes from per-run weights, the cohort with folds, and the long matrix.

    ``gates`` is ``(seed, outer_fold, gene, gate_weight, abs_gate_weight, selected_flag[,
    intercept])``. With ``prep`` (training statistics per fold and gene) values are imputed and
    scaled as the models saw them. ``normalize`` min-max scales the score parts, and again within each bootstrap iteration.
    """
    samples = cohort.select("sample_id", "disease_label", "outer_fold")
    long = matrix.select("sample_id", "gene", "value").join(samples, "sample_id")
    if prep is not None:
        long = apply_prep(long, prep)
    long = materialize(long)
    gates = materialize(gates)
    scorer = gates.select(*r.RUN, "gene", F.col("gate_weight").alias("weight"))

    gate_run, gate_gene = r.aggregate_weights(gates)
    # All held-out samples are attributed; ``cap_per_class`` draws some per fold and class on request.
    attributed = long
    if cap_per_class is not None:
        attributed = joins.restrict(long, c.capped_sample(samples, "disease_label", cap_per_class, seed, by=["outer_fold"]))
    attr = materialize(r.attribute(attributed, scorer, methods))
    per_run = materialize(r.attribution_by_run(attr))
    by_method, attr_gene = r.attribution_by_gene(per_run)
    scores = materialize(r.run_scores(per_run, gate_run))
    stable = materialize(r.stability(scores))

    attr_part = attr_gene.select("gene", "attribution_score", "signed_attribution_score")
    gate_part = gate_gene.select(
        "gene", F.col("mean_abs_gate_weight").alias("gate_score"), "mean_gate_weight", "gate_selection_frequency"
    )
    stable_part = stable.withColumnRenamed("stability_score_raw", "stability_score")
    perturbed = long
    if n_perturb is not None:
        top = materialize(r.preselect(joins.fuse_evidence(attr_part, gate_part, stable_part), n_perturb).select("gene"))
        perturbed = joins.restrict(long, top, "gene")
    refs = r.class_reference(perturbed, q, by=["outer_fold", "gene"])
    intercepts = gates.select(*r.RUN, "intercept").distinct() if "intercept" in gates.columns else None
    pert = materialize(r.perturb(long, scorer, refs, intercepts))
    pert_run = r.perturb_by_run(pert)
    pert_gene = materialize(r.perturb_by_gene(pert_run))
    have = [d for d in dims if d in cohort.columns]
    effects = materialize(r.environment_effects(attr, pert, cohort, have, min_rows)) if have else None
    invariant = r.invariance(effects) if have else None

    fused = joins.fuse_evidence(
        attr_part, gate_part, stable_part,
        r.invariance_by_gene(invariant) if have else None, pert_gene,
    )
    if not have:
        fused = fused.withColumn("invariance_score", F.lit(0.0))
    fused = materialize(r.normalize_scores(fused) if normalize else fused)
    boot = materialize(r.bootstrap_arrays(fused, scores, n_boot, seed, weights, normalize)) if n_boot else None
    scored = r.composite(fused, weights)
    if boot is not None:
        scored = lookup_join(scored, r.bootstrap_ci(boot), "gene")
    ranked = materialize(r.rank_entities(scored))
    tables = {
        "attribution_summary": by_method,
        "gate_summary": gate_gene,
        "run_scores": scores,
        "stability": stable,
        "perturbation_samples": pert,
        "perturbation_runs": pert_run,
        "perturbation_summary": pert_gene,
        "ranked": ranked,
        "top25": r.top_n(ranked, 25),
        "top100": r.top_n(ranked, 100),
        "top_effects": r.ranked_effects(ranked, pert_gene.select("gene", "mean_delta_prob_tumor", "mean_delta_prob_normal", "logit_shift")),
    }
    if have:
        tables |= {"environment_effects": effects, "invariance": invariant}
    if boot is not None:
        tables["bootstrap"] = r.rank_iterations(boot)
    if sets is not None:
        tables["set_summary"] = r.set_summary(ranked, sets)
    return tables
