"""Evidence aggregation and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwright.operators import models as mdl
from cohortwright.operators import ranking as r
from cohortwright.operators.distributed import discard, materialize, shuffles_deleted
from cohortwright.operators.joins import fuse_evidence

from .support import Book, sql
from .views import Duck, view

book = Book()

# ---- weights and attributions ------------------------------------------------------------------

GATE_RUN = "SELECT seed, outer_fold, gene, avg(gate_weight) AS gate_weight, avg(abs_gate_weight) AS abs_gate_weight, max(selected_flag) AS selected_flag FROM run_weights GROUP BY 1, 2, 3"
GATE = f"SELECT gene, avg(gate_weight) AS mean_gate_weight, avg(abs_gate_weight) AS mean_abs_gate_weight, avg(selected_flag) AS gate_selection_frequency, count(DISTINCT outer_fold) AS fold_count, count(DISTINCT seed) AS seed_count FROM ({GATE_RUN}) GROUP BY 1"


@book.add("r1_weights_by_run", sql(GATE_RUN, "gate_weight abs_gate_weight", "seed outer_fold selected_flag"))
def r1_run(spark, sf):
    return r.aggregate_weights(view(spark, sf, "run_weights"))[0]


@book.add("r1_aggregate_weights", sql(GATE, "mean_gate_weight mean_abs_gate_weight gate_selection_frequency", "fold_count seed_count"))
def r1(spark, sf):
    return r.aggregate_weights(view(spark, sf, "run_weights"))[1]


@book.add("m10_flag_top", sql("SELECT w.seed, w.outer_fold, w.gene, gate_weight, CASE WHEN abs_gate_weight >= q THEN 1 ELSE 0 END AS selected_flag FROM (SELECT seed, outer_fold, gene, gate_weight, abs_gate_weight FROM run_weights) w JOIN (SELECT seed, outer_fold, quantile_cont(abs_gate_weight, 0.9) AS q FROM run_weights GROUP BY 1, 2) l ON w.seed = l.seed AND w.outer_fold = l.outer_fold", "gate_weight", "seed outer_fold selected_flag"))
def m10(spark, sf):
    return mdl.flag_top(view(spark, sf, "run_weights").drop("selected_flag")).drop("abs_gate_weight")


@book.add("m10_sparsity_share", sql("SELECT seed, outer_fold, avg(CAST(abs_gate_weight < 0.03 AS INT)) AS gate_sparsity_fraction FROM run_weights GROUP BY 1, 2", "gate_sparsity_fraction", "seed outer_fold"))
def m10_share(spark, sf):
    return mdl.sparsity_share(view(spark, sf, "run_weights"), 0.03)


def slot_weights(spark, sf) -> DataFrame:
    """A linear scorer over the embedding slots per (seed, fold): weights from the rows' own line items."""
    return (
        view(spark, sf, "run_weights")
        .withColumn("gene", F.concat(F.lit("e"), (F.substring("gene", 2, 20).cast("bigint") % 64).cast("string")))
        .groupBy("seed", "outer_fold", "gene").agg(F.avg("gate_weight").alias("weight"))
    )


SLOT = "SELECT seed, outer_fold, 'e' || (CAST(substr(gene, 2) AS BIGINT) % 64) AS gene, avg(gate_weight) AS weight FROM run_weights GROUP BY 1, 2, 3"
SCORED = f"SELECT e.sample_id, e.disease_label, w.seed, w.outer_fold, w.gene, w.weight, coalesce(e.value, 0) AS x FROM emb e JOIN ({SLOT}) w ON e.outer_fold = w.outer_fold AND e.gene = w.gene"


@book.add("r2_integrated_gradients", sql(f"SELECT sample_id, seed, outer_fold, 'integrated_gradients' AS attribution_method, gene, weight * (x - 0.01) AS attribution_value FROM ({SCORED})", "attribution_value", "seed outer_fold"))
def r2(spark, sf):
    return r.attribute(view(spark, sf, "emb"), slot_weights(spark, sf), ["integrated_gradients"], 0.01)


@book.add("r3_gradient_x_input", sql(f"SELECT sample_id, seed, outer_fold, 'gradient_x_input' AS attribution_method, gene, weight * x AS attribution_value FROM ({SCORED})", "attribution_value", "seed outer_fold"))
def r3(spark, sf):
    return r.attribute(view(spark, sf, "emb"), slot_weights(spark, sf), ["gradient_x_input"])


@book.add("r4_weight_attribution", sql(f"SELECT sample_id, seed, outer_fold, 'gate_weight' AS attribution_method, gene, weight AS attribution_value FROM ({SCORED})", "attribution_value", "seed outer_fold"))
def r4(spark, sf):
    return r.attribute(view(spark, sf, "emb"), slot_weights(spark, sf), ["gate_weight"])


@book.add("r5_melt", sql("SELECT sample_id, gene, value AS attribution_value FROM (UNPIVOT (SELECT * FROM wide) ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME gene VALUE value)", "attribution_value"))
def r5(spark, sf):
    return r.melt(view(spark, sf, "wide"), ["sample_id"])


ATTR_RUN = "SELECT gene, attribution_method AS method, seed, outer_fold, avg(attribution_value) AS mean_attribution, avg(abs(attribution_value)) AS mean_abs_attribution, stddev_samp(attribution_value) AS std_attribution FROM attr GROUP BY 1, 2, 3, 4"
ATTR_METHOD = f"SELECT gene, method, avg(mean_attribution) AS mean_attribution, avg(mean_abs_attribution) AS mean_abs_attribution, stddev_samp(mean_attribution) AS std_attribution, count(DISTINCT outer_fold) AS fold_count, count(DISTINCT seed) AS seed_count FROM ({ATTR_RUN}) GROUP BY 1, 2"
ATTR_GENE = f"SELECT gene, avg(mean_abs_attribution) AS attribution_score, avg(mean_attribution) AS signed_attribution_score, count(DISTINCT method) AS attribution_method_count FROM ({ATTR_METHOD}) GROUP BY 1"


@book.add("r6_attribution_by_run", sql(ATTR_RUN, "mean_attribution mean_abs_attribution std_attribution", "seed outer_fold"))
def r6(spark, sf):
    return r.attribution_by_run(view(spark, sf, "attr"))


@book.add("r7_attribution_by_method", sql(ATTR_METHOD, "mean_attribution mean_abs_attribution std_attribution", "fold_count seed_count"))
def r7_method(spark, sf):
    return r.attribution_by_gene(r.attribution_by_run(view(spark, sf, "attr")))[0]


@book.add("r7_attribution_by_gene", sql(ATTR_GENE, "attribution_score signed_attribution_score"))
def r7(spark, sf):
    return r.attribution_by_gene(r.attribution_by_run(view(spark, sf, "attr")))[1]


# ---- run scores and stability ------------------------------------------------------------------

# Scores are compared for equality when ranking, so both engines compute them in the same order.
RUN_SCORES = f"""SELECT *, rank() OVER (PARTITION BY seed, outer_fold ORDER BY run_predictive_score DESC) + (count(*) OVER (PARTITION BY seed, outer_fold, run_predictive_score) - 1) / 2.0::DOUBLE AS rank_within_run
FROM (SELECT coalesce(g.seed, a.seed) AS seed, coalesce(g.outer_fold, a.outer_fold) AS outer_fold, coalesce(g.gene, a.gene) AS gene,
  0.6::DOUBLE * coalesce(a.v, 0) + 0.4::DOUBLE * coalesce(g.abs_gate_weight, 0) AS run_predictive_score
  FROM ({GATE_RUN}) g FULL JOIN (SELECT seed, outer_fold, gene, avg(mean_abs_attribution) AS v FROM ({ATTR_RUN}) GROUP BY 1, 2, 3) a
  ON g.seed = a.seed AND g.outer_fold = a.outer_fold AND g.gene = a.gene)"""


def _run_scores(spark, sf) -> DataFrame:
    attr = r.attribution_by_run(view(spark, sf, "attr"))
    return r.run_scores(attr, r.aggregate_weights(view(spark, sf, "run_weights"))[0])


@book.add("r8_run_scores", sql(f"SELECT seed, outer_fold, gene, run_predictive_score, rank_within_run FROM ({RUN_SCORES})", "run_predictive_score rank_within_run", "seed outer_fold"))
def r8(spark, sf):
    return _run_scores(spark, sf).select("seed", "outer_fold", "gene", "run_predictive_score", "rank_within_run")


@book.add("r9_topk_frequency", sql(f"SELECT gene, avg(CAST(rank_within_run <= 100 AS INT)) AS top100_frequency FROM ({RUN_SCORES}) GROUP BY 1", "top100_frequency"))
def r9(spark, sf):
    return r.topk_frequency(_run_scores(spark, sf), 100)


STABILITY = f"""SELECT *, 0.4::DOUBLE * top25_frequency + 0.3::DOUBLE * top100_frequency + 0.2::DOUBLE / (1 + coalesce(rank_std, max(rank_std) OVER ()))
  + 0.1::DOUBLE / (1 + coalesce(importance_cv, median(importance_cv) OVER ())) AS stability_score_raw
FROM (SELECT gene, avg(rank_within_run) AS mean_rank, stddev_samp(rank_within_run) AS rank_std, avg(CAST(rank_within_run <= 25 AS INT)) AS top25_frequency,
  avg(CAST(rank_within_run <= 100 AS INT)) AS top100_frequency, stddev_samp(run_predictive_score) / nullif(avg(run_predictive_score), 0) AS importance_cv FROM ({RUN_SCORES}) GROUP BY 1)"""


@book.add("r10_stability", sql(STABILITY, "mean_rank rank_std top25_frequency top100_frequency importance_cv stability_score_raw"))
def r10(spark, sf):
    return r.stability(_run_scores(spark, sf)).drop("run_score_mean", "run_score_std")


# ---- environments ------------------------------------------------------------------------------


def _level_sql(table: str, value: str, least: int) -> str:
    parts = " UNION ALL ".join(f"SELECT t.sample_id, gene, {value} AS v, '{d}' AS environment_column, {d} AS environment_level FROM {table} t JOIN sample_envs s ON t.sample_id = s.sample_id" for d in ("env_status", "env_sex"))
    return f"SELECT environment_column, environment_level, gene, avg(abs(v)) AS m, count(*) AS n, count(DISTINCT sample_id) AS s FROM ({parts}) WHERE environment_level IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {least}"


EFFECTS = f"SELECT a.environment_column, a.environment_level, a.gene, a.m AS mean_attribution, p.m AS mean_perturbation_effect, a.n AS n_rows, a.s AS n_samples FROM ({_level_sql('attr', 'attribution_value', 10)}) a LEFT JOIN ({_level_sql('pert', 'delta_prob', 10)}) p ON a.environment_column = p.environment_column AND a.environment_level = p.environment_level AND a.gene = p.gene"


def _effects(spark, sf) -> DataFrame:
    pert = view(spark, sf, "pert")
    return r.environment_effects(view(spark, sf, "attr"), pert, view(spark, sf, "sample_envs"), ["env_status", "env_sex"])


@book.add("r11_environment_effects", sql(EFFECTS, "mean_attribution mean_perturbation_effect"))
def r11(spark, sf):
    return _effects(spark, sf)


INVARIANCE = f"""SELECT *, mean_environment_effect / (1 + std_environment_effect + max_environment_gap) AS invariance_score
FROM (SELECT gene, environment_column, count(*) AS environment_coverage, avg(e) AS mean_environment_effect, stddev_pop(e) AS std_environment_effect, max(e) - min(e) AS max_environment_gap
  FROM (SELECT *, CASE WHEN mean_perturbation_effect IS NULL THEN mean_attribution ELSE (mean_attribution + mean_perturbation_effect) / 2 END AS e FROM ({EFFECTS})) GROUP BY 1, 2)"""


@book.add("r12_invariance", sql(INVARIANCE, "mean_environment_effect std_environment_effect max_environment_gap invariance_score"))
def r12(spark, sf):
    return r.invariance(_effects(spark, sf))


# ---- perturbation ------------------------------------------------------------------------------

REFS = "SELECT outer_fold, gene, coalesce(quantile_cont(value, 0.1) FILTER (WHERE disease_label = 0), median(value)) AS reference_0, coalesce(quantile_cont(value, 0.9) FILTER (WHERE disease_label = 1), median(value)) AS reference_1 FROM emb GROUP BY 1, 2"


@book.add("r13_class_reference", sql(REFS, "reference_0 reference_1", "outer_fold"))
def r13(spark, sf):
    return r.class_reference(view(spark, sf, "emb"), by=["outer_fold", "gene"])


@book.add("r13_class_median", sql("SELECT gene, coalesce(median(value) FILTER (WHERE disease_label = 0), median(value)) AS reference_0, coalesce(median(value) FILTER (WHERE disease_label = 1), median(value)) AS reference_1 FROM (SELECT gene, value, CASE WHEN gene = 'e3' THEN 1 ELSE disease_label END AS disease_label FROM emb) GROUP BY 1", "reference_0 reference_1"))
def r13_median(spark, sf):
    # One gene without class 0, which takes the overall median.
    emb = view(spark, sf, "emb").withColumn("disease_label", F.when(F.col("gene") == "e3", 1).otherwise(F.col("disease_label")))
    return r.class_reference(emb, reference="median")


PERTURBED = f"""SELECT sample_id, disease_label, seed, outer_fold, gene, 1 / (1 + exp(-z)) AS original_prob, 1 / (1 + exp(-(z + d))) AS perturbed_prob, d AS logit_shift,
  1 / (1 + exp(-(z + d))) - 1 / (1 + exp(-z)) AS delta_prob
FROM (SELECT s.*, weight * (CASE WHEN disease_label = 1 THEN reference_0 ELSE reference_1 END - x) AS d
  FROM (SELECT *, sum(weight * x) OVER (PARTITION BY sample_id, seed) AS z FROM ({SCORED})) s
  JOIN ({REFS}) c ON s.outer_fold = c.outer_fold AND s.gene = c.gene)"""


def _perturbed(spark, sf) -> DataFrame:
    emb = view(spark, sf, "emb")
    return r.perturb(emb, slot_weights(spark, sf), r.class_reference(emb, by=["outer_fold", "gene"]))


@book.add("r14_perturb", sql(PERTURBED, "original_prob perturbed_prob logit_shift delta_prob", "disease_label seed outer_fold"))
def r14(spark, sf):
    return _perturbed(spark, sf)


PERT_RUN = """SELECT gene, seed, outer_fold, avg(delta_prob) FILTER (WHERE disease_label = 1) AS mean_delta_prob_tumor, avg(delta_prob) FILTER (WHERE disease_label = 0) AS mean_delta_prob_normal,
  avg(abs(delta_prob)) AS mean_abs_delta_prob, avg(CAST(CASE WHEN disease_label = 1 THEN delta_prob < 0 ELSE delta_prob > 0 END AS INT)) AS directional_consistency, avg(abs(logit_shift)) AS logit_shift,
  avg(abs(logit_shift)) FILTER (WHERE disease_label = 1) AS tumor_logit_shift, avg(abs(logit_shift)) FILTER (WHERE disease_label = 0) AS normal_logit_shift FROM pert GROUP BY 1, 2, 3"""
PERT_GENE = f"SELECT *, mean_abs_delta_prob * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(directional_consistency, 0)) AS perturbation_score FROM (SELECT gene, avg(mean_delta_prob_tumor) AS mean_delta_prob_tumor, avg(mean_delta_prob_normal) AS mean_delta_prob_normal, avg(mean_abs_delta_prob) AS mean_abs_delta_prob, avg(logit_shift) AS logit_shift, avg(directional_consistency) AS directional_consistency FROM ({PERT_RUN}) GROUP BY 1)"


@book.add("r15_perturb_by_run", sql(PERT_RUN, "mean_delta_prob_tumor mean_delta_prob_normal mean_abs_delta_prob directional_consistency logit_shift tumor_logit_shift normal_logit_shift", "seed outer_fold"))
def r15(spark, sf):
    return r.perturb_by_run(view(spark, sf, "pert"))


def _pert_gene(spark, sf) -> DataFrame:
    return r.perturb_by_gene(r.perturb_by_run(view(spark, sf, "pert")))


@book.add("r16_perturb_by_gene", sql(PERT_GENE, "mean_delta_prob_tumor mean_delta_prob_normal mean_abs_delta_prob logit_shift directional_consistency perturbation_score"))
def r16(spark, sf):
    return _pert_gene(spark, sf)


# ---- fusion and ranking ------------------------------------------------------------------------

PARTS = ("attribution_score", "gate_score", "stability_score", "invariance_score", "perturbation_score")
FUSED = f"""SELECT coalesce(a.gene, g.gene, s.gene) AS gene, coalesce(a.attribution_score, 0) AS attribution_score, coalesce(g.mean_abs_gate_weight, 0) AS gate_score,
  coalesce(s.stability_score_raw, 0) AS stability_score, coalesce(i.invariance_score, 0) AS invariance_score, coalesce(p.perturbation_score, 0) AS perturbation_score, p.directional_consistency
FROM ({ATTR_GENE}) a FULL JOIN ({GATE}) g ON a.gene = g.gene FULL JOIN ({STABILITY}) s ON coalesce(a.gene, g.gene) = s.gene
LEFT JOIN (SELECT gene, avg(invariance_score) AS invariance_score FROM ({INVARIANCE}) GROUP BY 1) i ON coalesce(a.gene, g.gene, s.gene) = i.gene
LEFT JOIN ({PERT_GENE}) p ON coalesce(a.gene, g.gene, s.gene) = p.gene"""


def _runs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attributions, weights and scores by run, each stored once."""
    attr = materialize(r.attribution_by_run(view(spark, sf, "attr")).select("gene", "method", *r.RUN, "mean_abs_attribution"))
    gate = materialize(r.aggregate_weights(view(spark, sf, "run_weights"))[0].select(*r.RUN, "gene", "abs_gate_weight"))
    scores = r.run_scores(attr, gate).select(*r.RUN, "gene", "run_predictive_score", "rank_within_run")
    return attr, gate, materialize(scores)


def fused(spark, sf, runs: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    attr, gate, scores = _runs(spark, sf) if runs is None else runs
    attr_gene = attr.groupBy("gene", "method").agg(F.avg("mean_abs_attribution").alias("v")).groupBy("gene").agg(F.avg("v").alias("attribution_score"))
    return fuse_evidence(
        attr_gene,
        gate.groupBy("gene").agg(F.avg("abs_gate_weight").alias("gate_score")),
        r.stability(scores).select("gene", F.col("stability_score_raw").alias("stability_score")),
        r.invariance_by_gene(r.invariance(_effects(spark, sf))).select("gene", "invariance_score"),
        _pert_gene(spark, sf).select("gene", "perturbation_score", "directional_consistency"),
    )


def _book_fused(spark, sf) -> DataFrame:
    return materialize(fused(spark, sf))


@book.add("r17_preselect", sql(f"SELECT gene, (attribution_score + gate_score + stability_score) / 3 AS preliminary_rank_score FROM ({FUSED}) ORDER BY 2 DESC, gene LIMIT 100", "preliminary_rank_score"))
def r17(spark, sf):
    return r.preselect(fused(spark, sf)).select("gene", "preliminary_rank_score")


NORMALIZED = f"SELECT gene, directional_consistency, {', '.join(f'CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE {c} END AS {c}' for c in PARTS)} FROM fused"
COMPOSED = "SELECT *, 0.0::DOUBLE + 0.30::DOUBLE * attribution_score + 0.20::DOUBLE * gate_score + 0.20::DOUBLE * stability_score + 0.15::DOUBLE * invariance_score + 0.15::DOUBLE * perturbation_score AS composite_score FROM normalized"
RANKED = "SELECT *, row_number() OVER (ORDER BY composite_score DESC, attribution_score DESC, gate_score DESC, gene) AS final_rank FROM composed"
STEPS = f"WITH fused AS ({FUSED}), normalized AS ({NORMALIZED}), composed AS ({COMPOSED}), ranked AS ({RANKED})"


@book.add("r18_normalize_scores", sql(f"{STEPS} SELECT gene, {', '.join(PARTS)} FROM normalized", " ".join(PARTS)))
def r18(spark, sf):
    return r.normalize_scores(_book_fused(spark, sf)).drop("directional_consistency")


def _composed(spark, sf, runs: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    return r.composite(r.normalize_scores(materialize(fused(spark, sf, runs))))


@book.add("r19_composite", sql(f"{STEPS} SELECT gene, composite_score FROM composed", "composite_score"))
def r19(spark, sf):
    return _composed(spark, sf).select("gene", "composite_score")


def _ranked(spark, sf) -> DataFrame:
    return r.rank_entities(_composed(spark, sf))


@book.add("r20_rank_entities", sql(f"{STEPS} SELECT gene, composite_score, final_rank, CASE WHEN round(coalesce(directional_consistency, 0), 12) >= 0.7 THEN 'Stable computationally prioritized driver-associated gene with consistent counterfactual effect.' ELSE 'Computationally prioritized candidate driver gene; interpret with observational caution.' END AS notes FROM ranked", "composite_score"))
def r20(spark, sf):
    return _ranked(spark, sf).select("gene", "composite_score", "final_rank", "notes")


N_BOOT = 100
RUNS = "SELECT seed, outer_fold, row_number() OVER (ORDER BY seed, outer_fold) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT seed, outer_fold FROM scores)"
DRAWS = f"SELECT it, {Duck.h("'42:' || it || ':' || d")} % n AS i FROM (SELECT DISTINCT n FROM runs), unnest(generate_series(0, {N_BOOT - 1})) AS a(it), unnest(generate_series(0, n - 1)) AS b(d)"


def _boot_sql(parts: str, scaled: bool) -> str:
    stability = "0.7::DOUBLE * stability_score + 0.3::DOUBLE * coalesce(s, 0)"
    drawn = f"SELECT n.gene, g.it AS iteration, {', '.join(stability + ' AS ' + c if c == 'stability_score' else c for c in PARTS)} FROM {parts} n CROSS JOIN (SELECT unnest(generate_series(0, {N_BOOT - 1})) AS it) g LEFT JOIN resampled s ON n.gene = s.gene AND g.it = s.it"
    if scaled:
        span = lambda c, f: f"{f}({c}) OVER (PARTITION BY iteration)"
        drawn = f"SELECT gene, iteration, {', '.join(f'CASE WHEN {span(c, "max")} > {span(c, "min")} THEN ({c} - {span(c, "min")}) / ({span(c, "max")} - {span(c, "min")}) ELSE {c} END AS {c}' for c in PARTS)} FROM ({drawn})"
    return f"""{STEPS}, scores AS ({RUN_SCORES}), runs AS ({RUNS}), draws AS ({DRAWS}),
resampled AS (SELECT it, gene, avg(run_predictive_score) AS s FROM draws JOIN runs ON draws.i = runs.i JOIN scores ON runs.seed = scores.seed AND runs.outer_fold = scores.outer_fold GROUP BY 1, 2),
boot AS (SELECT gene, iteration, 0.30::DOUBLE * attribution_score + 0.20::DOUBLE * gate_score + 0.20::DOUBLE * stability_score + 0.15::DOUBLE * invariance_score + 0.15::DOUBLE * perturbation_score AS composite_bootstrap FROM ({drawn}))"""


BOOT, BOOT_SCALED = _boot_sql("normalized", False), _boot_sql("fused", True)
RANK_BOOT = "row_number() OVER (PARTITION BY iteration ORDER BY composite_bootstrap DESC, gene) AS rank_bootstrap"
CI = "gene, avg(composite_bootstrap) AS bootstrap_mean, quantile_cont(composite_bootstrap, 0.025) AS bootstrap_ci_lower, quantile_cont(composite_bootstrap, 0.975) AS bootstrap_ci_upper"


def _arrays(spark, sf, scaled: bool = False) -> DataFrame:
    """100 iterations, on parts scaled once, or on raw parts scaled anew in each iteration."""
    with shuffles_deleted(spark):
        runs = _runs(spark, sf)
        parts = materialize(fused(spark, sf, runs))
        arrays = r.bootstrap_arrays(parts if scaled else r.normalize_scores(parts), runs[2], N_BOOT, normalize=scaled)
    discard(*runs, parts)
    return arrays


@book.add("r21_draw_table", sql(f"WITH scores AS (SELECT DISTINCT seed, outer_fold FROM run_weights), runs AS ({RUNS}) SELECT it AS iteration, seed, outer_fold, count(*) AS draws FROM ({DRAWS}) p JOIN runs ON p.i = runs.i GROUP BY 1, 2, 3", ints="seed outer_fold"))
def r21_draws(spark, sf):
    return r.draw_table(view(spark, sf, "run_weights"), N_BOOT, 42)


@book.add("r21_bootstrap", sql(f"{BOOT} SELECT gene, iteration, composite_bootstrap, {RANK_BOOT} FROM boot", "composite_bootstrap"))
def r21(spark, sf):
    return r.rank_iterations(_arrays(spark, sf))


@book.add("r21_bootstrap_scaled", sql(f"{BOOT_SCALED} SELECT gene, iteration, composite_bootstrap, {RANK_BOOT} FROM boot", "composite_bootstrap"))
def r21_scaled(spark, sf):
    return r.rank_iterations(_arrays(spark, sf, scaled=True))


@book.add("r22_bootstrap_ci", sql(f"{BOOT} SELECT {CI} FROM boot GROUP BY 1", "bootstrap_mean bootstrap_ci_lower bootstrap_ci_upper"))
def r22(spark, sf):
    return r.bootstrap_ci(_arrays(spark, sf))


@book.add("r22_bootstrap_ci_scaled", sql(f"{BOOT_SCALED} SELECT {CI} FROM boot GROUP BY 1", "bootstrap_mean bootstrap_ci_lower bootstrap_ci_upper"))
def r22_scaled(spark, sf):
    return r.bootstrap_ci(_arrays(spark, sf, scaled=True))


@book.add("r23_set_summary", sql(f"{STEPS} SELECT pathway, count(*) AS pathway_gene_count, count(*) FILTER (WHERE final_rank <= 25) AS top25_hits, count(*) FILTER (WHERE final_rank <= 100) AS top100_hits, avg(composite_score) AS mean_composite, avg(attribution_score) AS mean_attribution_score, avg(perturbation_score) AS mean_perturbation_score FROM sets JOIN ranked ON sets.gene = ranked.gene GROUP BY 1", "mean_composite mean_attribution_score mean_perturbation_score"))
def r23(spark, sf):
    return r.set_summary(_ranked(spark, sf), view(spark, sf, "sets"))


@book.add("r24_top_n", sql(f"{STEPS} SELECT gene, final_rank FROM ranked WHERE final_rank <= 25"))
def r24(spark, sf):
    return r.top_n(_ranked(spark, sf), 25).select("gene", "final_rank")


RUN_IDS = tuple((s, f) for s in (1, 2) for f in (1, 2, 3, 4, 5))


@book.add("r25_rank_matrix", sql(f"{STEPS}, scores AS ({RUN_SCORES}) SELECT gene, {', '.join(f'avg(rank_within_run) FILTER (WHERE seed = {s} AND outer_fold = {f}) AS r{s}_fold{f}' for s, f in RUN_IDS)} FROM scores WHERE gene IN (SELECT gene FROM ranked WHERE final_rank <= 25) GROUP BY 1", " ".join(f"r{s}_fold{f}" for s, f in RUN_IDS)))
def r25(spark, sf):
    runs = _runs(spark, sf)
    ranked = r.rank_entities(_composed(spark, sf, runs))
    out = r.rank_matrix(runs[2], ranked, [f"{s}_fold{f}" for s, f in RUN_IDS])
    return out.select("gene", *[F.col(f"{s}_fold{f}").alias(f"r{s}_fold{f}") for s, f in RUN_IDS])


@book.add("r26_ranked_effects", sql(f"{STEPS}, p AS ({PERT_GENE}) SELECT ranked.gene, final_rank, mean_delta_prob_tumor, mean_delta_prob_normal, logit_shift FROM ranked JOIN p ON ranked.gene = p.gene ORDER BY final_rank LIMIT 20", "mean_delta_prob_tumor mean_delta_prob_normal logit_shift"))
def r26(spark, sf):
    return r.ranked_effects(_ranked(spark, sf), _pert_gene(spark, sf).select("gene", "mean_delta_prob_tumor", "mean_delta_prob_normal", "logit_shift"))
