"""Evidence per entity over many runs: attribution, stability, invariance, perturbation, ranking.

A run is a ``(seed, outer_fold)`` pair; the number of runs is a design choice (a few dozen), the
number of entities and samples is not bounded.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwright.functions.arithmetic import ratio, sigmoid
from cohortwright.functions.hashing import stable_hash

from .distributed import (
    lookup_join,
    materialize,
    number_rows,
    tie_ranks,
)
from .metadata import note
from .selection import Quantile, exact_quantiles, order_statistics

# Executors don't have this package: what tasks call goes with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = ("seed", "outer_fold")
MOST_RUNS = 1_000
# Genes of one iteration that are ranked together, and genes whose values are dealt to the ranges at a time.
RANGE_ROWS, DEALT_ROWS = 1 << 18, 1 << 16
COMPONENTS = ("attribution_score", "gate_score", "stability_score", "invariance_score", "perturbation_score")
# Default weights of the composite score and of the two parts of a run score.
WEIGHTS = {
    "attribution_score": 0.30, "gate_score": 0.20, "stability_score": 0.20, "invariance_score": 0.15,
    "perturbation_score": 0.15,
}
RUN_ATTRIBUTION, RUN_GATE = 0.6, 0.4
METHODS = ("integrated_gradients", "gradient_x_input")


def aggregate_weights(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights per (run, gene), and their summary per gene."""
    per_run = df.groupBy(*RUN, "gene").agg(
        F.avg("gate_weight").alias("gate_weight"),
        F.avg("abs_gate_weight").alias("abs_gate_weight"),
        F.max("selected_flag").alias("selected_flag"),
    )
    # The sets hold folds and seeds of one gene, at most one entry per run.
    summary = per_run.groupBy("gene").agg(
        F.avg("gate_weight").alias("mean_gate_weight"),
        F.avg("abs_gate_weight").alias("mean_abs_gate_weight"),
        F.avg("selected_flag").alias("gate_selection_frequency"),
        F.size(F.collect_set("outer_fold")).alias("fold_count"),
        F.size(F.collect_set("seed")).alias("seed_count"),
    )
    return per_run, summary


def attribute(
    long: DataFrame, weights: DataFrame, methods: Sequence[str] = METHODS, baseline: float | str = 0.0
) -> DataFrame:
    """Attribution per (sample, run, method, gene) for linear scorers of each run's held-out samples.

    ``long`` is ``(sample_id, outer_fold, gene, value)``, ``weights`` ``(seed, outer_fold, gene,
    weight)``. On a linear logit the path integral of the gradient from ``baseline`` is exactly
    ``w * (x - baseline)`` and gradient times input is ``w * x``. ``gate_weight`` repeats the weight.
    Missing values count as 0.
    """
    x, w = F.coalesce("value", F.lit(0.0)), F.col("weight")
    base = F.col(baseline) if isinstance(baseline, str) else F.lit(float(baseline))
    values = {"integrated_gradients": w * (x - base), "gradient_x_input": w * x, "gate_weight": w}
    unknown = [m for m in methods if m not in values]
    if unknown:
        raise ValueError(f"Unknown attribution methods {unknown}")
    scored = lookup_join(long, weights.select(*RUN, "gene", "weight"), ["outer_fold", "gene"], "inner")
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), values[m].alias("v")) for m in methods])
    return scored.withColumn("_a", F.explode(pairs)).select(
        "sample_id", *RUN, F.col("_a.m").alias("attribution_method"), "gene", F.col("_a.v").alias("attribution_value")
    )


def melt(
    df: DataFrame, ids: Sequence[str] = ("sample_id", "seed", "outer_fold", "attribution_method")
) -> DataFrame:
    """Wide attributions (one column per gene) to the long form."""
    genes = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), [f"`{g}`" for g in genes], "gene", "attribution_value")


def attribution_by_run(attr: DataFrame) -> DataFrame:
    v = F.col("attribution_value")
    return attr.groupBy("gene", F.col("attribution_method").alias("method"), *RUN).agg(
        F.avg(v).alias("mean_attribution"),
        F.avg(F.abs(v)).alias("mean_abs_attribution"),
        F.stddev_samp(v).alias("std_attribution"),
    )


def attribution_by_gene(per_run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run means per (gene, method), then per gene."""
    by_method = per_run.groupBy("gene", "method").agg(
        F.avg("mean_attribution").alias("mean_attribution"),
        F.avg("mean_abs_attribution").alias("mean_abs_attribution"),
        F.stddev_samp("mean_attribution").alias("std_attribution"),
        F.size(F.collect_set("outer_fold")).alias("fold_count"),
        F.size(F.collect_set("seed")).alias("seed_count"),
    )
    by_gene = by_method.groupBy("gene").agg(
        F.avg("mean_abs_attribution").alias("attribution_score"),
        F.avg("mean_attribution").alias("signed_attribution_score"),
        F.count("*").alias("attribution_method_count"),
    )
    return by_method, by_gene


def run_scores(attribution_run: DataFrame, gate_run: DataFrame) -> DataFrame:
    """Score of every gene in every run, with its average-tie rank there (1 is best).

    Equal scores spread over ranges (``tie_ranks``), so a run where most genes score 0 has no hot key.
    """
    attr = attribution_run.groupBy(*RUN, "gene").agg(F.avg("mean_abs_attribution").alias("mean_abs_attribution"))
    merged = gate_run.join(attr, [*RUN, "gene"], "full").fillna(0.0, ["mean_abs_attribution", "abs_gate_weight"])
    scored = merged.withColumn(
        "run_predictive_score",
        RUN_ATTRIBUTION * F.col("mean_abs_attribution") + RUN_GATE * F.col("abs_gate_weight"),
    )
    return tie_ranks(scored, RUN, "run_predictive_score", ["gene"], "rank_within_run")


def topk_frequency(scores: DataFrame, k: int) -> DataFrame:
    return scores.groupBy("gene").agg(F.avg((F.col("rank_within_run") <= k).cast("int")).alias(f"top{k}_frequency"))


def stability(scores: DataFrame) -> DataFrame:
    """Rank and score spread over runs and the stability score per gene."""
    summary = materialize(
        scores.groupBy("gene").agg(
            F.avg("rank_within_run").alias("mean_rank"),
            F.stddev_samp("rank_within_run").alias("rank_std"),
            F.avg("run_predictive_score").alias("run_score_mean"),
            F.stddev_samp("run_predictive_score").alias("run_score_std"),
            *[F.avg((F.col("rank_within_run") <= k).cast("int")).alias(f"top{k}_frequency") for k in (25, 100)],
        ).withColumn("importance_cv", ratio("run_score_std", "run_score_mean"))
    )
    widest = summary.agg(F.max("rank_std")).scalar()
    middle = exact_quantiles(summary, [], "importance_cv", {"m": 0.5}).select("m").scalar()
    rank_std, cv = F.coalesce("rank_std", widest), F.coalesce("importance_cv", middle)
    return summary.withColumn(
        "stability_score_raw",
        0.4 * F.col("top25_frequency") + 0.3 * F.col("top100_frequency")
        + 0.2 * (1.0 / (1.0 + rank_std)) + 0.1 * (1.0 / (1.0 + cv)),
    )


def environment_effects(
    attr: DataFrame, pert: DataFrame | None, samples: DataFrame, dims: Sequence[str], min_rows: int = 10
) -> DataFrame:
    """Mean absolute attribution and probability change per (environment, level, gene).

    Values of both tables are combined per (sample, gene) before the environments are attached: that merges
    methods and runs map-side, and leaves a sample with very many rows at most one row per gene, which the
    planner can still split in the join. What is left is summed per gene and combination of levels, and only
    those sums become rows by environment. ``n_rows`` counts attribution rows and carries the threshold,
    ``n_samples`` counts samples.
    """
    have = [d for d in dims if d in samples.columns]
    envs = samples.select("sample_id", *[F.col(d).cast("string").alias(d) for d in have])

    def parts(df: DataFrame | None, value: str, total: str, rows: str) -> list[Column]:
        if df is None:
            return [F.lit(None).cast("double").alias(total), F.lit(None).cast("bigint").alias(rows)]
        return [F.abs(F.col(value)).cast("double").alias(total), F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("bigint").alias(rows)]

    long = attr.select("sample_id", "gene", *parts(attr, "attribution_value", "attr_total", "n_rows"), *parts(None, "", "pert_total", "pert_rows"))
    if pert is not None:
        long = long.unionByName(
            pert.select("sample_id", "gene", *parts(None, "", "attr_total", "n_rows"), *parts(pert, "delta_prob", "pert_total", "pert_rows"))
        )
    sums = ["attr_total", "n_rows", "pert_total", "pert_rows"]
    combined = long.groupBy("sample_id", "gene").agg(*[F.sum(c).alias(c) for c in sums])
    # A sample without attributions of a gene adds to its changes alone.
    combined = combined.withColumn("n_samples", F.col("n_rows").isNotNull().cast("bigint"))
    sums.append("n_samples")
    by_levels = combined.join(envs, "sample_id").groupBy("gene", *have).agg(*[F.sum(c).alias(c) for c in sums])
    keys = ["environment_column", "environment_level", "gene"]
    effects = by_levels.unpivot(["gene", *sums], have, *keys[:2]).filter(F.col("environment_level").isNotNull())
    effects = effects.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).filter(F.col("n_rows") >= min_rows)
    enough = F.col("pert_rows") >= min_rows
    return effects.select(
        *keys,
        (F.col("attr_total") / F.col("n_rows")).alias("mean_attribution"),
        F.when(enough, F.col("pert_total") / F.nullif("pert_rows", F.lit(0))).alias("mean_perturbation_effect"),
        "n_rows",
        "n_samples",
    )


def invariance(effects: DataFrame) -> DataFrame:
    """Per (gene, environment): coverage, mean, population std, gap and ``mean / (1 + std + gap)``."""
    effect = F.when(
        F.col("mean_perturbation_effect").isNotNull(),
        (F.col("mean_attribution") + F.col("mean_perturbation_effect")) / 2.0,
    ).otherwise(F.col("mean_attribution"))
    return effects.withColumn("_e", effect).groupBy("gene", "environment_column").agg(
        F.count("*").alias("environment_coverage"),
        F.avg("_e").alias("mean_environment_effect"),
        F.stddev_pop("_e").alias("std_environment_effect"),
        (F.max("_e") - F.min("_e")).alias("max_environment_gap"),
    ).withColumn(
        "invariance_score",
        F.col("mean_environment_effect") / (1.0 + F.col("std_environment_effect") + F.col("max_environment_gap")),
    )


def invariance_by_gene(inv: DataFrame) -> DataFrame:
    return inv.groupBy("gene").agg(
        F.avg("invariance_score").alias("invariance_score"),
        F.sum("environment_coverage").alias("environment_coverage"),
    )


def class_reference(
    long: DataFrame, q: float = 0.1, reference: str = "quantile", by: Sequence[str] = ("gene",),
    label: str = "disease_label",
) -> DataFrame:
    """Reference value of each class per gene: quantile ``q`` for class 0 and ``1 - q`` for class 1.

    ``median`` uses the class medians. A class without values takes the overall median. All three
    order statistics are selected in the same passes.
    """
    own = {f"n_{c}": F.when(F.col(label) == c, 1).otherwise(0) for c in (0, 1)}
    own = {"n": F.lit(1)} | own
    median = reference == "median"
    wanted = {"_all": Quantile(0.5), "_c0": Quantile(0.5 if median else q, "n_0"), "_c1": Quantile(0.5 if median else 1.0 - q, "n_1")}
    refs = order_statistics(long, by, "value", wanted, own)
    return refs.select(
        *by, F.coalesce("_c0", "_all").alias("reference_0"), F.coalesce("_c1", "_all").alias("reference_1")
    )


def perturb(
    long: DataFrame, weights: DataFrame, refs: DataFrame, intercepts: DataFrame | None = None,
    label: str = "disease_label",
) -> DataFrame:
    """Counterfactual swap for linear scorers: class 1 takes the class-0 reference and the reverse.

    ``long`` is ``(sample_id, outer_fold, <label>, gene, value)``; ``refs`` holds the candidate genes per fold, all
    genes or those of ``preselect``. A sample's logit and the terms of its candidates come from one grouping, so the
    sample's genes are shuffled once; the terms are one array per sample and run, at most as long as the matrix has genes.
    """
    # Missing references mark genes that are scored but not perturbed.
    table = weights.select(*RUN, "gene", "weight").join(refs, ["outer_fold", "gene"], "left")
    scored = lookup_join(long, table, ["outer_fold", "gene"], "inner")
    x = F.coalesce("value", F.lit(0.0))
    swapped = F.when(F.col(label) == 1, F.col("reference_0")).otherwise(F.col("reference_1"))
    term = F.when(F.col("reference_0").isNotNull(), F.struct("gene", (F.col("weight") * (swapped - x)).alias("shift")))
    rows = scored.groupBy("sample_id", label, *RUN).agg(
        F.sum(F.col("weight") * x).alias("_z"), F.collect_list(term).alias("_terms")
    )
    if intercepts is not None:
        rows = lookup_join(rows, intercepts.select(*RUN, "intercept"), list(RUN)).withColumn(
            "_z", F.col("_z") + F.coalesce("intercept", F.lit(0.0))
        )
    rows = rows.withColumn("_t", F.explode("_terms")).select(
        "sample_id", label, *RUN, F.col("_t.gene").alias("gene"), "_z", F.col("_t.shift").alias("logit_shift")
    )
    return _with_probabilities(rows)


def _with_probabilities(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns(
        {"original_prob": sigmoid(F.col("_z")), "perturbed_prob": sigmoid(F.col("_z") + F.col("logit_shift"))}
    )
    return rows.withColumn("delta_prob", F.col("perturbed_prob") - F.col("original_prob")).drop("_z")


def features_used(model: Model) -> set[int] | None:
    """Slots whose value can change a model's score: those that trees split on or coefficients weigh; None if all may."""
    if hasattr(model, "toDebugString"):
        return {int(i) for i in re.findall(r"\bfeature (\d+)\b", model.toDebugString)}
    if hasattr(model, "coefficientMatrix"):
        return {int(i) for i in abs(model.coefficientMatrix.toArray()).sum(axis=0).nonzero()[0]}
    return None


def perturb_with_model(
    vectors: DataFrame, model: Model, genes: Sequence[str], candidates: DataFrame, label: str = "disease_label", block: int = 16
) -> DataFrame:
    """The same swap for any classifier: one array slot is replaced and the model scores the row again.

    ``vectors`` is ``(sample_id, <label>, features)`` with ``genes`` naming the slots; ``candidates``
    is ``(gene, reference_0, reference_1)`` with one row per gene at most. A candidate that the model doesn't use
    (``features_used``) changes nothing: its rows have the original score and delta 0, and no model runs for it.
    The others are rescored in blocks of ``block``: one pass over the vectors scores a block's candidates side
    by side, so rows and arrays aren't copied per candidate; only results become one row per candidate.
    """
    slot = {g: i for i, g in enumerate(genes)}
    # The model's genes are on the driver already, and no candidate is listed twice.
    picks = candidates.filter(F.col("gene").isin(*genes)).select("gene", "reference_0", "reference_1").limit(len(genes) + 1).collect()
    if not picks or len({r["gene"] for r in picks}) < len(picks):
        raise ValueError("Candidates must be features of the model, one row each")
    used = features_used(model)
    still = [r["gene"] for r in picks if used is not None and slot[r["gene"]] not in used]
    moving = sorted((r for r in picks if r["gene"] not in set(still)), key=lambda r: slot[r["gene"]])
    plain = model.transform(vectors).select(
        "sample_id", label, vector_to_array("features").alias("_x"), vector_to_array("probability")[1].alias("original_prob")
    )

    def swapped(r: Row) -> Column:
        reference = F.when(F.col(label) == 1, F.lit(r["reference_0"])).otherwise(F.lit(r["reference_1"]))
        return array_to_vector(F.transform("_x", lambda v, j: F.when(j == slot[r["gene"]], reference).otherwise(v)))

    def rescored(rows: DataFrame, part: Sequence[Row]) -> DataFrame:
        results = []
        for i, r in enumerate(part):
            one = model.copy().setFeaturesCol(f"_f{i}").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
            rows = one.transform(rows.withColumn(f"_f{i}", swapped(r))).drop(f"_f{i}", f"_r{i}", f"_y{i}")
            results.append(F.struct(F.lit(r["gene"]).alias("gene"), vector_to_array(f"_p{i}")[1].alias("perturbed_prob")))
        return rows.select("sample_id", label, "original_prob", F.explode(F.array(*results)).alias("_o")).select(
            "sample_id", label, "_o.gene", "original_prob", "_o.perturbed_prob"
        )

    parts = [rescored(plain, moving[i : i + block]) for i in range(0, len(moving), block)]
    if still:
        unmoved = plain.select("sample_id", label, F.explode(F.array(*[F.lit(g) for g in still])).alias("gene"), "original_prob")
        parts.append(unmoved.withColumn("perturbed_prob", F.col("original_prob")))
    return functools.reduce(DataFrame.union, parts).withColumn("delta_prob", F.col("perturbed_prob") - F.col("original_prob"))


def perturb_by_run(pert: DataFrame, label: str = "disease_label") -> DataFrame:
    """Per (gene, run): change by class, absolute change, share in the expected direction, logit shift."""
    pos, delta, shift = F.col(label) == 1, F.col("delta_prob"), F.abs(F.col("logit_shift"))
    expected = F.when(pos, delta < 0).otherwise(delta > 0)
    return pert.groupBy("gene", *RUN).agg(
        F.avg(F.when(pos, delta)).alias("mean_delta_prob_tumor"),
        F.avg(F.when(~pos, delta)).alias("mean_delta_prob_normal"),
        F.avg(F.abs(delta)).alias("mean_abs_delta_prob"),
        F.avg(expected.cast("int")).alias("directional_consistency"),
        F.avg(shift).alias("logit_shift"),
        F.avg(F.when(pos, shift)).alias("tumor_logit_shift"),
        F.avg(F.when(~pos, shift)).alias("normal_logit_shift"),
    )


def perturb_by_gene(per_run: DataFrame) -> DataFrame:
    means = ("mean_delta_prob_tumor", "mean_delta_prob_normal", "mean_abs_delta_prob", "logit_shift", "directional_consistency")
    out = per_run.groupBy("gene").agg(*[F.avg(m).alias(m) for m in means])
    consistency = F.coalesce("directional_consistency", F.lit(0.0))
    return out.withColumn("perturbation_score", F.col("mean_abs_delta_prob") * (0.5 + 0.5 * consistency))


def preselect(fused: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` genes with the best mean of attribution, gate and stability score."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS[:3]]
    score = (parts[0] + parts[1] + parts[2]) / 3.0
    return fused.withColumn("preliminary_rank_score", score).orderBy(F.desc("preliminary_rank_score"), "gene").limit(n)


def _ranges(df: DataFrame, cols: Sequence[str]) -> Column:
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]
    stats = [f(v).alias(f"{c}_{n}") for c, v in zip(cols, filled) for f, n in ((F.min, "min"), (F.max, "max"))]
    return df.agg(F.struct(*stats)).scalar()


def normalize_scores(df: DataFrame, cols: Sequence[str] = COMPONENTS) -> DataFrame:
    """Min-max per score column with missing as 0; a constant column stays as it is."""
    stats = _ranges(df, cols)

    def scaled(c: str) -> Column:
        low, high = stats.getField(f"{c}_min"), stats.getField(f"{c}_max")
        v = F.coalesce(F.col(c), F.lit(0.0))
        return F.when(high > low, (v - low) / F.nullif(high - low, F.lit(0.0))).otherwise(v)

    return df.withColumns({c: scaled(c) for c in cols})


def composite(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, name: str = "composite_score") -> DataFrame:
    total = sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(name, total)


def rank_entities(df: DataFrame, score: str = "composite_score", name: str = "final_rank") -> DataFrame:
    """Rank over three score keys with the gene as last key, and a note on consistency."""
    order = [F.desc_nulls_last(score), F.desc_nulls_last("attribution_score"), F.desc_nulls_last("gate_score"), "gene"]
    ranked = number_rows(df, [], order, name)
    return ranked.withColumn("notes", note() if "directional_consistency" in df.columns else note(F.lit(0.0)))


def _numbered_runs(runs: DataFrame) -> DataFrame:
    """Stored (seed, outer_fold, _i): the runs in order, numbered from 0. Runs are fitted models; a large number is an error."""
    numbered = materialize(number_rows(runs.select(*RUN).distinct(), [], list(RUN), "_i").withColumn("_i", F.col("_i") - 1))
    if numbered.count() > MOST_RUNS:
        raise ValueError(f"More than {MOST_RUNS} runs to draw from")
    return numbered


def _draw_counts(numbered: DataFrame, n: int, seed: int) -> DataFrame:
    """(iteration, _i, draws): how often an iteration draws a run."""
    size = numbered.count()
    slots = numbered.sparkSession.range(n * size).select(
        F.floor(F.col("id") / F.lit(max(size, 1))).alias("iteration"), (F.col("id") % F.lit(max(size, 1))).alias("draw")
    )
    picked = slots.withColumn("_i", stable_hash(seed, "iteration", "draw") % F.lit(max(size, 1)))
    return picked.groupBy("iteration", "_i").agg(F.count("*").alias("draws"))


def draw_table(runs: DataFrame, n: int, seed: int) -> DataFrame:
    """Bootstrap draws of runs: ``(iteration, seed, outer_fold, draws)``.

    Each of ``n`` iterations draws as many runs as exist, with replacement, by hash; runs drawn
    several times are counted, so the table has at most ``n`` rows per run.
    """
    numbered = _numbered_runs(runs)
    return _draw_counts(numbered, n, seed).join(numbered, "_i").select("iteration", *RUN, "draws")


def _run_lists(scores: DataFrame, n: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(gene, _runs, _values): the run scores of a gene as short arrays; and the counts of draws, runs x iterations."""
    numbered = _numbered_runs(scores)
    draws = np.zeros((numbered.count(), n))
    for row in _draw_counts(numbered, n, seed).collect():  # at most n x MOST_RUNS counts
        draws[row["_i"], row["iteration"]] = row["draws"]
    own = lookup_join(scores.select(*RUN, "gene", "run_predictive_score"), numbered, list(RUN), "inner", stored=True)
    own = own.groupBy("gene").agg(F.collect_list(F.struct(F.col("_i").cast("int").alias("_i"), F.col("run_predictive_score").alias("s"))).alias("_own"))
    return own.select("gene", F.col("_own._i").alias("_runs"), F.col("_own.s").alias("_values")), draws


def _resampled(scores: DataFrame, n: int, seed: int) -> DataFrame:
    """(gene, _resampled): the mean run score of a gene in every iteration, over the drawn runs that score it.

    A gene's run scores are one short array, the draws one table of ``n`` x runs counts; each batch of genes works its
    iterations out by itself, so nothing is copied per iteration and there is one shuffle, by gene.
    """
    lists, draws = _run_lists(scores, n, seed)

    @F.arrow_udf("array<double>")
    def means(runs: pa.Array, values: pa.Array) -> pa.Array:
        return _drawn_means(runs, values, draws)

    return lists.select("gene", means("_runs", "_values").alias("_resampled"))


def _drawn_means(runs: pa.Array, values: pa.Array, draws: np.ndarray, most: int = 2_048) -> pa.Array:
    """For each list of (run, value) the mean value in every column of ``draws`` (runs x iterations); null where none is drawn.

    Sums go run by run, so equal lists have equal means in any batch.
    """
    size, n = draws.shape
    out = []
    for start in range(0, len(runs), most):
        part, scores = runs.slice(start, most), values.slice(start, most)
        row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
        at, value = part.flatten().to_numpy(zero_copy_only=False), scores.flatten().to_numpy(zero_copy_only=False)
        held, there = np.zeros((size, len(part))), np.zeros((size, len(part)))
        np.add.at(held, (at, row), value)
        np.add.at(there, (at, row), 1.0)
        total, count = np.zeros((len(part), n)), np.zeros((len(part), n))
        for i in range(size):
            total += held[i][:, None] * draws[i]
            count += there[i][:, None] * draws[i]
        # A missing score leaves its gene without means.
        count[row[scores.flatten().is_null().to_numpy(zero_copy_only=False)]] = 0
        mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
        flat = pa.array(mean.ravel(), mask=(count == 0).ravel())
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * np.int32(n)), flat))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))


def _stabilities(rows: pa.StructArray, draws: np.ndarray) -> np.ndarray:
    """Stability part of every gene (rows) in every iteration (columns); iterations without a mean add nothing."""
    means = _drawn_means(rows.field("_runs"), rows.field("_values"), draws).flatten()
    drawn = pc.fill_null(means, 0.0).to_numpy(zero_copy_only=False).reshape(len(rows), draws.shape[1])
    return rows.field("_own").to_numpy(zero_copy_only=False)[:, None] + 0.3 * drawn


def _lists(table: np.ndarray) -> pa.Array:
    size, n = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * np.int32(n)), pa.array(table.ravel()))


def _composites(rows: pa.StructArray, draws: np.ndarray, weights: Mapping[str, float], limits: tuple[np.ndarray, np.ndarray] | None) -> pa.Array:
    """Weighted sum of the parts in every iteration, added up in the order of ``weights``; ``limits`` scale the stability part."""
    s = _stabilities(rows, draws)
    if limits is not None:
        low, high = limits
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(high > low, (s - low) / (high - low), s)
    total = np.zeros((len(rows), 1))
    for c, w in weights.items():
        total = total + w * (s if c == "stability_score" else rows.field(c).to_numpy(zero_copy_only=False)[:, None])
    return _lists(np.ascontiguousarray(np.broadcast_to(total, s.shape)))


def bootstrap_arrays(
    df: DataFrame, scores: DataFrame, n: int = 100, seed: int = 42, weights: Mapping[str, float] = WEIGHTS,
    normalize: bool = False,
) -> DataFrame:
    """(gene, composites): the composite score of every gene in each of ``n`` iterations of resampled runs.

    A gene's stability part becomes ``0.7 * own + 0.3 * mean resampled run score``. With ``normalize``
    the parts are min-max scaled anew within each iteration: the limits of all iterations come from one vector
    aggregate, those of parts that iterations leave alone from one row. What is stored are the parts and run scores of a
    gene; numpy works its iterations out wherever they are read.
    """
    lists, draws = _run_lists(scores, n, seed)
    fixed = [c for c in COMPONENTS if c != "stability_score"]
    parts = df.select("gene", (0.7 * F.coalesce("stability_score", F.lit(0.0))).alias("_own"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in fixed])
    parts = materialize((normalize_scores(parts, fixed) if normalize else parts).join(lists, "gene", "left"))
    rows, limits = F.struct("_runs", "_values", "_own", *fixed), None

    if normalize and not parts.isEmpty():
        @F.arrow_udf("array<double>")
        def stabilities(rows: pa.Array) -> pa.Array:
            return _lists(_stabilities(rows, draws))

        found = parts.select(Summarizer.metrics("min", "max").summary(array_to_vector(stabilities(rows))).alias("l")).first()["l"]
        limits = found["min"].toArray(), found["max"].toArray()

    @F.arrow_udf("array<double>")
    def composites(rows: pa.Array) -> pa.Array:
        return _composites(rows, draws, weights, limits)

    return parts.select("gene", composites(rows).alias("composites"))


def bootstrap_rows(arrays: DataFrame) -> DataFrame:
    """``bootstrap_arrays`` as rows ``(gene, iteration, composite_bootstrap)``."""
    rows = arrays.select("gene", F.posexplode("composites").alias("iteration", "composite_bootstrap"))
    return rows.withColumn("iteration", F.col("iteration").cast("bigint"))


def bootstrap(df: DataFrame, scores: DataFrame, n: int = 100, seed: int = 42, **options) -> DataFrame:
    """Composite score and rank of every gene in each iteration; rows by iteration are made last, for the ranks."""
    return rank_iterations(bootstrap_arrays(df, scores, n, seed, **options))


def _falling(values: pa.Array) -> np.ndarray:
    """Unsigned numbers that rise as values fall: NaN first, missing ones last, equal for both zeros, as Spark sorts."""
    x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.uint64)
    keys = np.where(x < 0, bits, ~bits & np.uint64(2**63 - 1))
    keys[values.is_null().to_numpy(zero_copy_only=False)] = 2**64 - 1
    return keys


def _in_order(keys: np.ndarray, genes: pa.Array) -> np.ndarray:
    """Positions by key, then gene, a missing gene first; only genes of equal keys are compared."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    if same.any():
        tied = np.append(same, False) | np.append(False, same)
        at = order[tied]
        rows = pa.table({"key": keys[at], "gene": genes.take(pa.array(at))})
        order[tied] = at[pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("gene", "ascending")], null_placement="at_start").to_numpy()]
    return order


def _by_iteration(genes: pa.Array, lists: pa.Array) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(iteration, genes, values) of every position that any of the lists has."""
    lengths, starts = pc.fill_null(lists.value_lengths(), 0).to_numpy(), lists.offsets.to_numpy()[:-1]
    for i in range(lengths.max(initial=0)):
        rows = np.flatnonzero(lengths > i)
        values = lists.values.take(pa.array(starts[rows] + i))
        yield i, genes if len(rows) == len(genes) else genes.take(pa.array(rows)), values


def _cuts(arrays: DataFrame, ranges: int) -> list[tuple[np.ndarray, pa.Array]]:
    """For each iteration the keys and genes that begin its ranges but the first, in order, from a sample of genes.

    The sample decides how even ranges are, never what is in them together.
    """
    share = max(1, ranges * RANGE_ROWS // min(128 * ranges, 1 << 14))
    sample = arrays.filter(F.col("gene").isNotNull() & (F.pmod(F.xxhash64("gene"), F.lit(share)) == 0)).toArrow().combine_chunks()
    cuts = []
    for _, genes, values in _by_iteration(*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in sample.columns)):
        keys = _falling(values)
        at = _in_order(keys, genes)[np.arange(1, ranges) * len(keys) // ranges]
        cuts.append((keys[at], genes.take(pa.array(at))))
    return cuts


def _ranges_of(keys: np.ndarray, genes: pa.Array, cuts: tuple[np.ndarray, pa.Array]) -> np.ndarray:
    """How many of the cuts are not behind each (key, gene)."""
    at, names = cuts
    place, last = np.searchsorted(at, keys, "left"), np.searchsorted(at, keys, "right")
    for first in np.unique(place[last > place]):
        tied = np.flatnonzero((place == first) & (last > first))
        mine = genes.take(pa.array(tied))
        place[tied] += sum(pc.fill_null(pc.greater_equal(mine, name), False).to_numpy(zero_copy_only=False).astype(int) for name in names[first : last[tied[0]]])
    return place


def _dealt(batches: Iterator[pa.RecordBatch], cuts: Sequence[tuple[np.ndarray, pa.Array]]) -> Iterator[tuple[int, np.ndarray, pa.Array, pa.Array]]:
    """(iteration, ranges, genes, values) of ``DEALT_ROWS`` genes at a time."""
    def dealt(held: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array, pa.Array]]:
        for i, genes, values in _by_iteration(*pa.concat_batches(held).columns):
            yield i, _ranges_of(_falling(values), genes, cuts[i]) if i < len(cuts) else np.zeros(len(genes), int), genes, values

    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= DEALT_ROWS:
            yield from dealt(held)
            held = []
    if held:
        yield from dealt(held)


def _count_ranges(batches: Iterator[pa.RecordBatch], cuts: Sequence[tuple[np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
    for i, place, _, _ in _dealt(batches, cuts):
        held, rows = np.unique(place, return_counts=True)
        yield pa.record_batch({"iteration": np.full(len(held), i), "range": held.astype(np.int32), "n": rows})


def _pack_ranges(batches: Iterator[pa.RecordBatch], cuts: Sequence[tuple[np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
    """One row for each iteration and range of a batch, with its genes and values as a compressed Arrow stream."""
    packing = pa.ipc.IpcWriteOptions(compression="zstd")

    def packed(rows: pa.RecordBatch) -> bytes:
        block = pa.BufferOutputStream()
        with pa.ipc.new_stream(block, rows.schema, options=packing) as out:
            out.write_batch(rows)
        return block.getvalue().to_pybytes()

    for i, place, genes, values in _dealt(batches, cuts):
        order = np.argsort(place.astype(np.uint16), kind="stable")
        held, starts = np.unique(place[order], return_index=True)
        rows = pa.record_batch({"gene": genes, "value": values}).take(pa.array(order))
        blocks = [packed(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
        yield pa.record_batch({"iteration": np.full(len(held), i), "range": held.astype(np.int32), "block": pa.array(blocks, pa.binary())})


def _ranked_range(blocks: pa.ChunkedArray, iteration: int, earlier: int) -> pa.Table:
    rows = pa.Table.from_batches([b for block in blocks for b in pa.ipc.open_stream(block.as_buffer())]).combine_chunks().to_batches()[0]
    genes, values = rows.columns
    order = pa.array(_in_order(_falling(values), genes))
    return pa.table({
        "gene": genes.take(order), "iteration": np.full(len(rows), iteration), "composite_bootstrap": values.take(order),
        "rank_bootstrap": np.arange(earlier + 1, earlier + len(rows) + 1),
    })


def rank_iterations(arrays: DataFrame) -> DataFrame:
    """``bootstrap_rows`` with the rank of every gene within its iteration.

    An iteration is cut into ranges of about ``RANGE_ROWS`` genes by (composite, gene) of sampled genes. Each batch of
    genes sends every range of every iteration one packed block, a range is sorted by itself, and the genes of earlier
    ranges are counted before. Nothing is stored; ``arrays`` is read up to three times and has to give the same values.
    """
    arrays = arrays.select("gene", "composites")
    ranges = -(-arrays.count() // RANGE_ROWS)
    cuts, earlier = [], {}
    if ranges > 1:
        cuts = _cuts(arrays, ranges)
        counted = arrays.mapInArrow(lambda batches: _count_ranges(batches, cuts), "iteration bigint, range int, n bigint")
        sizes = counted.groupBy("iteration", "range").agg(F.sum("n").alias("n")).collect()  # iterations x ranges
        reached: dict[int, int] = {}
        for iteration, place, rows in sorted(map(tuple, sizes)):
            earlier[iteration, place] = reached.get(iteration, 0)
            reached[iteration] = earlier[iteration, place] + rows
    packed = arrays.mapInArrow(lambda batches: _pack_ranges(batches, cuts), "iteration bigint, range int, block binary")
    gene = T.StructField("gene", arrays.schema["gene"].dataType)
    schema = T.StructType([gene]).add("iteration", "long").add("composite_bootstrap", "double").add("rank_bootstrap", "long")

    def ranked(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        return _ranked_range(blocks["block"], key[0].as_py(), earlier.get((key[0].as_py(), key[1].as_py()), 0))

    return packed.groupBy("iteration", "range").applyInArrow(ranked, schema)


def bootstrap_ci(arrays: DataFrame) -> DataFrame:
    """Mean and 95% interval per gene of ``bootstrap_arrays``, each worked out inside its row."""
    n = F.size("_sorted")

    def quantile(q: float) -> Column:
        position = (n - 1) * F.lit(q)
        low, high = (F.get("_sorted", f(position).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (position - F.floor(position))

    return arrays.withColumn("_sorted", F.sort_array("composites")).select(
        "gene",
        (F.aggregate("composites", F.lit(0.0), lambda a, x: a + x) / n).alias("bootstrap_mean"),
        quantile(0.025).alias("bootstrap_ci_lower"),
        quantile(0.975).alias("bootstrap_ci_upper"),
    )


def set_summary(ranked: DataFrame, sets: DataFrame, rank: str = "final_rank", score: str = "composite_score") -> DataFrame:
    """Overlap, top hits and mean scores per gene set; sets without a ranked gene drop out."""
    joined = sets.select("pathway", "gene").distinct().join(
        ranked.select("gene", rank, score, "attribution_score", "perturbation_score"), "gene"
    )
    return joined.groupBy("pathway").agg(
        F.count("*").alias("pathway_gene_count"),
        F.count_if(F.col(rank) <= 25).alias("top25_hits"),
        F.count_if(F.col(rank) <= 100).alias("top100_hits"),
        F.avg(score).alias("mean_composite"),
        F.avg("attribution_score").alias("mean_attribution_score"),
        F.avg("perturbation_score").alias("mean_perturbation_score"),
    )


def top_n(df: DataFrame, n: int, rank: str = "final_rank") -> DataFrame:
    return df.filter(F.col(rank) <= n)


def rank_matrix(scores: DataFrame, ranked: DataFrame, runs: Sequence[str], k: int = 25, rank: str = "final_rank") -> DataFrame:
    """Rank of the top ``k`` genes in every declared run, one column per run id ``<seed>_fold<fold>``."""
    top = top_n(ranked, k, rank).select("gene")
    run_id = F.concat(F.col("seed").cast("string"), F.lit("_fold"), F.col("outer_fold").cast("string"))
    return scores.join(top, "gene", "left_semi").withColumn("run_id", run_id).groupBy("gene").pivot(
        "run_id", list(runs)
    ).agg(F.avg("rank_within_run"))


def ranked_effects(ranked: DataFrame, effects: DataFrame, k: int = 20, rank: str = "final_rank") -> DataFrame:
    """The best ranked genes that have effects, with those effects."""
    return ranked.select("gene", rank).join(effects, "gene").orderBy(rank, "gene").limit(k)
