import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortwright.operators import distributed as d
from cohortwright.operators import models as m
from cohortwright.operators import ranking as r

GENES = ["g0", "g1", "g2"]


@pytest.fixture(scope="module")
def runs(spark):
    """Two runs over forty genes, most of which tie at zero."""
    rng = np.random.default_rng(2)
    rows = []
    for fold in (1, 2):
        for i in range(40):
            w = float(rng.integers(1, 9)) / 8 if i < 12 else 0.0
            rows.append((1, fold, f"g{i:02d}", w, abs(w), int(i < 4)))
    cols = ["seed", "outer_fold", "gene", "gate_weight", "abs_gate_weight", "selected_flag"]
    frame = pd.DataFrame(rows, columns=cols)
    return frame, spark.createDataFrame(frame)


def test_rank_within_run_averages_ties(spark, runs):
    frame, df = runs
    attr = spark.createDataFrame([], "seed int, outer_fold int, gene string, mean_abs_attribution double")
    got = r.run_scores(attr, df).toPandas()
    frame = frame.assign(want=frame.groupby("outer_fold")["abs_gate_weight"].rank(ascending=False))
    both = got.merge(frame, on=["outer_fold", "gene"])
    assert len(both) == 80 and np.allclose(both["rank_within_run"], both["want"])
    assert both["rank_within_run"].max() > 20


@pytest.mark.parametrize("partitions", ["2", "9"])
def test_ties_across_ranges(spark, partitions):
    """One run of which nine tenths score zero, in more ranges than one; a null group and a tie at every range's end."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"run": ["hot"] * 2000 + ["b"] * 60 + [None] * 7, "gene": [f"g{i}" for i in range(2067)]})
    frame["score"] = np.where(rng.random(2067) < 0.9, 0.0, rng.integers(0, 6, 2067) / 4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = d.tie_ranks(spark.createDataFrame(frame.astype({"run": object})), ["run"], "score", ["gene"], "place")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = out.toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not [line for line in plan.splitlines() if "Join" in line and "score" in line]
    frame["want"] = frame.groupby("run", dropna=False)["score"].rank(ascending=False)
    both = got.merge(frame, on="gene")
    assert len(both) == 2067 and (both["place"] == both["want"]).all()


def test_stability_by_hand(spark):
    rows = [(1, f, g, float(rank), score) for f in (1, 2) for g, rank, score in (("a", 1 + f, 0.5 * f), ("b", 50, 0.2), ("z", 200, 0.0))]
    rows.append((1, 1, "once", 30.0, 0.4))
    df = spark.createDataFrame(rows, "seed int, outer_fold int, gene string, rank_within_run double, run_predictive_score double")
    got = {x["gene"]: x for x in r.stability(df).collect()}
    cv_a = np.std([0.5, 1.0], ddof=1) / 0.75
    assert got["a"]["stability_score_raw"] == pytest.approx(0.4 + 0.3 + 0.2 / (1 + np.std([2, 3], ddof=1)) + 0.1 / (1 + cv_a))
    # One run only: the widest rank spread and the median variation stand in.
    assert got["once"]["rank_std"] is None
    want = 0.3 + 0.2 / (1 + np.std([2, 3], ddof=1)) + 0.1 / (1 + np.median([cv_a, 0.0]))
    assert got["once"]["stability_score_raw"] == pytest.approx(want)
    assert got["z"]["importance_cv"] is None


def test_linear_attribution_sums_to_the_logit_difference(spark):
    long = spark.createDataFrame([("s", 1, "g0", 2.0), ("s", 1, "g1", None), ("s", 2, "g0", 9.0)], "sample_id string, outer_fold int, gene string, value double")
    w = spark.createDataFrame([(7, 1, "g0", 0.5), (7, 1, "g1", 3.0)], "seed int, outer_fold int, gene string, weight double")
    rows = r.attribute(long, w, ["integrated_gradients", "gradient_x_input", "gate_weight"], 1.0).collect()
    got = {(x["attribution_method"], x["gene"]): x["attribution_value"] for x in rows}
    assert got == {
        ("integrated_gradients", "g0"): 0.5, ("integrated_gradients", "g1"): -3.0, ("gradient_x_input", "g0"): 1.0,
        ("gradient_x_input", "g1"): 0.0, ("gate_weight", "g0"): 0.5, ("gate_weight", "g1"): 3.0,
    }
    with pytest.raises(ValueError):
        r.attribute(long, w, ["other"])


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=80) > 0).astype(int)
    rows = [(f"s{i}", 1, int(y[i]), [float(v) for v in x[i]]) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id string, outer_fold int, disease_label int, x array<double>")
    df = df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("disease_label").cast("double"))
    return df, LogisticRegression(regParam=0.01, elasticNetParam=1.0, standardization=False).fit(df)


def test_linear_perturbation_equals_rescoring_with_the_model(spark, fitted):
    df, model = fitted
    long = df.select("sample_id", "outer_fold", "disease_label", F.posexplode("x").alias("i", "value")).select(
        "sample_id", "outer_fold", "disease_label", F.concat(F.lit("g"), F.col("i").cast("string")).alias("gene"), "value"
    )
    refs = r.class_reference(long, by=["outer_fold", "gene"])
    w = m.feature_weights(model, GENES, spark).select(F.lit(1).alias("seed"), F.lit(1).alias("outer_fold"), "gene", F.col("gate_weight").alias("weight"))
    icpt = spark.createDataFrame([(1, 1, float(model.intercept))], "seed int, outer_fold int, intercept double")
    assert r.features_used(model) == {i for i, c in enumerate(model.coefficients.toArray()) if c}
    linear = r.perturb(long, w, refs.filter("gene <> 'g2'"), icpt).toPandas().set_index(["sample_id", "gene"])
    general = r.perturb_with_model(df, model, GENES, refs).toPandas().set_index(["sample_id", "gene"])
    assert len(linear) == 160 and len(general) == 240
    both = linear.join(general, rsuffix="_model")
    for c in ("original_prob", "perturbed_prob", "delta_prob"):
        assert np.allclose(both[c], both[f"{c}_model"], atol=1e-9)
    summary = {x["gene"]: x for x in r.perturb_by_run(r.perturb(long, w, refs, icpt)).collect()}
    assert summary["g0"]["mean_delta_prob_tumor"] < 0 < summary["g0"]["mean_delta_prob_normal"]


@pytest.mark.parametrize("block", [3, 16])
def test_rescoring_all_genes(spark, block):
    """Sixty-four genes: equal to the closed form for a linear model; unused slots of trees don't move, used ones are rescored."""
    rng = np.random.default_rng(11)
    x, genes = rng.normal(size=(60, 64)), [f"g{i}" for i in range(64)]
    y = (x[:, 3] + 0.5 * x[:, 9] > 0).astype(int)
    rows = [(f"s{i}", 1, int(y[i]), [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, outer_fold int, disease_label int, x array<double>")
    df = df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("disease_label").cast("double")).cache()
    long = df.select("sample_id", "outer_fold", "disease_label", F.posexplode("x").alias("i", "value")).withColumn("gene", F.concat(F.lit("g"), F.col("i").cast("string")))
    refs = r.class_reference(long, by=["outer_fold", "gene"])
    model = LogisticRegression(regParam=0.02, elasticNetParam=1.0, standardization=False).fit(df)
    w = m.feature_weights(model, genes, spark).select(F.lit(1).alias("seed"), F.lit(1).alias("outer_fold"), "gene", F.col("gate_weight").alias("weight"))
    icpt = spark.createDataFrame([(1, 1, float(model.intercept))], "seed int, outer_fold int, intercept double")
    linear = r.perturb(long.drop("i"), w, refs, icpt).toPandas().set_index(["sample_id", "gene"]).sort_index()
    general = r.perturb_with_model(df, model, genes, refs.drop("outer_fold"), block=block).toPandas().set_index(["sample_id", "gene"]).sort_index()
    assert len(general) == 60 * 64 and np.allclose(general["delta_prob"], linear["delta_prob"], atol=1e-9)
    trees = m.model("GBT", {"learning_rate": 0.1, "max_depth": 2, "n_estimators": 4, "subsample": 1.0}, 60, 64).fit(df)
    used = r.features_used(trees)
    moved = r.perturb_with_model(df, trees, genes, refs.drop("outer_fold"), block=block).toPandas()
    assert {3} <= used < set(range(64)) and len(moved) == 60 * 64
    assert (moved[~moved.gene.isin([f"g{i}" for i in used])].delta_prob == 0).all()
    reference = refs.filter("gene = 'g3'").first()
    swapped = x.copy()
    swapped[:, 3] = np.where(y == 1, reference["reference_0"], reference["reference_1"])
    again = spark.createDataFrame([(f"s{i}", [float(v) for v in swapped[i]]) for i in range(60)], "sample_id string, x array<double>").withColumn("features", array_to_vector("x"))
    want = {q["sample_id"]: q["p"] for q in trees.transform(again).select("sample_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = moved[moved.gene == "g3"].set_index("sample_id").perturbed_prob
    assert all(got[s] == pytest.approx(p) for s, p in want.items())
    with pytest.raises(ValueError, match="one row each"):
        r.perturb_with_model(df, trees, genes, refs.union(refs).drop("outer_fold"))


def test_class_reference_falls_back_to_the_overall_median(spark):
    df = spark.createDataFrame([("g", 1, float(v)) for v in range(11)], "gene string, disease_label int, value double")
    assert tuple(r.class_reference(df).first()) == ("g", 5.0, 9.0)
    assert tuple(r.class_reference(df, reference="median").first()) == ("g", 5.0, 5.0)


def test_environment_effects_and_invariance(spark):
    attr = spark.createDataFrame([(f"s{i}", "g", (-1.0) ** i * (1 + i % 2)) for i in range(40)], "sample_id string, gene string, attribution_value double")
    envs = spark.createDataFrame([(f"s{i}", "a" if i < 20 else ("b" if i < 35 else None)) for i in range(40)], "sample_id string, env string")
    pert = spark.createDataFrame([(f"s{i}", "g", 0.5) for i in range(15)], "sample_id string, gene string, delta_prob double")
    effects = r.environment_effects(attr, pert, envs, ["env", "gone"], 10)
    got = {x["environment_level"]: x for x in effects.collect()}
    assert set(got) == {"a", "b"} and got["a"]["n_samples"] == 20
    assert got["a"]["mean_perturbation_effect"] == 0.5 and got["b"]["mean_perturbation_effect"] is None
    inv = r.invariance(effects).first()
    a, b = (1.5 + 0.5) / 2, got["b"]["mean_attribution"]
    assert inv["environment_coverage"] == 2
    assert inv["invariance_score"] == pytest.approx(np.mean([a, b]) / (1 + np.std([a, b]) + abs(a - b)))


def test_normalize_composite_rank(spark):
    cols = "gene string, attribution_score double, gate_score double, stability_score double, invariance_score double, perturbation_score double, directional_consistency double"
    df = spark.createDataFrame([("b", 1.0, 0.2, 0.0, None, 1.0, 0.9), ("a", 3.0, 0.2, 0.5, None, 1.0, None), ("c", 3.0, 0.2, 0.5, None, 1.0, 0.1)], cols)
    n = r.normalize_scores(df)
    got = {x["gene"]: x for x in n.collect()}
    assert got["b"]["attribution_score"] == 0.0 and got["a"]["attribution_score"] == 1.0 and got["a"]["gate_score"] == 0.2
    assert got["a"]["invariance_score"] == 0.0
    ranked = r.rank_entities(r.composite(n)).orderBy("final_rank").collect()
    assert [x["gene"] for x in ranked] == ["a", "c", "b"] and ranked[2]["notes"].startswith("Stable")


def test_bootstrap(spark, runs):
    _, df = runs
    attr = spark.createDataFrame([], "seed int, outer_fold int, gene string, mean_abs_attribution double")
    scores = r.run_scores(attr, df).cache()
    genes = scores.select("gene").distinct()
    parts = genes.withColumns({c: F.lit(0.5) for c in r.COMPONENTS})
    draws = r.draw_table(scores, 6, 1)
    assert draws.groupBy("iteration").agg(F.sum("draws").alias("n")).filter("n <> 2").count() == 0
    boot = r.bootstrap(parts, scores, 6, 1).toPandas()
    assert len(boot) == 240 and boot.groupby("iteration")["rank_bootstrap"].apply(lambda s: sorted(s) == list(range(1, 41))).all()
    top = boot[boot.gene == "g00"].sort_values("iteration")["composite_bootstrap"].to_numpy()
    per_run = {(x["seed"], x["outer_fold"]): x["run_predictive_score"] for x in scores.filter("gene = 'g00'").collect()}
    for it, part in draws.toPandas().groupby("iteration"):
        mean = sum(per_run[s, f] * n for s, f, n in part[["seed", "outer_fold", "draws"]].itertuples(index=False)) / 2
        assert top[it] == pytest.approx(0.5 * 0.8 + 0.2 * (0.35 + 0.3 * mean))
    ci = r.bootstrap_ci(r.bootstrap_arrays(parts, scores, 6, 1)).filter("gene = 'g00'").first()
    assert ci["bootstrap_mean"] == pytest.approx(top.mean())
    for end, q in (("lower", 0.025), ("upper", 0.975)):
        assert ci[f"bootstrap_ci_{end}"] == pytest.approx(np.quantile(top, q))


def test_bootstrap_scales_each_iteration(spark, runs):
    """Parts differ, one is constant, and one gene has no run: scaled within every iteration by hand."""
    _, df = runs
    attr = spark.createDataFrame([], "seed int, outer_fold int, gene string, mean_abs_attribution double")
    scores = r.run_scores(attr, df).cache()
    rng = np.random.default_rng(5)
    frame = scores.select("gene").distinct().toPandas().sort_values("gene", ignore_index=True)
    frame = pd.concat([frame, pd.DataFrame({"gene": ["unscored"]})], ignore_index=True)
    for c in r.COMPONENTS:
        frame[c] = rng.random(len(frame)) if c != "invariance_score" else 0.25
    draws = r.draw_table(scores, 8, 3).toPandas()
    got = r.bootstrap(spark.createDataFrame(frame), scores, 8, 3, normalize=True).toPandas()
    mine = scores.toPandas()
    for it in range(8):
        drawn = mine.merge(draws[draws.iteration == it], on=["seed", "outer_fold"])
        means = drawn.groupby("gene").apply(lambda p: np.average(p.run_predictive_score, weights=p.draws), include_groups=False)
        parts = frame.set_index("gene")
        parts["stability_score"] = 0.7 * parts.stability_score + 0.3 * means.reindex(parts.index).fillna(0)
        scaled = parts.apply(lambda c: (c - c.min()) / (c.max() - c.min()) if c.max() > c.min() else c)
        total = sum(w * scaled[c] for c, w in r.WEIGHTS.items())
        one = got[got.iteration == it].set_index("gene")
        assert np.allclose(one.composite_bootstrap.reindex(total.index), total, atol=1e-12)
        assert one.sort_values("rank_bootstrap").index[0] == total.idxmax()


def test_bootstrap_makes_no_rows_by_iteration(spark, runs):
    _, df = runs
    scores = d.materialize(r.run_scores(spark.createDataFrame([], "seed int, outer_fold int, gene string, mean_abs_attribution double"), df))
    parts = scores.select("gene").distinct().withColumns({c: F.lit(0.5) for c in r.COMPONENTS})
    plan = r.bootstrap_ci(r.bootstrap_arrays(parts, scores, 50, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "iteration" not in plan


@pytest.mark.parametrize("normalize", [False, True])
def test_bootstrap_stores_no_iterations(spark, runs, normalize):
    """Iterations are worked out by numpy alone, from stored rows that hold none of them; the sums are those of single steps."""
    scores = d.materialize(r.run_scores(spark.createDataFrame([], "seed int, outer_fold int, gene string, mean_abs_attribution double"), runs[1]))
    rng = np.random.default_rng(9)
    names = [*sorted(x["gene"] for x in scores.select("gene").distinct().collect()), "unscored", None, None]
    rows = [(g, *(None if rng.random() < 0.2 else float(rng.normal()) for _ in r.COMPONENTS)) for g in names]
    parts = spark.createDataFrame(rows, f"gene string, {', '.join(f'{c} double' for c in r.COMPONENTS)}")
    before = set(os.listdir(d.scratch_root(spark)))
    arrays = r.bootstrap_arrays(parts, scores, 7, 3, normalize=normalize)
    for name in set(os.listdir(d.scratch_root(spark))) - before:
        assert not [f for f in spark.read.parquet(f"{d.scratch_root(spark)}/{name}").schema if f.name in ("_resampled", "_stability")]
    plan = arrays._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    means = {x["gene"]: x["_resampled"] for x in r._resampled(scores, 7, 3).collect()}
    value = {c: np.array([x[i + 1] or 0.0 for x in rows]) for i, c in enumerate(r.COMPONENTS)}
    got = {}
    for x in arrays.collect():
        got.setdefault(x["gene"], []).append(x["composites"])
    for it in range(7):
        total = np.zeros(len(rows))
        for c, w in r.WEIGHTS.items():
            v = value[c]
            if c == "stability_score":
                v = 0.7 * v + 0.3 * np.array([(means.get(g) or [None] * 7)[it] or 0.0 for g in names])
            total = total + w * ((v - v.min()) / (v.max() - v.min()) if normalize else v)
        want = {}
        for g, t in zip(names, total):
            want.setdefault(g, []).append(t)
        assert {g: sorted(v[it] for v in vs) for g, vs in got.items()} == {g: sorted(v) for g, v in want.items()}


@pytest.mark.parametrize("dealt", [64, 1 << 16])
def test_iterations_are_ranked_without_rows_by_iteration(spark, monkeypatch, dealt):
    """Many ranges: ties within and across them, missing genes and values, NaN, both zeros, lists of all lengths. Nothing
    is exploded or stored, blocks of a range are all that is shuffled."""
    monkeypatch.setattr(r, "RANGE_ROWS", 50, raising=False)
    monkeypatch.setattr(r, "DEALT_ROWS", dealt, raising=False)
    rng = np.random.default_rng(4)
    odd = [None, float("nan"), 0.0, -0.0, float("inf"), -float("inf"), -1.5]

    def value(i, j):
        if j == 0:
            return 0.25 if i % 10 else float(rng.random())
        return odd[rng.integers(len(odd))] if rng.random() < 0.2 else float(rng.normal())

    genes = [None if i % 300 == 7 else f"g{i}" if i % 11 else f"\u00e9{i}\U0001f600" for i in range(900)]
    rows = [(g, None if i % 101 == 5 else [value(i, j) for j in range(3 if i % 13 else i % 4)]) for i, g in enumerate(genes)]
    arrays = d.materialize(spark.createDataFrame(rows, "gene string, composites array<double>").repartition(5))
    stored = set(os.listdir(d.scratch_root(spark)))
    out = r.rank_iterations(arrays)
    assert set(os.listdir(d.scratch_root(spark))) == stored
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Generate", "Window", "Join"))

    def place(row):
        gene, v = row
        falling = (2, 0.0) if v is None else (0, 0.0) if v != v else (1, -v)
        return falling, (gene is not None, (gene or "").encode())

    got = out.collect()
    assert out.columns == ["gene", "iteration", "composite_bootstrap", "rank_bootstrap"] and len(got) == sum(len(v or []) for _, v in rows)
    for j in range(3):
        want = sorted(((g, v[j]) for g, v in rows if v and len(v) > j), key=place)
        mine = sorted((x for x in got if x["iteration"] == j), key=lambda x: x["rank_bootstrap"])
        assert [x["rank_bootstrap"] for x in mine] == list(range(1, len(want) + 1))
        assert [place((x["gene"], x["composite_bootstrap"])) for x in mine] == [place(x) for x in want]


def test_set_summary_drops_sets_without_overlap(spark):
    ranked = spark.createDataFrame([("a", 1, 0.9, 0.5, 0.1), ("b", 30, 0.3, 0.1, 0.3)], "gene string, final_rank int, composite_score double, attribution_score double, perturbation_score double")
    sets = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "a"), ("q", "zz")], "pathway string, gene string")
    rows = r.set_summary(ranked, sets).collect()
    assert len(rows) == 1 and (rows[0]["pathway_gene_count"], rows[0]["top25_hits"], rows[0]["top100_hits"]) == (2, 1, 2)


def test_environment_effects_sum_combinations_of_levels(spark):
    """Changes count towards their own threshold, and both tables meet in one row per sample and gene."""
    envs = spark.createDataFrame([("a", "x", "u"), ("b", "x", None), ("c", "y", "u")], "sample_id string, e1 string, e2 string")
    attr = spark.createDataFrame([("a", "g", 1.0), ("a", "g", -3.0), ("b", "g", None), ("c", "g", 2.0), ("b", "h", 5.0)], "sample_id string, gene string, attribution_value double")
    pert = spark.createDataFrame([("a", "g", 0.5), ("b", "g", 0.1), ("c", "k", 0.7)], "sample_id string, gene string, delta_prob double")
    out = r.environment_effects(attr, pert, envs, ["e1", "e2"], 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(x)[:3]: tuple(x)[3:] for x in out.collect()}
    assert got[("e1", "x", "g")] == (2.0, pytest.approx(0.3), 2, 2)
    assert got[("e1", "y", "g")] == (2.0, None, 1, 1) and got[("e2", "u", "g")] == (2.0, 0.5, 3, 2)
    assert got[("e1", "x", "h")] == (5.0, None, 1, 1) and len(got) == 4
    # One join with the environments, of rows that both tables share.
    assert plan.count("Join ") == 1


def test_drawn_means_by_hand():
    """A run drawn twice counts twice, undrawn or missing runs give null, a missing score leaves its gene out; batches don't matter."""
    import pyarrow as pa

    draws = np.array([[2.0, 0.0, 1.0], [0.0, 0.0, 2.0], [1.0, 3.0, 0.0]])
    runs, values = pa.array([[0, 1, 2], [1], [], [2, 0]], pa.list_(pa.int32())), pa.array([[1.0, 2.0, 4.0], [7.0], [], [None, 1.0]], pa.list_(pa.float64()))
    want = [[2.0, 4.0, 5.0 / 3.0], [None, None, 7.0], [None] * 3, [None] * 3]
    for most in (1, 3, 2_048):
        assert r._drawn_means(runs, values, draws, most).to_pylist() == want


def test_resampling_runs_no_expression_per_draw(spark, runs):
    attr = spark.createDataFrame([], "seed int, outer_fold int, gene string, mean_abs_attribution double")
    scores = r.run_scores(attr, runs[1])
    plan = r._resampled(scores, 50, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan
