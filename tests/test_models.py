import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortwright.operators import models as m


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int)
    rows = [(f"s{i}", f"p{i}", int(y[i]), i % 2 + 1, i // 2 % 2 + 1, [float(v) for v in x[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, patient_id string, disease_label int, outer_fold int, inner_fold int, x array<double>")
    df = df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("disease_label").cast("double"))
    return x, y, m.balance_weights(df).cache()


def test_grids_have_the_documented_sizes():
    assert [len(m.candidates(n)) for n in ("LR_L1", "LR_ElasticNet", "RandomForest", "GBT")] == [8, 24, 24, 16]


def test_balanced_weights_sum_to_n(data):
    _, y, df = data
    total = df.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert {round(r["w"], 6) for r in total} == {60.0}


def test_l1_objective_is_at_its_optimum(data):
    """Subgradient conditions of C * sum(loss) + |w|_1 at the fitted coefficients."""
    x, y, df = data
    c = 0.5
    fitted = m.model("LR_L1", {"C": c, "class_weight": None, "max_iter": 1000}, 120, 6).setTol(1e-12).fit(df)
    w, b = fitted.coefficients.toArray(), fitted.intercept
    gradient = c * x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert abs((1 / (1 + np.exp(-(x @ w + b))) - y).sum()) < 1e-3
    for wi, gi in zip(w, gradient):
        assert abs(gi + np.sign(wi)) < 1e-2 if wi else abs(gi) <= 1 + 1e-6


def test_search_keeps_the_first_best_and_logs_every_fit(data):
    _, _, df = data
    grid = [{"C": 1e-6, "class_weight": None}, {"C": 1.0, "class_weight": None}, {"C": 1.0, "class_weight": None}]
    fitted, params, log = m.grid_search(m.inner_sets(df), df, "LR_L1", grid)
    rows = log.collect()
    assert len(rows) == 6 and {r["candidate_index"] for r in rows if r["selected_best"]} == {2}
    assert params == grid[1] and json.loads(rows[0]["params_json"])["class_weight"] is None
    # The first candidate shrinks every weight to zero, so all scores tie.
    assert {r["inner_auc"] for r in rows if r["candidate_index"] == 1} == {0.5}


def test_assemble_orders_slots(spark):
    long = spark.createDataFrame([("s", "b", 2.0), ("s", "a", 1.0), ("s", "x", 9.0)], "sample_id string, gene string, value double")
    assert m.assemble(long, ["a", "b"]).first()["features"].toArray().tolist() == [1.0, 2.0]


@pytest.mark.parametrize("strict", [True, False])
def test_nested_predictions_cover_every_sample_once(spark, data, tmp_path, strict):
    _, _, df = data
    long = df.select("sample_id", F.posexplode("x").alias("i", "value")).select("sample_id", F.concat(F.lit("g"), F.col("i").cast("string")).alias("gene"), "value")
    out = m.oof_predict(long, df, {"LR_L1": [{"C": 1.0, "class_weight": None}]}, [1], inner_k=2, top=4, least=2, most=5, inner_strict=strict, save_to=str(tmp_path / "m"))
    rows = out["predictions"].collect()
    assert len(rows) == 120 and len({r["sample_id"] for r in rows}) == 120
    assert out["weights"].count() == 8 and out["history"].count() > 2
    assert {(r["original_gene_count"], r["retained_gene_count"], r["selected_variable_genes"]) for r in out["feature_summary"].collect()} == {(6, 6, 4)}
    assert LogisticRegressionModel.load(str(tmp_path / "m" / "LR_L1_seed_1_outer_fold_1")).numFeatures == 4


def test_flags_and_projection(spark, data):
    w = spark.createDataFrame([(1, 1, f"g{i}", i / 10, i / 10) for i in range(11)], "seed int, outer_fold int, gene string, gate_weight double, abs_gate_weight double")
    assert {r["gene"] for r in m.flag_top(w).filter("selected_flag = 1").collect()} == {"g9", "g10"}
    assert m.sparsity_share(w).first()["gate_sparsity_fraction"] == pytest.approx(1 / 11)
    x, _, df = data
    got = m.pca2(df).select("sample_id", "latent_1").toPandas().set_index("sample_id")["latent_1"].loc[[f"s{i}" for i in range(120)]]
    centred = x - x.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2][0]
    v = v * np.sign(v[np.abs(v).argmax()])
    assert np.allclose(got, centred @ v, atol=1e-8)


def test_boosted_trees_do_not_split_on_rounding(spark):
    """One slot separates the label; what sums over 3,000 rows leave of a pure leaf's variance is no reason to split on others."""
    from cohortwright.operators.ranking import features_used

    label = F.col("id") % 3 == 0
    slots = F.array(*[F.rand(k) for k in range(4)], F.when(label, 4.0).otherwise(-4.0))
    rows = spark.range(3_000).select(label.cast("double").alias("label"), array_to_vector(slots).alias("features"))
    params = {"learning_rate": 0.03, "max_depth": 3, "n_estimators": 30, "subsample": 0.8}
    assert features_used(m.model("GBT", params, 3_000, 5).fit(rows)) == {4}


def test_inner_rows_are_stored_once(spark, monkeypatch):
    """Candidates fit on stored vectors, not on a preparation that each fit works out again."""
    rows = spark.createDataFrame([(float(i % 2), [float(i % 2), i / 40], i // 2 % 2 + 1, 1.0) for i in range(40)], "label double, values array<double>, inner_fold int, weight double")
    prep = m.Prep(np.zeros(2), np.zeros(2), np.ones(2))
    shared = rows.withColumn("features", prep.features("values"))
    stored, original = [], m.materialize
    monkeypatch.setattr(m, "materialize", lambda df, *a: (stored.append(df.columns), original(df, *a))[1])
    _, best, log = m.grid_search(m.inner_sets(shared, features={1: prep.features("values"), 2: prep.features("values")}), shared, "LR_L1", [{"C": 1.0}, {"C": 5.0}])
    assert stored.count(["features", "label", "weight"]) == 2
    assert best == {"C": 1.0} and log.count() == 4


def test_forests_remember_each_rows_node(spark, data):
    """Else every level's tasks carry whole trees and walk all rows from the root; the trees stay the same."""
    _, _, df = data
    grown = m.model("RandomForest", {"n_estimators": 5}, 120, 6)
    assert grown.getCacheNodeIds()
    df.count()
    stored = set(spark.sparkContext._jsc.getPersistentRDDs())
    trees = [forest.fit(df).toDebugString.split("\n", 1)[1] for forest in (grown, grown.copy({grown.cacheNodeIds: False}))]
    assert trees[0] == trees[1]
    # Nothing stays stored after a fit.
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= stored
