import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwright.operators import metrics as m


def pairwise_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    wins = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def step_ap(y, p):
    if y.sum() in (0, len(y)):
        return None
    total = 0.0
    for score in sorted(set(p), reverse=True):
        at = p >= score
        total += y[p == score].sum() * y[at].mean()
    return total / y.sum()


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": np.where(np.arange(900) < 700, "big", "small"), "y_true": rng.integers(0, 2, 900)})
    frame["y_prob"] = np.round(np.clip(0.3 * frame.y_true + rng.uniform(0, 0.7, 900), 0, 1), 2)
    single = pd.DataFrame({"g": "single", "y_true": [1, 1, 1], "y_prob": [0.2, 0.7, 0.7]})
    frame = pd.concat([frame, single], ignore_index=True)
    frame["sample_id"] = [str(i) for i in range(len(frame))]
    return frame, spark.createDataFrame(frame)


def test_auroc_and_precision_match_brute_force(scored):
    frame, df = scored
    rows = {r["g"]: r for r in m.binary_metrics(df, ["g"]).collect()}
    for key, part in frame.groupby("g"):
        y, p = part.y_true.to_numpy(), part.y_prob.to_numpy()
        want = pairwise_auroc(y, p)
        if want is None:
            assert rows[key]["auroc"] is None and rows[key]["auprc"] is None
            continue
        assert rows[key]["auroc"] == pytest.approx(want, abs=1e-12)
        assert rows[key]["auprc"] == pytest.approx(step_ap(y, p), abs=1e-12)
        assert rows[key]["brier_score"] == pytest.approx(((p - y) ** 2).mean(), abs=1e-12)


def test_auroc_of_the_complement(scored):
    _, df = scored
    flipped = df.withColumn("y_prob", 1.0 - F.col("y_prob"))
    a = {r["g"]: r["auroc"] for r in m.auroc(df, ["g"]).collect()}
    b = {r["g"]: r["auroc"] for r in m.auroc(flipped, ["g"]).collect()}
    assert a["big"] + b["big"] == pytest.approx(1.0) and a["single"] is None and b["single"] is None


def test_degenerate_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8)], "y_true int, y_prob double")
    row = m.threshold_metrics(df).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (2, 0, 0, 0)
    assert row["balanced_accuracy"] == 1.0 and row["mcc"] == 0.0 and row["f1"] == 1.0 and row["specificity"] is None
    none = m.threshold_metrics(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y_true int, y_prob double")).first()
    assert none["f1"] == 0.0 and none["mcc"] == 0.0 and none["sensitivity"] is None


def test_curves_start_and_end(scored):
    _, df = scored
    roc = m.roc_points(df.filter("g = 'big'"), ["g"]).orderBy("fpr", "tpr").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(m.auroc(df.filter("g = 'big'")).first()["auroc"])
    pr = m.pr_points(df.filter("g = 'big'"), ["g"]).filter("threshold IS NULL").first()
    assert (pr["precision"], pr["recall"]) == (1.0, 0.0)


def test_calibration_matches_pandas(scored):
    frame, df = scored
    got = m.calibration(df.filter("g <> 'single'"), ["g"], 10).toPandas()
    for key, part in frame[frame.g != "single"].groupby("g"):
        bins = pd.qcut(part["y_prob"], q=min(10, part["y_prob"].nunique()), duplicates="drop")
        want = part.groupby(bins, observed=False).agg(p=("y_prob", "mean"), o=("y_true", "mean"), n=("y_true", "size"))
        mine = got[got.g == key].sort_values("bin")
        assert mine["samples"].tolist() == want["n"].tolist()
        assert mine["mean_predicted_probability"].tolist() == pytest.approx(want["p"].tolist())
        assert mine["observed_fraction"].tolist() == pytest.approx(want["o"].tolist())


def test_few_distinct_scores_in_calibration(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (1, 0.9)], "y_true int, y_prob double")
    rows = m.calibration(df, [], 10).orderBy("bin").collect()
    assert sum(r["samples"] for r in rows) == 3


def test_subgroup_status_and_missing_level(spark):
    rows = [("a", 1, "x" if i % 2 else None, i % 2 if i < 4 else int(i % 4 < 2), i / 40) for i in range(40)]
    df = spark.createDataFrame(rows, "model_name string, seed int, env string, y_true int, y_prob double")
    out = {r["subgroup_value"]: r for r in m.subgroup_metrics(df, ["env"]).collect()}
    assert set(out) == {"x", "unknown"} and out["unknown"]["n_samples"] == 20
    few = m.subgroup_metrics(df.limit(5), ["env"]).collect()
    assert all(r["status"] == "too_small" and r["auroc"] is None for r in few)


def test_environment_and_invariance(spark):
    rows = [(1, 1, level, (i + k) % 2, (i * 7 % 10) / 10) for k, level in enumerate("ab") for i in range(10)]
    df = spark.createDataFrame(rows, "seed int, outer_fold int, env string, y_true int, y_prob double")
    env = m.environment_metrics(df, ["env", "gone"])
    status = {(r["environment_column"], r["environment_level"]): r["status"] for r in env.collect()}
    assert status == {("env", "a"): "evaluated", ("env", "b"): "evaluated", ("gone", "missing"): "missing"}
    inv = m.invariance_summary(env).collect()
    assert len(inv) == 1 and inv[0]["n_levels"] == 2


def test_risk_variance_by_hand(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.25), ("b", 0, 0.75), ("c", 1, 0.9), (None, 1, 0.0)]
    df = spark.createDataFrame(rows, "env string, y_true int, y_prob double")
    out = {r["environment_column"]: r["risk_variance"] for r in m.risk_variance(df, ["env"]).collect()}
    want = np.var([math.log(2), math.log(4)])
    assert out["env"] == pytest.approx(want) and out["all"] == pytest.approx(want)
    assert m.risk_variance(df.limit(2), ["env"]).filter("environment_column = 'all'").first()["risk_variance"] == 0.0


def test_winners(spark):
    cols = "model_name string, auroc_mean double, auprc_mean double, balanced_accuracy_mean double, mcc_mean double, brier_score_mean double, auroc_std double, auprc_std double"
    rows = [("b", 0.9, 0.5, 0.5, 0.1, 0.2, None, 0.1), ("a", 0.9, 0.5, 0.5, 0.1, 0.1, 0.2, 0.2), ("c", None, 0.9, 0.9, 0.9, 0.3, 0.1, 0.1)]
    assert m.pick_winners(spark.createDataFrame(rows, cols)).first().asDict() == {
        "best_baseline": "a", "best_calibrated": "a", "most_stable": "c",
    }
