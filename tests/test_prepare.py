import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwright.operators import prepare, profile


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(5, 2, (60, 6)), columns=[f"g{i}" for i in range(6)])
    wide["g5"] = 3.0
    wide = wide.mask(rng.random(wide.shape) < 0.1)
    wide.insert(0, "sample_id", [f"s{i:02d}" for i in range(60)])
    wide["outer_fold"] = np.arange(60) % 4 + 1
    long = wide.melt(["sample_id", "outer_fold"], var_name="gene", value_name="value")
    df = spark.createDataFrame(long).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return wide, df.repartition(5)


def pivot(df, wide):
    got = df.toPandas().pivot(index="sample_id", columns="gene", values="value")
    return got.loc[wide["sample_id"]].astype(float)


def test_impute_scale_and_rows_survive(matrix):
    wide, df = matrix
    genes = [f"g{i}" for i in range(6)]
    x = wide.set_index("sample_id")[genes]
    assert np.allclose(pivot(prepare.impute(df), wide), x.fillna(x.mean()))
    assert np.allclose(pivot(prepare.impute(df, stat="median"), wide), x.fillna(x.median()))
    z = ((x - x.mean()) / x.std(ddof=0).replace(0, np.nan)).fillna(0.0)
    z["g5"] = 0.0
    assert np.allclose(pivot(prepare.scale(df, "zscore"), wide), z)
    m = ((x - x.min()) / (x.max() - x.min()).replace(0, np.nan)).fillna(0.0)
    assert np.allclose(pivot(prepare.scale(df, "minmax"), wide), m)


def test_training_statistics_of_every_fold(matrix):
    wide, df = matrix
    stats = prepare.fit_prep(df, [1, 2, 3, 4]).toPandas().set_index(["outer_fold", "gene"])
    for fold in (1, 2, 3, 4):
        train = wide[wide.outer_fold != fold]
        for gene in ("g0", "g3", "g5"):
            x = train[gene]
            filled = x.fillna(x.median())
            row = stats.loc[fold, gene]
            assert row["n"] == x.notna().sum() and row["missing"] == x.isna().sum()
            assert row["median"] == pytest.approx(x.median())
            assert row["variance"] == pytest.approx(x.var(), abs=1e-12)
            assert row["mean_imputed"] == pytest.approx(filled.mean())
            assert row["std_imputed"] == pytest.approx(filled.std(ddof=0), abs=1e-7)


def test_feature_choice_uses_training_rows_only(matrix):
    wide, df = matrix
    chosen = prepare.select_features(prepare.training_stats(df, [1, 2, 3, 4]), 3, 1, 10).toPandas()
    for fold, part in chosen.groupby("outer_fold"):
        variance = wide[wide.outer_fold != fold][[f"g{i}" for i in range(6)]].var()
        want = variance[variance > 1e-12].sort_values(ascending=False).head(3).index.tolist()
        assert part.sort_values("rank")["gene"].tolist() == want and set(part["retained"]) == {5}


def test_prepared_training_rows_are_standardized(matrix):
    _, df = matrix
    stats = prepare.fit_prep(df, [1, 2, 3, 4]).filter("outer_fold = 2").drop("outer_fold")
    train = prepare.apply_prep(df.filter("outer_fold <> 2"), stats, ["gene"]).filter("gene <> 'g5'")
    for r in train.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect():
        assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1)


def test_log_only_when_needed(spark):
    small = spark.createDataFrame([("s", "g", 7.0)], "sample_id string, gene string, value double")
    assert prepare.auto_log2(small).first()["method"] == "pre-normalized input retained"
    assert prepare.auto_log2(small, force=True).first()["value"] == 3.0
    assert prepare.auto_log2(small.withColumn("value", F.lit(1023.0))).first()["value"] == 10.0


def test_top_variance_keeps_at_least_one(matrix):
    wide, df = matrix
    best = wide[[f"g{i}" for i in range(6)]].var().idxmax()
    assert {r[0] for r in prepare.top_variance(df, 0.1).select("gene").distinct().collect()} == {best}
    with pytest.raises(ValueError):
        prepare.top_variance(df, 0)


def test_outliers(spark):
    rows = [(f"s{i}", f"g{j}", 100.0 if i == 0 and j == 0 else float((i * 7 + j) % 5)) for i in range(30) for j in range(4)]
    df = spark.createDataFrame(rows, "sample_id string, gene string, value double")
    flagged = [r["sample_id"] for r in prepare.outlier_scores(df, 3.0).filter("is_outlier").collect()]
    assert flagged == ["s0"]
    assert prepare.drop_outliers(df, 3.0).select("sample_id").distinct().count() == 29
    with pytest.raises(ValueError):
        prepare.drop_outliers(df, 0.0)


def test_metadata_fills(spark):
    df = spark.createDataFrame(
        [(1.0, "b", None), (None, "a", None), (3.0, "a", None), (4.0, "b", None), (None, None, None)],
        "n double, c string, e string",
    )
    filled, log = prepare.impute_metadata(df, ["n", "c", "e"])
    rows = log.collect()
    assert {(r["column"], r["strategy"], r["filled_values"]) for r in rows} == {
        ("n", "median", 2), ("c", "mode:a", 1), ("e", "mode:Unknown", 5),
    }
    assert filled.filter("n = 3.0").count() == 3 and filled.filter("e = 'Unknown'").count() == 5


def test_split(spark):
    df = spark.createDataFrame([(f"s{i}", i % 3 == 0) for i in range(100)], "sample_id string, y boolean")
    df = df.withColumn("y", F.col("y").cast("int"))
    got = prepare.stratified_split(df, "y", 0.25, 1)
    counts = {(r["y"], r["split"]): r["count"] for r in got.groupBy("y", "split").count().collect()}
    assert counts == {(1, "test"): 9, (1, "train"): 25, (0, "test"): 17, (0, "train"): 49}
    rare = df.withColumn("y", F.when(F.col("sample_id") == "s1", 1).otherwise(0))
    assert prepare.stratified_split(rare, "y", 0.25, 1).filter("split = 'test'").count() == 25


def test_profiles(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x")], "a int, b double, c string")
    rows = profile.missing_profile(df).collect()
    assert [r["column"] for r in rows] == ["b", "a", "c"] and rows[0]["missing_fraction"] == 1.0
    assert profile.detect_label(df, ["b", "c"]) == "a"
    with pytest.raises(ValueError):
        profile.detect_label(df.select("b", "c"))
