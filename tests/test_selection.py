"""Order statistics by histogram selection against numpy, with groups above and below the sorting limit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwright.operators import prepare
from cohortwright.operators import selection as s

PROBS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, values repeat or span many magnitudes, one key is missing."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(
        {
            "g": ["hot"] * 4000 + ["wide"] * 500 + ["cold"] * 30 + [None] * 20 + ["one", "void"],
            "v": np.concatenate([
                np.full(1500, 0.5), rng.integers(0, 700, 2500) / 100, 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500),
                rng.normal(size=50), [2.0, np.nan],
            ]),
        }
    )
    frame["fold"] = rng.integers(0, 4, len(frame))
    frame = frame.astype({"g": object})
    df = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).repartition(7)
    return frame, df


def near(got, want):
    return got == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("small,width", [(s.SMALL, s.WIDTH), (40, 64)])
def test_quantiles_match_numpy(skewed, small, width):
    frame, df = skewed
    out = s.order_statistics(df, ["g"], "v", {n: s.Quantile(q) for n, q in PROBS.items()}, small=small, width=width)
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == {"hot", "wide", "cold", "one", None}  # a group without values has no row
    for key, part in frame.dropna(subset="v").groupby("g", dropna=False):
        for name, q in PROBS.items():
            assert near(got[None if key != key else key][name], np.quantile(part["v"], q))


@pytest.mark.parametrize("small,width", [(40, 64)])
def test_ranks_among_all_but_one_fold(skewed, small, width):
    frame, df = skewed
    counts = {"n": F.lit(1)} | {f"n_{f}": F.when(F.col("fold") == f, 1).otherwise(0) for f in range(4)}
    wanted = {f"t{f}": s.Quantile(0.5, "n", f"n_{f}") for f in range(4)} | {"own": s.Quantile(0.25, "n_2")}
    got = {r["g"]: r for r in s.order_statistics(df, ["g"], "v", wanted, counts, small, width).collect()}
    for key, part in frame.dropna(subset="v").groupby("g", dropna=False):
        row = got[None if key != key else key]
        for f in range(4):
            rest = part["v"][part["fold"] != f]
            assert (row[f"t{f}"] is None) if rest.empty else near(row[f"t{f}"], rest.median())
        mine = part["v"][part["fold"] == 2]
        assert (row["own"] is None) if mine.empty else near(row["own"], np.quantile(mine, 0.25))


def test_infinite_and_nan_values(spark):
    values = [float("-inf")] * 3 + [0.0, 5e-324, 1.0, 1.7e308, -1.7e308] + [float("inf")] * 3 + [float("nan")] * 2
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ranked = sorted(values[:-2]) + values[-2:]
    wanted = {f"x{i}": s.Quantile(F.lit(i) / F.lit(float(len(ranked) - 1))) for i in range(len(ranked))}
    for small in (1, s.SMALL):
        got = s.order_statistics(df, [], "v", wanted, small=small, width=32).first()
        for i, want in enumerate(ranked):
            assert got[f"x{i}"] == want or (want != want and got[f"x{i}"] != got[f"x{i}"])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert s.exact_quantiles(empty, ["g"], "v", {"m": 0.5}).collect() == []
    assert s.exact_quantiles(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], "v", {"m": 0.5}).collect() == []


def test_input_is_not_stored(skewed, monkeypatch):
    """Only counts are written: no stored table has as many rows as the input."""
    frame, df = skewed
    rows = []
    stored = s.materialize
    monkeypatch.setattr(s, "materialize", lambda d, *a: (rows.append(d.count()), stored(d, *a))[1])
    s.order_statistics(df, ["g"], "v", {"m": s.Quantile(0.5)}, small=50, width=64).collect()
    assert rows and max(rows) < 20 < len(frame)


def test_training_medians_of_a_hot_gene(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"gene": ["hot"] * 900 + ["g"] * 100, "outer_fold": rng.integers(0, 5, 1000), "value": rng.normal(size=1000).round(2)})
    long = spark.createDataFrame(frame)
    monkeypatch.setattr(s.order_statistics, "__defaults__", (None, 16, 32))
    for r in prepare.training_medians(long, range(5)).collect():
        want = frame[(frame.gene == r.gene) & (frame.outer_fold != r.outer_fold)].value.median()
        assert near(r["median"], want)


def test_tasks_grow_with_rows(skewed, monkeypatch):
    """Many small groups: tasks hold so many rows at most, and no aggregate sorts."""
    frame, df = skewed
    monkeypatch.setattr(s, "ROWS_PER_TASK", 50)
    out = s.exact_quantiles(df, ["g"], "v", {"m": 0.5})
    assert {r["g"]: r["m"] for r in out.collect()}["hot"] == pytest.approx(frame[frame.g == "hot"].v.median())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan


def test_no_keys_join_without_loops(skewed):
    """All rows as one group: joins stay hash joins."""
    frame, df = skewed
    out = s.exact_quantiles(df, [], "v", {"m": 0.5})
    assert near(out.first()["m"], frame.v.median())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
