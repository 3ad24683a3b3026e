import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwright.functions.hashing import stable_hash
from cohortwright.operators import distributed as d


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one group key is missing, values repeat."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(
        {
            "g": ["hot"] * 3000 + ["cold"] * 30 + [None] * 20 + ["one"],
            "v": np.concatenate([np.full(1000, 0.5), rng.integers(0, 700, 2050) / 100, [2.0]]),
        }
    )
    frame["id"] = range(len(frame))
    return frame, spark.createDataFrame(frame.astype({"g": object})).repartition(7)


def test_running_totals_match_a_plain_cumulative_sum(skewed):
    frame, df = skewed
    got = d.running_totals(df, ["g"], ["v", "id"], {"n": F.lit(1), "s": F.col("id")}, totals=True).toPandas()
    want = frame.sort_values(["v", "id"]).assign(one=1)
    grouped = want.groupby("g", dropna=False)
    want = want.assign(n=grouped["one"].cumsum(), s=grouped["id"].cumsum(), n_total=grouped["one"].transform("sum"))
    both = got.merge(want, on="id", suffixes=("", "_want"))
    assert len(both) == len(frame)
    for c in ("n", "s", "n_total"):
        assert (both[c] == both[f"{c}_want"]).all()


def test_row_numbers_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    a = d.number_rows(df, ["g"], [F.desc("v"), "id"]).select("id", "row_number").collect()
    b = d.number_rows(df.repartition(2).orderBy(F.desc("id")), ["g"], [F.desc("v"), "id"]).select("id", "row_number").collect()
    assert sorted(a) == sorted(b)


def test_hash_numbering(skewed):
    frame, df = skewed
    rows = d.number_by_hash(df.withColumn("h", stable_hash(7, "id")), ["g"], "h", ["id"], total=True).toPandas()
    for _, part in rows.groupby("g", dropna=False):
        part = part.sort_values(["h", "id"])
        assert part["row_number"].tolist() == list(range(1, len(part) + 1))
        assert set(part["row_number_total"]) == {len(part)}


@pytest.mark.parametrize("limit", [None, 0])
def test_lookup_join_gives_the_same_rows_with_and_without_broadcast(skewed, limit):
    frame, df = skewed
    table = df.groupBy("g").agg(F.max("v").alias("top"))
    joined = d.lookup_join(df, table, "g", limit=limit)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) or limit == 0
    rows = joined.toPandas().set_index("id")["top"]
    want = frame.set_index("id")
    top = want.groupby("g")["v"].transform("max")
    assert (rows.loc[top.dropna().index] == top.dropna()).all()


def test_size_check(spark):
    """Texts and arrays count as long as they are, so few long rows aren't taken for a small table."""
    short = spark.range(1000).select("id", F.lit("x").alias("t"))
    long = spark.range(1000).select("id", F.repeat(F.lit("x"), 50_000).alias("t"), F.array(F.lit(1.5), F.lit(2.5)).alias("a"))
    assert d.stored_size(short) == 1000 * (16 + 8 + 16 + 1)
    assert d.is_small(short) and not d.is_small(long) and d.stored_size(long) > 50_000_000
    assert d.stored_size(spark.createDataFrame([], "a string")) == 0


def test_discard(spark):
    import os

    stored = d.materialize(spark.range(5))
    assert os.path.isdir(stored._stored_at) and stored.count() == 5
    d.discard(stored, None, spark.range(1))
    assert not os.path.isdir(stored._stored_at)


def test_a_hot_key_above_the_broadcast_limit_is_split(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(400_000, numPartitions=8).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("g"), F.rand(1).alias("x")
        )
        table = rows.groupBy("g").agg(F.count("*").alias("n"))
        joined = d.lookup_join(rows, table, "g", limit=0)
        assert joined.agg(F.sum((F.col("g") == "hot").cast("int"))).first()[0] == 133_334
        joined.write.format("noop").mode("overwrite").save()
        rows_out = joined.collect()
        assert len(rows_out) == 400_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_group_spans_many_ranges(spark, monkeypatch):
    """Running totals of one group are computed in several partitions once it is large enough."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = []
    real = d.materialize
    monkeypatch.setattr(d, "materialize", lambda df: stored.append(real(df)) or stored[-1])
    try:
        rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"))
        got = d.number_rows(rows, ["g"], ["id"])
        top = {r["g"]: r["m"] for r in got.groupBy("g").agg(F.max("row_number").alias("m")).collect()}
        assert top == {"hot": 13_333, "cold": 6_667}
        sizes = [r["count"] for r in stored[0].groupBy("_group", "_part").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 5_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
