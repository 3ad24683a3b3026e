from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortwright.functions.hashing import stable_hash
from cohortwright.operators import cohort, distributed, folds


@pytest.fixture(scope="module")
def groups(spark):
    """One patient holds a third of all rows."""
    rows = [(f"s{i}", "p0" if i < 100 else f"p{i // 2}", 0 if i < 100 else (i // 2) % 2) for i in range(300)]
    return spark.createDataFrame(rows, "sample_id string, patient_id string, disease_label int").repartition(6)


def test_folds_keep_groups_together_and_spread_classes(groups):
    placed = folds.grouped_folds(groups, k=5, seed=3).cache()
    assert placed.count() == 300
    folds.assert_no_leakage(placed)
    counts = placed.select("patient_id", "disease_label", "outer_fold").distinct().groupBy("disease_label", "outer_fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["disease_label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_folds_do_not_depend_on_row_order(groups):
    a = folds.grouped_folds(groups).select("sample_id", "outer_fold").collect()
    b = folds.grouped_folds(groups.orderBy(F.desc("sample_id")).coalesce(1)).select("sample_id", "outer_fold").collect()
    assert sorted(a) == sorted(b)


def test_fold_errors(spark, groups):
    with pytest.raises(ValueError, match="more than one label"):
        folds.grouped_folds(spark.createDataFrame([("a", "p", 0), ("b", "p", 1)], groups.schema), k=2)
    with pytest.raises(ValueError, match="Cannot deal"):
        folds.grouped_folds(groups.filter("patient_id = 'p0'"), k=2)
    placed = groups.withColumn("outer_fold", F.pmod(F.hash("sample_id"), F.lit(3)) + 1)
    with pytest.raises(ValueError, match="more than one fold"):
        folds.assert_no_leakage(placed)
    with pytest.raises(ValueError, match="no fold"):
        folds.assert_no_leakage(placed.withColumn("outer_fold", F.lit(None).cast("int")))
    with pytest.raises(ValueError, match="two folds"):
        folds.assert_no_leakage(placed.withColumn("outer_fold", F.lit(1)))
    with pytest.raises(ValueError, match="0 or 1"):
        folds.assert_no_leakage(placed.withColumn("disease_label", F.lit(2)))
    with pytest.raises(ValueError, match="empty"):
        folds.expand_folds(placed, [1, 2, 9])


def test_inner_folds(groups):
    placed = folds.grouped_folds(groups, k=4)
    inner = folds.inner_folds(placed, [1, 2, 3, 4], k=3).cache()
    own = placed.select("patient_id", "outer_fold").distinct()
    assert inner.join(own, "patient_id").filter("held_out = outer_fold").count() == 0
    assert inner.groupBy("held_out").agg(F.count_distinct("inner_fold").alias("n")).filter("n <> 3").count() == 0
    few = placed.filter("disease_label = 1 OR patient_id = 'p0'")
    with pytest.raises(ValueError, match="two groups"):
        folds.inner_folds(few, [1, 2, 3, 4])


def test_representatives(spark):
    rows = [
        ("s1", "p", "tumor", 0.5, "s1"), ("s2", "p", "tumor", 0.9, None), ("s3", "p", "tumor", 0.9, "s3"),
        ("s0", "p", "tumor", None, "s0"), ("s4", "p", "normal", 0.1, "s4"), ("s5", "q", "tumor", 0.2, "s5"),
    ]
    df = spark.createDataFrame(rows, "sample_id string, patient_id string, disease_label_name string, metadata_completeness_score double, original_id string")
    kept, rest = cohort.pick_representative(df)
    assert {r["sample_id"] for r in kept.collect()} == {"s3", "s4", "s5"}
    assert {r["exclusion_reason"] for r in rest.collect()} == {"duplicate_tumor_sample_within_patient"}
    assert kept.count() + rest.count() == df.count()
    assert tuple(cohort.duplicate_patients(df).first()) == (1, 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 5, 10]], "v double")
    rows = cohort.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [3, 0, 1, 0, 1] and rows[-1]["bin_end"] == 10.0
    flat = cohort.histogram(df.filter("v = 5"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 0, 1, 0] and flat[0]["bin_start"] == 4.5


def test_capped_sample(groups):
    got = cohort.capped_sample(groups, "disease_label", 7, 1)
    assert {r["count"] for r in got.groupBy("disease_label").count().collect()} == {7}
    assert sorted(got.collect()) == sorted(cohort.capped_sample(groups.coalesce(1), "disease_label", 7, 1).collect())


@pytest.mark.parametrize("most", [100_000, 40, 1])
def test_first_by_hash_of_any_class_size(spark, most):
    """Classes below, at and far above the cap, repeated keys, a missing class, and cut prefixes too crowded to order."""
    rows = [(None if i % 50 == 0 else ["big", "big", "big", "mid"][i % 4], f"k{i}") for i in range(3000)] + [("tiny", "k"), ("tiny", "l")]
    rows += [("same", "key")] * 30
    df = spark.createDataFrame(rows, "c string, id string").repartition(5).withColumn("h", stable_hash(3, "id"))
    df = df.withColumn("n", F.monotonically_increasing_id())
    for k in (1, 2, 25, 700):
        got = distributed.bottom_by_hash(df, ["c"], "h", ["id", "n"], k, most).collect()
        want = defaultdict(list)
        for r in df.collect():
            want[r.c].append((r.h, r.id, r.n))
        want = {(c, *x) for c, v in want.items() for x in sorted(v)[:k]}
        assert len(got) == len(want) and {(r.c, r.h, r.id, r.n) for r in got} == want


def test_representatives_of_shared_sample_ids(spark):
    """Aliquots share a sample id; still one row is chosen per patient and class, and the same one each time."""
    rows = [("p1", "tumor", "s1", "s1-01", 0.5), ("p1", "tumor", "s1", "s1-02", 0.5), ("p1", "tumor", "s2", "s2-01", 0.2), ("p1", "normal", "s3", "s3-01", 0.1), ("p2", "tumor", "s4", None, None), ("p2", "tumor", "s4", None, None)]
    df = spark.createDataFrame(rows, "patient_id string, disease_label_name string, sample_id string, original_id string, metadata_completeness_score double")
    found = [cohort.pick_representative(df.repartition(n)) for n in (1, 4)]
    for kept, rest in found:
        assert sorted((r.patient_id, r.disease_label_name, r.sample_id) for r in kept.collect()) == [("p1", "normal", "s3"), ("p1", "tumor", "s1"), ("p2", "tumor", "s4")]
        assert rest.count() == 3
    assert sorted(map(str, found[0][0].collect())) == sorted(map(str, found[1][0].collect()))


def test_summary_counts_every_given_field(spark):
    rows = spark.createDataFrame(
        [("s1", "p1", 1, "tumor", "male", None), ("s2", "p2", 0, "normal", "female", "late_stage")],
        "sample_id string, patient_id string, disease_label int, disease_label_name string, env_sex string, env_stage string",
    )
    none = rows.limit(0).withColumn("exclusion_reason", F.lit("x"))
    row = cohort.cohort_summary(rows, none, {"all": rows}, rows.withColumn("outer_fold", F.lit(1)), rows, rows, ("env_sex", "env_stage")).first()
    assert row["available_confounder_counts"] == {"env_sex": 2, "env_stage": 1}


def test_cohort_query_keeps_its_stages_and_levels(spark):
    from __spark_entry__ import queries

    row = queries()["k10_cohort_summary"](spark, "/root/testdata/sf0.001").first()
    assert row["fields"].startswith("env_stage=") and ",sex_raw=" in row["fields"]
    assert 0 < row["male"] < row["tumor_count"] + row["normal_count"] and row["stage_missing"] > 0
