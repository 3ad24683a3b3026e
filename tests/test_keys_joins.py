import pytest
from pyspark.sql import functions as F

from cohortwright.operators import joins, keys, metadata


def test_detect_key(spark):
    a = spark.createDataFrame([("T1", 1)], "`Unnamed: 0` string, x int")
    b = spark.createDataFrame([("T1", 2)], "`Unnamed: 0` string, y int")
    counter = spark.createDataFrame([(1, 2), (2, 3)], "`Unnamed: 0` int, y int")
    assert keys.detect_key([a, b]) == "Unnamed: 0"
    with pytest.raises(KeyError):
        keys.detect_key([a, counter.withColumnRenamed("Unnamed: 0", "Unnamed: 1")])
    with pytest.raises(KeyError):
        keys.detect_key([counter, counter.drop("y")])
    assert keys.detect_key([a.withColumn("sample_id", F.lit(1)).withColumn("barcode", F.lit(1))] * 2) == "barcode"
    with pytest.raises(KeyError):
        keys.detect_key([a, b], "nope")


def test_name_unnamed_key(spark):
    df = spark.createDataFrame([(0, "AB-1"), (1, "AB-2")], "`Unnamed: 0` int, `Unnamed: 3` string")
    assert keys.name_unnamed_key(df).columns == ["Unnamed: 0", "barcode"]
    assert keys.name_unnamed_key(df.withColumn("barcode", F.lit("x"))).columns[:2] == df.columns


def test_dedupe_keeps_first_by_order(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "first"), ("b", 5, "only")], "k string, o int, v string")
    assert sorted(keys.dedupe_first(df, "k", ["o"]).collect()) == [("a", 1, "first"), ("b", 5, "only")]
    with pytest.raises(ValueError, match="repeats"):
        keys.assert_unique(df, "k")


def test_tier_order_and_missing_keys(spark):
    cols = "id string"
    left = keys.add_keys(spark.createDataFrame([("TCGA-A-1-01A-x",), ("TCGA-A-2-01A-y",), (None,)], cols), "id").drop("id")
    right = keys.add_keys(spark.createDataFrame([("TCGA-A-1-01A-z",), ("TCGA-A-3-01A",), (None,)], cols), "id")
    row = joins.tiered_join(left, right.drop("id").withColumn("extra", F.lit(1))).collect()
    assert len(row) == 1 and row[0]["merge_strategy"] == "sample barcode match" and row[0]["match_count"] == 1
    with pytest.raises(ValueError, match="No tier"):
        joins.tiered_join(left, right.filter("id LIKE '%-3-%'"), joins.tiers_for("barcode"))
    twice = right.unionByName(right)
    with pytest.raises(ValueError, match="repeats"):
        joins.tiered_join(left, twice)
    a, b = joins.unmatched(left, right, "harmonized_sample_id")
    assert a.count() == 2 and b.count() == 2


def test_shared_keys_and_alignment(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "sample_id string")
    b = spark.createDataFrame([("y",), ("y",), (None,)], "sample_id string")
    assert [r[0] for r in joins.shared_keys(a, b).collect()] == ["y"]
    with pytest.raises(ValueError):
        joins.shared_keys(a, b.filter("sample_id = 'z'"), require=True)
    long = spark.createDataFrame([("y", "g", 1.0, 2), ("y", "g", None, 1)], "sample_id string, gene string, value double, o int")
    assert joins.align_matrix(long, b.dropna(), order="o").first()["value"] is None
    with pytest.raises(ValueError, match="x"):
        joins.align_matrix(long, a.filter("sample_id IS NOT NULL"))


def test_primary_rows_rejects_a_missing_patient(spark):
    df = spark.createDataFrame([("p", True), (None, False)], "patient_id string, primary_supported_sample boolean")
    with pytest.raises(ValueError):
        joins.primary_rows(df)


def test_canonical_names_include_dotted_synonyms(spark):
    df = spark.createDataFrame([("F", "SCC", "d")], "`Gender.Demographic` string, `histologic_diagnosis.1` string, `Definition` string")
    out = metadata.canonicalize_metadata(df)
    assert {"sex_raw", "histology_raw", "sample_type_metadata"} <= set(out.columns)


def test_codes(spark):
    train = spark.createDataFrame([("b",), (" a ",), ("Unknown",), (None,)], "c string")
    codes = metadata.fit_codes(train, "c")
    test = spark.createDataFrame([("a",), ("z",), (None,), ("b",)], "c string")
    got = {r["c"]: r["c_code"] for r in metadata.apply_codes(test, codes, "c").collect()}
    assert got == {"a": 0, "z": -1, None: -1, "b": 1}


def test_sparse_levels(spark):
    """A hundred thousand levels: a table of slots and one sparse column, whatever the number of levels."""
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).cast("string").alias("b"), F.lit(1.5).alias("n"))
    slots = metadata.level_slots(df, ["a", "b"]).cache()
    assert slots.count() == 100_005 and {r.slot for r in slots.filter("column = 'b'").collect()} == set(range(100_000, 100_005))
    out = metadata.sparse_one_hot(df, slots, ["a", "b"], "id")
    assert out.columns == ["id", "n", "levels"]
    assert out.filter(F.size("levels") != F.when(F.col("id") % 3 > 0, 2).otherwise(1)).count() == 0
    names = {r.slot: r.level for r in slots.filter("slot >= 100000 OR level = 'v77'").collect()}
    assert [names[s] for s in out.filter("id = 77").first()["levels"]] == ["v77", "2"]
    unseen = spark.createDataFrame([(1, "new", None)], "id bigint, a string, b string")
    assert metadata.sparse_one_hot(unseen, slots, ["a", "b"], "id").first()["levels"] == []


def test_tier_facts(spark):
    left = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", None)], "k1 string, k2 string")
    right = spark.createDataFrame([("c", "x"), ("c", "z"), ("c", "z")], "k1 string, k2 string")
    got = {r.tier: (r.matches, r.most_left, r.most_right) for r in joins.tier_facts(left, right, [("one", "k1"), ("two", "k2")]).collect()}
    assert got == {0: (0, 2, 3), 1: (2, 1, 2)}
    joined = joins.tiered_join(left, right, [("one", "k1"), ("two", "k2")], one_to_one=False)
    assert joined.count() == 3 and joined.first()["match_count"] == 2


def test_one_hot_passes_numbers_and_zeroes_missing(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, None, None)], "id int, c string, n double")
    rows = {r["id"]: r for r in metadata.one_hot(df, ["c", "n"], {"c": ["x", "y"]}).collect()}
    assert (rows[1]["c_x"], rows[1]["c_y"], rows[1]["n"]) == (1, 0, 2.0) and rows[2]["c_x"] == 0
