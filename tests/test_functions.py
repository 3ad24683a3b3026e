import pytest
from pyspark.sql import functions as F

from cohortwright.functions.arithmetic import ratio, sigmoid, to_number
from cohortwright.functions.hashing import stable_hash
from cohortwright.functions.identifiers import key_variants, normalize_id, type_code
from cohortwright.functions.recode import (
    clean_unknown,
    recode_contains,
    recode_exact,
    recode_smoking,
    recode_stage,
    slug,
)


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in rows.select("i", column.alias("o")).orderBy("i").collect()]


def test_normalize_id(spark):
    got = values(spark, [" tcga.ab.1 ", "", "NaN", None, "x"], normalize_id("v"))
    assert got == ["TCGA-AB-1", None, None, None, "X"]
    assert values(spark, ["nan"], normalize_id("v", ())) == ["NAN"]


def test_key_levels_and_code(spark):
    ids = ["TCGA-AB-1234-01A-11R", "tcga.ab.1234", "TCGA-AB", "GTEX-1-2-3-4", "TCGA-A-B-X1"]
    keys = key_variants("v")
    assert values(spark, ids, keys["sample"]) == ["TCGA-AB-1234-01A", None, None, None, "TCGA-A-B-X1"]
    assert values(spark, ids, keys["patient"]) == ["TCGA-AB-1234", "TCGA-AB-1234", None, None, "TCGA-A-B"]
    assert values(spark, ids, type_code("v")) == ["01", None, None, None, None]


@pytest.mark.parametrize(
    "text, strict, compat",
    [
        ("Stage I", "early_stage", "early_stage"),
        ("Stage IIB", "early_stage", "early_stage"),
        ("Stage III", "late_stage", "early_stage"),
        ("stage iva", "late_stage", "early_stage"),
        ("4", "late_stage", "late_stage"),
        ("35", "unknown", "late_stage"),
        ("X", "unknown", "unknown"),
        ("Not Reported", "unknown", "unknown"),
        (None, "unknown", "unknown"),
    ],
)
def test_stage(spark, text, strict, compat):
    assert values(spark, [text], recode_stage("v")) == [strict]
    assert values(spark, [text], recode_stage("v", "compat")) == [compat]


def test_smoking_modes(spark):
    texts = ["Lifelong Non-smoker", "Current smoker", "1", "4", "60", "10", "no", "unclear", None, "--"]
    strict = ["non_smoker", "smoker", "non_smoker", "smoker", "smoker", "smoker", "non_smoker", "unknown", "unknown", "unknown"]
    compat = ["non_smoker", "smoker", "smoker", "smoker", "unknown", "smoker", "non_smoker", "unknown", "unknown", "unknown"]
    assert values(spark, texts, recode_smoking("v")) == strict
    assert values(spark, texts, recode_smoking("v", "compat")) == compat


def test_other_recodes(spark):
    assert values(spark, [" x ", " -- ", None, "NULL"], clean_unknown("v")) == ["x", "unknown", "unknown", "unknown"]
    assert values(spark, ["M", "Female", "?"], recode_exact("v")) == ["male", "female", "unknown"]
    assert values(spark, ["Squamous adeno", "Adenoma", "z", ""], recode_contains("v")) == ["escc", "eac", "other", "unknown"]
    assert values(spark, ["North  East " + "x" * 60, None], slug("v", 40)) == [("north_east_" + "x" * 60)[:40], "unknown"]


def test_arithmetic(spark):
    assert values(spark, ["1.5", "bad", "NaN", None], to_number("v")) == [1.5, None, None, None]
    assert values(spark, ["0", "4"], ratio(F.lit(2), F.col("v").cast("int"))) == [None, 0.5]
    low, mid, high = values(spark, ["-800", "0", "800"], sigmoid(F.col("v").cast("double")))
    assert (low, mid, high) == (0.0, 0.5, 1.0)


def test_stable_hash_value(spark):
    assert values(spark, ["abc"], stable_hash(42, "v")) == [1952568800]
