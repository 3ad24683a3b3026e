import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwright.plans import write_outputs
from cohortwright.plans.cohort import COHORT_SCHEMA, build_cohort
from cohortwright.plans.evaluate import evaluate_baselines, evaluate_sparse
from cohortwright.plans.evidence import rank_evidence
from cohortwright.plans.files import build_cohort_files, preprocess_files
from cohortwright.plans.preprocess import preprocess


@pytest.fixture(scope="module")
def study(spark):
    """Sixty patients with one sample each (one has two), eight genes, two of which carry the label."""
    rng = np.random.default_rng(11)
    barcodes = [f"TCGA-{i % 7:02d}-{i:04d}-{'01A' if i % 2 else '11A'}" for i in range(60)] + ["TCGA-01-0001-01B"]
    values, clinical = [], []
    for i, b in enumerate(barcodes):
        tumor = b.split("-")[3].startswith("01")
        for g in range(8):
            shift = 2.0 if g < 2 and tumor else 0.0
            values.append((b.replace("-", "."), f"g{g}", float(abs(5 + shift + rng.normal()))))
        clinical.append((b, "Male" if i % 3 else "female", f"Stage {'I' * (i % 4 + 1)}" if i % 5 else None, "Country A" if i % 2 else "Country B", 40.0 + i, None if i % 4 else "yes"))
    long = spark.createDataFrame(values, "sample_id string, gene string, value double").repartition(4)
    extra = [("TCGA-99-9999-01A", "Male", None, None, None, None), ("TCGA-01-0003-06A", "Male", None, None, None, None)]
    metadata = spark.createDataFrame(clinical + extra, "barcode string, gender string, tumor_stage string, country string, age double, smoking_status string")
    unsupported = spark.createDataFrame([("TCGA-01-0003-06A", f"g{g}", 1.0) for g in range(8)], long.schema)
    return long.unionByName(unsupported), metadata


@pytest.fixture(scope="module")
def cohort(study):
    long, metadata = study
    return {k: v.cache() for k, v in build_cohort(long, long, metadata, k=3).items()}


def test_cohort_tables(cohort):
    assert cohort["cohort"].schema.names == COHORT_SCHEMA.names and len(COHORT_SCHEMA) == 31
    assert cohort["cohort"].count() == 60
    reasons = {r["exclusion_reason"]: r["n"] for r in cohort["exclusions"].groupBy("exclusion_reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {
        "unmatched_across_input_tables": 1, "unsupported_sample_type_for_primary_cohort": 1,
        "duplicate_tumor_sample_within_patient": 1,
    }
    everything = cohort["all_samples"]
    assert everything.count() == 62 and everything.filter("representative_selected").count() == 60
    assert cohort["normalized"].count() == 60 * 8
    row = cohort["summary"].first()
    assert (row["tumor_count"], row["normal_count"], row["unique_patient_count"], row["duplicate_patient_count"]) == (30, 30, 60, 1)
    assert row["matched_sample_counts"]["matched_across_all_inputs"] == 62
    assert set(row["fold_distribution"]) == {"1", "2", "3"}


def test_paired_patient(study):
    long, metadata = study
    both = [("TCGA-01-0001-11A", f"g{g}", 1.0) for g in range(8)]
    spark = long.sparkSession
    longer = long.unionByName(spark.createDataFrame(both, long.schema))
    more = metadata.unionByName(spark.createDataFrame([("TCGA-01-0001-11A", "Male", None, None, None, None)], metadata.schema))
    with pytest.raises(ValueError, match="more than one label"):
        build_cohort(longer, longer, more, k=3)
    kept = build_cohort(longer, longer, more, k=3, keep="tumor")
    assert kept["cohort"].filter("patient_id = 'TCGA-01-0001'").first()["disease_label"] == 1
    assert kept["exclusions"].filter("exclusion_reason = 'other_class_of_paired_patient'").count() == 1


def test_preprocess(study, tmp_path):
    long, metadata = study
    out = preprocess(long, long, metadata, label="gender", top_percent=50, outlier_z=6.0, missing_threshold=0.9)
    summary = {r["metric"]: r["value"] for r in out["summary"].collect()}
    assert summary["merge_strategy"] == "exact barcode match" and summary["label_column"] == "gender"
    assert int(summary["train_rows"]) + int(summary["test_rows"]) == int(summary["merged_rows"]) == 62
    assert summary["gene_feature_count"] == "4" and out["matrix"].select("gene").distinct().count() == 4
    assert out["unmatched_metadata"].count() == 1
    small = {k: out[k] for k in ("summary", "imputation_log", "outlier_summary")}
    write_outputs(small, str(tmp_path / "out"), "csv")
    assert (tmp_path / "out" / "summary").exists()


@pytest.fixture(scope="module")
def raw(study, tmp_path_factory):
    """The study as files: genes by sample, a repeated row, a repeated clinical column, an unnamed index column."""
    where = tmp_path_factory.mktemp("raw")
    long, metadata = study
    wide = long.toPandas().pivot(index="gene", columns="sample_id", values="value")
    again = wide.loc[["g0"]] + 100
    wide = wide.reset_index()
    text = wide.to_csv(index=False) + again.reset_index().to_csv(index=False, header=False)
    (where / "matrix.csv").write_text(text)
    table = metadata.toPandas()
    table.insert(0, "Unnamed: 0", table.pop("barcode"))
    lines = table.assign(gender=table.gender.where(table.index % 2 == 0), other=table.gender).to_csv(index=False).splitlines()
    lines[0] = lines[0].replace("other", "gender")
    (where / "clinical.csv").write_text("\n".join([*lines, lines[1].replace("40.0", "99.0")]) + "\n")
    return str(where / "matrix.csv"), str(where / "clinical.csv")


def test_cohort_from_raw_files(spark, raw, cohort):
    matrix, clinical = raw
    out = build_cohort_files(spark, matrix, matrix, clinical, k=3)
    columns = ["sample_id", "patient_id", "disease_label", "env_sex", "env_stage", "age_at_diagnosis", "outer_fold"]
    assert sorted(map(tuple, out["cohort"].select(columns).collect()), key=str) == sorted(map(tuple, cohort["cohort"].select(columns).collect()), key=str)
    values = lambda t: {(r.sample_id, r.gene): r.value for r in t.collect()}
    assert values(out["normalized"]) == pytest.approx(values(cohort["normalized"]))
    assert [tuple(r) for r in out["merged_columns"].collect()] == [("gender", 1, 0)]


def test_preprocess_from_raw_files(spark, raw, study):
    matrix, clinical = raw
    options = {"label": "gender", "top_percent": 50, "outlier_z": 6.0, "missing_threshold": 0.9}
    got, want = preprocess_files(spark, matrix, matrix, clinical, **options), preprocess(study[0], study[0], study[1], **options)
    facts = [{r["metric"]: r["value"] for r in t["summary"].collect()} for t in (got, want)]
    assert facts[0] == facts[1]
    assert got["metadata_levels"].count() == want["metadata_levels"].count() > 4


def test_evaluation_and_ranking(spark, cohort):
    grid = {"LR_L1": [{"C": 1.0, "class_weight": None}]}
    search = {"inner_k": 2, "top": 8, "least": 2, "most": 8}
    args = (cohort["cohort"], cohort["folds"], cohort["normalized"])
    base = evaluate_baselines(*args, {"LR_ElasticNet": [{"C": 0.5, "l1_ratio": 0.5, "class_weight": None}]}, seeds=[1], **search)
    assert base["predictions"].count() == 60
    folds = base["fold_metrics"].collect()
    assert len(folds) == 3 and all(r["n_train_samples"] + r["n_test_samples"] == 60 for r in folds)
    assert base["best_confusion"].selectExpr("tn + fp + fn + tp AS n").first()["n"] == 60
    assert base["summary"].first()["pooled_auroc"] > 0.8
    assert base["winners"].first()["best_baseline"] == "LR_ElasticNet"
    assert base["subgroups"].filter("status = 'ok'").count() > 0
    sparse = evaluate_sparse(*args, base["summary"], grid["LR_L1"], seeds=[1, 2], dims=["env_sex", "env_country_or_region", "nope"], **search)
    assert sparse["gate_weights"].count() == 2 * 3 * 8
    assert sparse["latent"].count() == 60
    assert {r["selected_variable_genes"] for r in sparse["fold_metrics"].collect()} == {8}
    assert {r["model_family"] for r in sparse["comparison"].collect()} == {"baseline", "candidate"}
    assert {r["reason"] for r in sparse["invariance"].collect()} == {"evaluated", "missing"}
    sets = spark.createDataFrame([("signal", "g0"), ("signal", "g1"), ("rest", "g5"), ("none", "zz")], "pathway string, gene string")
    out = rank_evidence(cohort["cohort"], cohort["normalized"], sparse["gate_weights"], sparse["prep"], sets, n_perturb=4, n_boot=5, min_rows=5)
    ranked = out["ranked"].orderBy("final_rank").collect()
    assert {r["gene"] for r in ranked[:2]} == {"g0", "g1"} and len(ranked) == 8
    assert ranked[0]["bootstrap_ci_lower"] <= ranked[0]["bootstrap_mean"] <= ranked[0]["bootstrap_ci_upper"]
    assert out["perturbation_summary"].count() == 4
    assert {r["pathway"] for r in out["set_summary"].collect()} == {"signal", "rest"}
