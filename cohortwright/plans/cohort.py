"""Step 2: matched cohort, labels, representatives, grouped folds and aligned matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwright.operators import cohort as c
from cohortwright.operators import folds as f
from cohortwright.operators import joins, keys, metadata
from cohortwright.operators.distributed import materialize
from cohortwright.sources.tables import project_canonical

_TEXT, _DOUBLE, _FLAG, _INT = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()

# Columns of the cohort tables, in order.
COHORT_COLUMNS = [
    ("original_id", _TEXT),
    ("sample_id", _TEXT),
    ("patient_id", _TEXT),
    ("sample_type_code", _TEXT),
    ("sample_type_label", _TEXT),
    ("disease_label", _INT),
    ("disease_label_name", _TEXT),
    ("histology_raw", _TEXT),
    ("histology_clean", _TEXT),
    ("sex_raw", _TEXT),
    ("env_sex", _TEXT),
    ("smoking_raw", _TEXT),
    ("env_smoking", _TEXT),
    ("stage_raw", _TEXT),
    ("env_stage", _TEXT),
    ("country_raw", _TEXT),
    ("env_country_or_region", _TEXT),
    ("race_raw", _TEXT),
    ("age_at_diagnosis", _DOUBLE),
    ("pack_years_raw", _DOUBLE),
    ("alcohol_history_raw", _TEXT),
    ("survival_status_raw", _TEXT),
    ("days_to_death", _DOUBLE),
    ("days_to_last_follow_up", _DOUBLE),
    ("metadata_completeness_score", _DOUBLE),
    ("confounder_missing_fraction", _DOUBLE),
    ("confounder_missing_excess", _FLAG),
    ("sample_type_conflict", _FLAG),
    ("representative_selected", _FLAG),
    ("exclusion_reason", _TEXT),
    ("outer_fold", _INT),
]
COHORT_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in COHORT_COLUMNS])


def build_cohort(
    counts: DataFrame,
    normalized: DataFrame,
    clinical: DataFrame,
    id_col: str = "barcode",
    k: int = 5,
    seed: int = 42,
    tumor: str = metadata.TUMOR_CODE,
    normal: str = metadata.NORMAL_CODE,
    max_missing: float = 0.5,
    mode: str = "strict",
    keep: str | None = None,
) -> dict[str, DataFrame]:
    """Curated cohort with folds from two long matrices and a clinical table.

    A patient with samples of both classes is an error, unless ``keep`` names the class
    (``tumor`` or ``normal``) whose sample such a patient retains.
    """

    def sample_keys(df: DataFrame, column: str) -> DataFrame:
        keyed = keys.add_keys(df.select(column).distinct(), column)
        return keyed.select(column, keys.effective_key().alias("_sample")).filter(F.col("_sample").isNotNull())

    def rekeyed(long: DataFrame) -> DataFrame:
        return long.join(sample_keys(long, "sample_id"), "sample_id").select(
            F.col("_sample").alias("sample_id"), "gene", "value", F.col("sample_id").alias("source_id")
        )

    table = keys.add_keys(metadata.canonicalize_metadata(clinical), metadata.snake_case(id_col))
    table = table.withColumn("_sample", keys.effective_key())
    matched = materialize(
        joins.shared_keys(
            sample_keys(counts, "sample_id"), sample_keys(normalized, "sample_id"), table, key="_sample", require=True
        )
    )
    master = joins.restrict(table, matched, "_sample")
    master = metadata.binary_label(metadata.infer_type(master, tumor=tumor, normal=normal), tumor, normal)
    master = materialize(metadata.confounder_table(master, max_missing, mode))
    candidates = joins.primary_rows(master)
    kept, duplicates = c.pick_representative(candidates)
    logs = [
        (table.join(matched, "_sample", "left_anti"), "unmatched_across_input_tables"),
        (master.filter(~F.col("primary_supported_sample")), "unsupported_sample_type_for_primary_cohort"),
        (duplicates, None),
    ]
    if keep:
        both = f.impure_groups(kept).select("patient_id")
        paired = kept.join(both, "patient_id", "left_semi").filter(F.col("disease_label_name") != keep)
        logs.append((paired, "other_class_of_paired_patient"))
        kept = kept.join(paired.select("sample_id"), "sample_id", "left_anti")
    kept = materialize(kept)
    if kept.isEmpty():
        raise ValueError("The cohort is empty after applying the inclusion rules")
    placed = materialize(f.grouped_folds(kept.select("sample_id", "patient_id", "disease_label"), k=k, seed=seed))
    excluded = joins.union_logs(logs)
    cohort = joins.enrich(kept, placed.select("sample_id", "outer_fold"), "sample_id")
    flags = cohort.select("sample_id", "representative_selected", "outer_fold").unionByName(
        duplicates.select("sample_id", "representative_selected", F.lit(None).cast("int").alias("outer_fold"))
    )
    everything = joins.enrich(master, flags, "sample_id").fillna(False, ["representative_selected"])
    samples = cohort.select("sample_id")
    summary = c.cohort_summary(
        cohort, excluded,
        {
            "matched_across_all_inputs": matched,
            "matched_normalized_samples": joins.restrict(sample_keys(normalized, "sample_id"), matched, "_sample"),
            "matched_count_samples": joins.restrict(sample_keys(counts, "sample_id"), matched, "_sample"),
            "matched_metadata_samples": master,
        },
        placed, everything, candidates,
    )
    return {
        "all_samples": project_canonical(everything, COHORT_SCHEMA),
        "cohort": project_canonical(cohort, COHORT_SCHEMA),
        "exclusions": project_canonical(excluded, COHORT_SCHEMA),
        "folds": placed.select("sample_id", "patient_id", "disease_label", "outer_fold"),
        # Several source columns may share a sample key: the alphabetically first source counts.
        "normalized": joins.align_matrix(rekeyed(normalized), samples, order="source_id"),
        "counts": joins.align_matrix(rekeyed(counts), samples, order="source_id"),
        "category_counts": c.category_counts(cohort),
        "summary": summary,
    }
