"""Step 1: harmonize, profile, impute, scale, merge and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.operators import joins, keys, metadata, prepare, profile
from cohortwright.operators.distributed import lookup_join, materialize

KEYS = (*keys.HARMONIZED.values(), "type_code")


def preprocess(
    counts: DataFrame,
    normalized: DataFrame,
    clinical: DataFrame,
    id_col: str = "barcode",
    label: str | None = None,
    order: Sequence[Column | str] | None = None,
    missing_threshold: float = 0.5,
    force_log2: bool = False,
    scale_method: str = "zscore",
    top_percent: float | None = None,
    outlier_z: float = 3.0,
    test_fraction: float = 0.2,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Long matrices ``(sample_id, gene, value)`` and one clinical table to model-ready tables.

    ``order`` picks the first of several clinical rows with the same key; without it a repeated key
    is an error. The matrix stays long throughout; one row per sample carries label and features.
    """
    clinical = keys.dedupe_first(clinical, id_col, order) if order else keys.assert_unique(clinical, id_col, "metadata")
    clinical = keys.add_keys(clinical, id_col)
    fields = [c for c in clinical.columns if c != id_col and c not in KEYS]
    by_column = profile.missing_profile(clinical, "metadata")
    sparse = metadata.drop_sparse_rows(clinical, fields, missing_threshold)
    cleaned, log = prepare.impute_metadata(sparse, fields)

    counts_imputed = prepare.impute(counts)
    logged = prepare.auto_log2(prepare.impute(normalized), force_log2)
    method = logged.select("method").limit(1)
    processed = materialize(prepare.scale(logged.drop("method"), scale_method))

    samples = keys.add_keys(processed.select("sample_id").distinct(), "sample_id").drop("type_code")
    merged = materialize(joins.tiered_join(samples, cleaned.drop("type_code"), joins.tiers_for(id_col)))
    strategy = merged.select("merge_strategy", "match_count").first()
    tier = dict(joins.TIERS)[strategy["merge_strategy"]]
    lost_left, lost_right = joins.unmatched(samples, cleaned, tier)

    target = profile.detect_label(cleaned, exclude=[id_col, *KEYS], choice=label)
    in_cohort = joins.restrict(processed, merged)
    if top_percent is not None:
        in_cohort = prepare.top_variance(in_cohort, top_percent)
    in_cohort = materialize(in_cohort)
    outliers = materialize(prepare.outlier_scores(in_cohort, outlier_z))
    kept = outliers.filter(~F.col("is_outlier")).select("sample_id")
    if kept.isEmpty():
        raise ValueError("Outlier filtering removed every sample")
    matrix = lookup_join(in_cohort, kept, "sample_id", "left_semi", stored=True)

    drop = {"merge_strategy", "match_count", *keys.HARMONIZED.values(), *(f"{k}_metadata" for k in keys.HARMONIZED.values()), id_col}
    rows = merged.join(kept, "sample_id", "left_semi").drop(*(drop - {"sample_id"}))
    features = [c for c in rows.columns if c not in ("sample_id", target)]
    levels = metadata.text_columns(rows, features)
    slots = materialize(metadata.level_slots(rows, levels)) if levels else None
    # One sparse column, whatever the number of levels; the dictionary is a table of its own.
    encoded = metadata.sparse_one_hot(rows, slots, levels, "sample_id") if levels else rows
    split = materialize(prepare.stratified_split(encoded, target, test_fraction, seed))
    missing = profile.missing_total({"counts": counts_imputed, "metadata": cleaned, "normalized": processed, "merged": matrix})
    summary = profile.run_summary(
        split,
        {
            "identifier_column": id_col,
            "label_column": target,
            "normalization_method": method.first()["method"],
            "scaling_method": scale_method,
            "expression_rows": samples.count(),
            "metadata_rows": cleaned.count(),
            "merge_candidate_rows": strategy["match_count"],
            "merge_strategy": strategy["merge_strategy"],
            "merged_rows": F.count("*"),
            "gene_feature_count": in_cohort.select("gene").distinct().count(),
            "encoded_metadata_feature_count": len(features) - len(levels) + (slots.count() if levels else 0),
            "outliers_removed": outliers.filter("is_outlier").count(),
            "train_rows": F.count_if(F.col("split") == "train"),
            "test_rows": F.count_if(F.col("split") == "test"),
        },
    )
    return {
        "counts_imputed": counts_imputed,
        "metadata_cleaned": cleaned,
        "expression_processed": processed,
        "matrix": matrix,
        "samples": split,
        **({"metadata_levels": slots} if levels else {}),
        "missing_summary": missing,
        "missing_by_column": by_column,
        "imputation_log": log,
        "outlier_summary": outliers,
        "unmatched_expression": lost_left,
        "unmatched_metadata": lost_right,
        "summary": summary,
    }
