"""Row-level metadata: canonical names, sample types, labels, completeness, category codes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.functions.arithmetic import as_column, to_number
from cohortwright.functions.recode import (
    recode_contains,
    recode_exact,
    recode_smoking,
    recode_stage,
    slug,
)

from .distributed import lookup_join, number_rows

# Canonical metadata columns and the source names they may come from, best first.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "sex_raw": ("sex", "gender", "gender.demographic"),
    "race_raw": ("race", "ethnicity", "race_category"),
    "country_raw": (
        "country", "country_of_origin", "country_of_residence", "region", "project_country", "tumor_tissue_site",
    ),
    "smoking_raw": (
        "smoking_status", "tobacco_smoking_history", "tobacco_smoking_status", "pack_years_smoked",
        "cigarettes_per_day",
    ),
    "pack_years_raw": ("pack_years_smoked", "pack_years", "tobacco_smoking_pack_years_smoked"),
    "alcohol_history_raw": (
        "alcohol_history", "alcohol_consumption", "alcohol_use", "history_of_alcohol_consumption",
    ),
    "stage_raw": (
        "ajcc_pathologic_stage", "ajcc_clinical_stage", "stage_event_pathologic_stage", "tumor_stage", "stage",
    ),
    "histology_raw": (
        "primary_diagnosis", "histological_type", "histologic_diagnosis.1", "histology", "paper_histological_type",
    ),
    "sample_type_metadata": ("sample_type", "sample_type_name", "definition", "tumor_normal"),
    "survival_status_raw": ("vital_status", "survival_status", "os_event", "death_event"),
    "days_to_death": ("days_to_death", "daystodeath"),
    "days_to_last_follow_up": ("days_to_last_follow_up", "daystolastfollowup", "days_to_last_known_alive"),
    "age_at_diagnosis": ("age_at_diagnosis", "age_at_initial_pathologic_diagnosis", "age", "diagnosis_age"),
}

# The twelve fields of the completeness score, and the numeric ones among them.
COMPLETENESS_FIELDS = (
    "histology_raw", "sex_raw", "smoking_raw", "stage_raw", "country_raw", "race_raw", "age_at_diagnosis",
    "alcohol_history_raw", "survival_status_raw", "days_to_death", "days_to_last_follow_up", "pack_years_raw",
)
NUMERIC_FIELDS = ("age_at_diagnosis", "days_to_death", "days_to_last_follow_up", "pack_years_raw")

# Sample-type codes and the texts that name them.
TUMOR_CODE, NORMAL_CODE = "01", "11"
TYPE_LABELS = {TUMOR_CODE: "primary_tumor", NORMAL_CODE: "solid_tissue_normal"}
TUMOR_TEXTS = ("tumor", "primary_tumor")
NORMAL_TEXTS = ("normal", "solid_normal", "solid_tissue_normal")


def snake_case(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def canonicalize_metadata(df: DataFrame, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """Snake-case names; each canonical column is copied from its first available synonym."""
    df = df.toDF(*[snake_case(c) for c in df.columns])
    have = set(df.columns)
    copies: dict[str, Column] = {}
    for canonical, names in synonyms.items():
        source = next((s for s in map(snake_case, names) if s in have), None)
        if source and canonical not in have:
            copies[canonical] = F.col(source)
    return df.withColumns(copies) if copies else df


def metadata_type_code(c: Column | str, tumor: str = TUMOR_CODE, normal: str = NORMAL_CODE) -> Column:
    """Sample-type code named by a metadata text, else its two leading digits."""
    text = F.lower(F.trim(as_column(c).cast("string")))
    out = F.nullif(F.regexp_extract(text, r"^(\d{2})", 1), F.lit(""))
    if normal == NORMAL_CODE:
        out = F.when(text.contains("solid tissue normal") | text.isin(*NORMAL_TEXTS), normal).otherwise(out)
    if tumor == TUMOR_CODE:
        out = F.when(text.contains("primary tumor") | text.isin(*TUMOR_TEXTS), tumor).otherwise(out)
    return out


def infer_type(
    df: DataFrame, barcode_code: str = "type_code", text: str = "sample_type_metadata",
    tumor: str = TUMOR_CODE, normal: str = NORMAL_CODE,
) -> DataFrame:
    """Sample type from barcode and metadata, their conflict, the chosen code and its label."""
    from_text = metadata_type_code(text, tumor, normal) if text in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"sample_type_code_barcode": F.col(barcode_code), "sample_type_code_metadata": from_text})
    a, b = F.col("sample_type_code_barcode"), F.col("sample_type_code_metadata")
    df = df.withColumns(
        {"sample_type_conflict": F.coalesce(a != b, F.lit(False)), "sample_type_code": F.coalesce(a, b)}
    )
    label = F.lit("unsupported")
    for code, name in TYPE_LABELS.items():
        label = F.when(F.col("sample_type_code") == code, name).otherwise(label)
    return df.withColumn("sample_type_label", label)


def binary_label(df: DataFrame, pos: str = TUMOR_CODE, neg: str = NORMAL_CODE, code: str = "sample_type_code") -> DataFrame:
    c = F.col(code)
    return df.withColumns(
        {
            "disease_label": F.when(c == pos, 1).when(c == neg, 0),
            "disease_label_name": F.when(c == pos, "tumor").when(c == neg, "normal"),
            "primary_supported_sample": F.coalesce(c.isin(pos, neg), F.lit(False)),
        }
    )


def completeness(
    df: DataFrame, fields: Sequence[str] = COMPLETENESS_FIELDS, max_missing: float = 0.5
) -> DataFrame:
    """Share of filled fields, share missing, and whether too many are missing; absent fields count as missing."""
    have = [f for f in fields if f in df.columns]
    filled = sum((F.col(f"`{f}`").isNotNull().cast("int") for f in have), F.lit(0))
    score = filled / F.lit(float(len(fields)))
    return df.withColumns(
        {
            "metadata_completeness_score": score,
            "confounder_missing_fraction": 1.0 - score,
            "confounder_missing_excess": (1.0 - score) > max_missing,
        }
    )


def drop_sparse_rows(df: DataFrame, fields: Sequence[str], threshold: float) -> DataFrame:
    missing = sum((F.col(f"`{f}`").isNull().cast("int") for f in fields), F.lit(0))
    return df.filter(missing / F.lit(float(len(fields))) <= threshold)


def confounder_table(df: DataFrame, max_missing: float = 0.5, mode: str = "strict") -> DataFrame:
    """Ids, cleaned environment columns, numeric fields and completeness of a keyed metadata table."""
    df = df.withColumns(
        {
            "patient_id": F.col("harmonized_patient_id"),
            "sample_id": F.coalesce("harmonized_sample_id", "harmonized_id"),
            "original_id": F.col("harmonized_id"),
        }
    )
    absent = [f for f in COMPLETENESS_FIELDS if f not in df.columns]
    if absent:
        df = df.withColumns({f: F.lit(None).cast("string") for f in absent})
    df = df.withColumns(
        {
            "histology_clean": recode_contains("histology_raw"),
            "env_sex": recode_exact("sex_raw"),
            "env_smoking": recode_smoking("smoking_raw", mode),
            "env_histology": recode_contains("histology_raw"),
            "env_stage": recode_stage("stage_raw", mode),
            "env_country_or_region": slug("country_raw"),
        }
        | {f: to_number(f) for f in NUMERIC_FIELDS}
    )
    return completeness(df, COMPLETENESS_FIELDS, max_missing)


def level_text(c: Column | str) -> Column:
    """Trimmed level name; NULL for missing, blank or unknown levels."""
    text = F.trim(as_column(c).cast("string"))
    return F.when(~(text.isin("", "nan", "None") | (F.lower(text) == "unknown")), text)


def fit_codes(df: DataFrame, col: str) -> DataFrame:
    """Code table ``(level, code)``: known levels in sorted order from 0."""
    levels = df.select(level_text(col).alias("level")).filter(F.col("level").isNotNull()).distinct()
    numbered = number_rows(levels, [], ["level"], "code")
    return numbered.select("level", (F.col("code") - 1).alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Codes of ``col``; -1 for a missing, unknown or unseen level."""
    name = name or f"{col}_code"
    keyed = df.withColumn("_level", level_text(col))
    table = codes.select(F.col("level").alias("_level"), F.col("code").alias(name))
    return lookup_join(keyed, table, "_level").fillna(-1, subset=[name]).drop("_level")


def encodable(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: usable, missing from the table, or fewer than two usable levels."""
    have = [c for c in cols if c in df.columns]
    # Two different levels exist exactly when the smallest and largest differ: no distinct count needed.
    aggs = [
        F.when(F.min(level_text(c)).isNull() | (F.min(level_text(c)) == F.max(level_text(c))), "<2 usable levels")
        .otherwise("usable").alias(c)
        for c in have
    ]
    absent = [F.lit("missing").alias(c) for c in cols if c not in df.columns]
    row = df.agg(*aggs, *absent)
    return row.unpivot([], list(cols), "column", "reason")


def column_levels(df: DataFrame, cols: Sequence[str], most: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct levels per column; more than ``most`` levels is an error, not a cut."""
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "level")
    rows = pairs.filter(F.col("level").isNotNull()).distinct().limit(most * len(cols) + 1).collect()
    if len(rows) > most * len(cols):
        raise ValueError(f"More than {most} levels per column in {list(cols)}; one-hot columns would not fit a schema")
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        levels[r["column"]].append(r["level"])
    return {c: sorted(v) for c, v in levels.items()}


def one_hot(
    df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Indicator columns ``<col>_<level>`` per text level; numeric columns pass through, NULL gives all zeros."""
    numeric = {name for name, kind in df.dtypes if kind not in ("string", "boolean")}
    text = [c for c in cols if c not in numeric]
    known = levels or (column_levels(df, text) if text else {})
    keep = [F.col(f"`{c}`") for c in df.columns if c not in text]
    flags = [
        F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in text
        for v in known[c]
    ]
    return df.select(*keep, *flags)


def text_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of ``cols`` that hold levels, not numbers."""
    return [c for c in cols if dict(df.dtypes)[c] in ("string", "boolean")]


def level_slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Level dictionary ``(column, level, slot)`` of text columns: slots from 0, in the order of column and level.

    Any number of levels: they are distinct rows, numbered by ranges, and never come to the driver or into a schema.
    """
    numbered = number_rows(_levels_of(df, cols).drop("_row").distinct(), [], ["column", "level"], "slot")
    return numbered.select("column", "level", (F.col("slot") - 1).alias("slot"))


def _levels_of(df: DataFrame, cols: Sequence[str], key: Column | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols])
    rows = df.select((F.lit(None) if key is None else key).alias("_row"), F.explode(pairs).alias("p"))
    return rows.select("_row", "p.*").filter(F.col("level").isNotNull())


def indicators(df: DataFrame, slots: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Long one-hot rows ``(<key>, column, level, slot)``: one per row of ``df`` and text column with a known level.

    The dictionary is looked up by its measured size, so a small one is broadcast and a large one is joined.
    """
    found = lookup_join(_levels_of(df, cols, F.col(key)), slots, ["column", "level"], "inner")
    return found.select(F.col("_row").alias(key), "column", "level", "slot")


def sparse_one_hot(df: DataFrame, slots: DataFrame, cols: Sequence[str], key: str, name: str = "levels") -> DataFrame:
    """``df`` with a sparse indicator ``name`` (sorted slots that are 1) instead of the text columns of ``cols``.

    ``key`` identifies a row. Missing and unknown levels add no slot; the schema doesn't grow with the levels.
    """
    ones = indicators(df, slots, cols, key).groupBy(key).agg(F.sort_array(F.collect_list("slot")).alias(name))
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols])
    return rest.join(ones, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))


# The two notes on a ranked entity and the consistency that separates them.
CONSISTENT = 0.7
NOTE_STABLE = "Stable computationally prioritized driver-associated gene with consistent counterfactual effect."
NOTE_CAUTION = "Computationally prioritized candidate driver gene; interpret with observational caution."


def note(consistency: Column | str = "directional_consistency") -> Column:
    # A mean that should be 0.7 may fall short of it by the order of its sum.
    value = F.round(F.coalesce(as_column(consistency), F.lit(0.0)), 12)
    return F.when(value >= CONSISTENT, NOTE_STABLE).otherwise(NOTE_CAUTION)


