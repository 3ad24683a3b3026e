"""Recoding, metadata, profiling and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwright.functions import recode
from cohortwright.functions.arithmetic import to_number
from cohortwright.operators import metadata, prepare, profile

from .support import Book, sql
from .views import Duck, view

book = Book()

CLEAN = "CASE WHEN {c} IS NULL OR trim({c}) = '' OR lower(trim({c})) IN ('not reported', 'not available', 'unknown', 'nan', 'none', 'null', '--', '[not available]', '[unknown]') THEN 'unknown' ELSE trim({c}) END"


def clean(c: str) -> str:
    return CLEAN.format(c=c)


def low(c: str) -> str:
    return f"lower({clean(c)})"


SEX = f"CASE WHEN {low('gender')} IN ('male', 'm') THEN 'male' WHEN {low('gender')} IN ('female', 'f') THEN 'female' ELSE 'unknown' END"
HISTOLOGY = f"CASE WHEN {low('primary_diagnosis')} = 'unknown' THEN 'unknown' WHEN regexp_matches({low('primary_diagnosis')}, 'squamous|escc') THEN 'escc' WHEN regexp_matches({low('primary_diagnosis')}, 'adeno|eac') THEN 'eac' ELSE 'other' END"
SMOKING = f"CASE WHEN {low('smoking_status')} = 'unknown' THEN 'unknown' WHEN try_cast({low('smoking_status')} AS DOUBLE) IN (0, 1) THEN 'non_smoker' WHEN try_cast({low('smoking_status')} AS DOUBLE) > 0 THEN 'smoker' WHEN regexp_matches({low('smoking_status')}, '\\b(never|non-?smoker|no)\\b') THEN 'non_smoker' WHEN regexp_matches({low('smoking_status')}, '\\b(current|reformed|former|smoker|yes)\\b') THEN 'smoker' ELSE 'unknown' END"
SMOKING_COMPAT = f"CASE WHEN {low('smoking_status')} = 'unknown' THEN 'unknown' WHEN regexp_matches({low('smoking_status')}, 'never|no') THEN 'non_smoker' WHEN regexp_matches({low('smoking_status')}, 'current|reformed|former|smoker|yes|1|2|3|4|5') THEN 'smoker' ELSE 'unknown' END"
STAGE_TEXT = f"trim(replace({low('tumor_stage')}, 'stage', ''))"
NUMERAL = f"regexp_extract({STAGE_TEXT}, '^(iv|iii|ii|i|[1-4])([abc][0-9]?)?(\\W|$)', 1)"
STAGE = f"CASE WHEN {NUMERAL} IN ('i', 'ii', '1', '2') THEN 'early_stage' WHEN {NUMERAL} IN ('iii', 'iv', '3', '4') THEN 'late_stage' ELSE 'unknown' END"
STAGE_COMPAT = f"CASE WHEN {STAGE_TEXT} = 'unknown' THEN 'unknown' WHEN regexp_matches({STAGE_TEXT}, '^[i12]') THEN 'early_stage' WHEN regexp_matches({STAGE_TEXT}, '^[34]') THEN 'late_stage' ELSE 'unknown' END"
REGION = f"regexp_replace({low('country')}, '\\s+', '_', 'g')"


def _meta(spark, sf, **cols):
    return view(spark, sf, "meta").select("c_custkey", *[c.alias(n) for n, c in cols.items()])


@book.add("c1_clean_unknown", sql(f"SELECT c_custkey, {clean('gender')} AS v FROM meta"))
def c1(spark, sf):
    return _meta(spark, sf, v=recode.clean_unknown("gender"))


@book.add("c2_recode_exact", sql(f"SELECT c_custkey, {SEX} AS v FROM meta"))
def c2(spark, sf):
    return _meta(spark, sf, v=recode.recode_exact("gender"))


@book.add("c3_recode_contains", sql(f"SELECT c_custkey, {HISTOLOGY} AS histology, {SMOKING} AS smoking, {SMOKING_COMPAT} AS smoking_compat FROM meta"))
def c3(spark, sf):
    return _meta(spark, sf, histology=recode.recode_contains("primary_diagnosis"), smoking=recode.recode_smoking("smoking_status"), smoking_compat=recode.recode_smoking("smoking_status", "compat"))


@book.add("c4_recode_stage", sql(f"SELECT c_custkey, {STAGE} AS stage, {STAGE_COMPAT} AS stage_compat FROM meta"))
def c4(spark, sf):
    return _meta(spark, sf, stage=recode.recode_stage("tumor_stage"), stage_compat=recode.recode_stage("tumor_stage", "compat"))


@book.add("c5_slug", sql(f"SELECT c_custkey, {REGION} AS v FROM meta"))
def c5(spark, sf):
    return _meta(spark, sf, v=recode.slug("country"))


def _canonical(spark, sf):
    df = view(spark, sf, "meta").drop("h").withColumnsRenamed({"gender": "Gender ", "tumor_stage": "Tumor Stage", "primary_diagnosis": "primary.diagnosis"})
    return metadata.canonicalize_metadata(df)


CANONICAL = "SELECT c_custkey, barcode, gender AS sex_raw, race AS race_raw, country AS country_raw, smoking_status AS smoking_raw, tumor_stage AS stage_raw, primary_diagnosis AS histology_raw, days_to_death, age AS age_at_diagnosis FROM meta"


@book.add("c6_canonicalize", sql(CANONICAL, "days_to_death"))
def c6(spark, sf):
    return _canonical(spark, sf).select("c_custkey", "barcode", "sex_raw", "race_raw", "country_raw", "smoking_raw", "stage_raw", "histology_raw", "days_to_death", "age_at_diagnosis")


TYPE_META = "CASE WHEN contains(t, 'primary tumor') OR t IN ('tumor', 'primary_tumor') THEN '01' WHEN contains(t, 'solid tissue normal') OR t IN ('normal', 'solid_normal', 'solid_tissue_normal') THEN '11' ELSE nullif(regexp_extract(t, '^(\\d{2})', 1), '') END"
TYPED = f"SELECT row_id, code AS a, {TYPE_META} AS b FROM (SELECT row_id, CASE WHEN row_id % 4 > 0 THEN sample_type_code END AS code, lower(trim(type_text)) AS t FROM samples)"


def _typed(spark, sf):
    s = view(spark, sf, "samples").select("row_id", F.when(F.col("row_id") % 4 > 0, F.col("sample_type_code")).alias("type_code"), F.col("type_text").alias("sample_type_metadata"))
    return metadata.infer_type(s)


@book.add("c7_infer_type", sql(f"SELECT row_id, b AS sample_type_code_metadata, coalesce(a <> b, false) AS sample_type_conflict, coalesce(a, b) AS sample_type_code, CASE coalesce(a, b) WHEN '01' THEN 'primary_tumor' WHEN '11' THEN 'solid_tissue_normal' ELSE 'unsupported' END AS sample_type_label FROM ({TYPED})"))
def c7(spark, sf):
    return _typed(spark, sf).select("row_id", "sample_type_code_metadata", "sample_type_conflict", "sample_type_code", "sample_type_label")


@book.add("c8_binary_label", sql(f"SELECT row_id, CASE coalesce(a, b) WHEN '01' THEN 1 WHEN '11' THEN 0 END AS disease_label, CASE coalesce(a, b) WHEN '01' THEN 'tumor' WHEN '11' THEN 'normal' END AS disease_label_name, coalesce(coalesce(a, b) IN ('01', '11'), false) AS primary_supported_sample FROM ({TYPED})", ints="disease_label"))
def c8(spark, sf):
    return metadata.binary_label(_typed(spark, sf)).select("row_id", "disease_label", "disease_label_name", "primary_supported_sample")


@book.add("c9_to_number", sql("SELECT c_custkey, try_cast(age AS DOUBLE) AS v FROM meta", "v"))
def c9(spark, sf):
    return _meta(spark, sf, v=to_number("age"))


FIELDS = ("gender", "smoking_status", "tumor_stage", "primary_diagnosis", "country", "race", "age", "days_to_death", "alcohol", "vital_status", "follow_up", "pack_years")
FILLED = " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in FIELDS[:8])


@book.add("c10_completeness", sql(f"SELECT c_custkey, ({FILLED}) / 12.0::DOUBLE AS metadata_completeness_score, 1 - ({FILLED}) / 12.0::DOUBLE AS confounder_missing_fraction, ({FILLED}) < 6 AS confounder_missing_excess FROM meta", "metadata_completeness_score confounder_missing_fraction"))
def c10(spark, sf):
    return metadata.completeness(view(spark, sf, "meta"), FIELDS).select("c_custkey", "metadata_completeness_score", "confounder_missing_fraction", "confounder_missing_excess")


@book.add("c11_drop_sparse_rows", sql(f"SELECT c_custkey FROM meta WHERE 8 - ({FILLED}) <= 2"))
def c11(spark, sf):
    return metadata.drop_sparse_rows(view(spark, sf, "meta"), FIELDS[:8], 0.25).select("c_custkey")


LEVEL = "CASE WHEN trim({c}) IN ('', 'nan', 'None') OR lower(trim({c})) = 'unknown' THEN NULL ELSE trim({c}) END"
CODES = f"SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT {LEVEL.format(c='primary_diagnosis')} AS level FROM meta WHERE c_custkey % 3 > 0 AND h % 6 <> 2) WHERE level IS NOT NULL"


def _train(spark, sf):
    return view(spark, sf, "meta").filter("c_custkey % 3 > 0 AND h % 6 <> 2")


@book.add("c12_fit_codes", sql(CODES, ints="code"))
def c12(spark, sf):
    return metadata.fit_codes(_train(spark, sf), "primary_diagnosis")


@book.add("c12_apply_codes", sql(f"SELECT c_custkey, coalesce(code, -1) AS primary_diagnosis_code FROM meta LEFT JOIN ({CODES}) ON {LEVEL.format(c='primary_diagnosis')} = level", ints="primary_diagnosis_code"))
def c12_apply(spark, sf):
    return metadata.apply_codes(view(spark, sf, "meta"), metadata.fit_codes(_train(spark, sf), "primary_diagnosis"), "primary_diagnosis").select("c_custkey", "primary_diagnosis_code")


@book.add("c13_encodable", sql("""
SELECT 'race' AS "column", CASE WHEN count(DISTINCT race) < 2 THEN '<2 usable levels' ELSE 'usable' END AS reason FROM meta
UNION ALL SELECT 'flat', CASE WHEN count(DISTINCT CASE WHEN c_custkey >= 0 THEN 'one' END) < 2 THEN '<2 usable levels' ELSE 'usable' END FROM meta
UNION ALL SELECT 'absent', CASE WHEN count(*) >= 0 THEN 'missing' END FROM meta"""))
def c13(spark, sf):
    return metadata.encodable(view(spark, sf, "meta").withColumn("flat", F.lit("one")), ["race", "flat", "absent"])


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@book.add("c14_one_hot", sql("SELECT c_custkey, days_to_death, " + ", ".join(f"CASE WHEN race = '{s}' THEN 1 ELSE 0 END AS race_{s}" for s in SEGMENTS) + " FROM meta", "days_to_death", " ".join(f"race_{s}" for s in SEGMENTS)))
def c14(spark, sf):
    return metadata.one_hot(view(spark, sf, "meta").select("c_custkey", "days_to_death", "race"), ["days_to_death", "race"])


# A level of its own for every customer, and two columns with a few levels and missing cells.
SPARSE = ["barcode", "country", "race"]
SLOTS = f"""SELECT "column", level, row_number() OVER (ORDER BY "column", level) - 1 AS slot
FROM (SELECT DISTINCT "column", level FROM (UNPIVOT (SELECT c_custkey, {', '.join(SPARSE)} FROM meta) ON {', '.join(SPARSE)} INTO NAME "column" VALUE level))"""


@book.add("c14_level_slots", sql(SLOTS))
def c14_slots(spark, sf):
    return metadata.level_slots(view(spark, sf, "meta"), SPARSE)


@book.add("c14_indicators", sql(f"""SELECT c_custkey, s."column", s.level, slot
FROM (UNPIVOT (SELECT c_custkey, {', '.join(SPARSE)} FROM meta) ON {', '.join(SPARSE)} INTO NAME "column" VALUE level) m JOIN ({SLOTS}) s ON m."column" = s."column" AND m.level = s.level"""))
def c14_long(spark, sf):
    meta = view(spark, sf, "meta")
    return metadata.indicators(meta, metadata.level_slots(meta, SPARSE), SPARSE, "c_custkey")


@book.add("c14_sparse_one_hot", sql(f"""SELECT m.c_custkey, m.days_to_death, coalesce(levels, '') AS levels FROM meta m LEFT JOIN (
SELECT c_custkey, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS levels
FROM (UNPIVOT (SELECT c_custkey, {', '.join(SPARSE)} FROM meta) ON {', '.join(SPARSE)} INTO NAME "column" VALUE level) m JOIN ({SLOTS}) s ON m."column" = s."column" AND m.level = s.level GROUP BY 1) l ON m.c_custkey = l.c_custkey""", "days_to_death"))
def c14_sparse(spark, sf):
    meta = view(spark, sf, "meta").select("c_custkey", "days_to_death", *SPARSE)
    out = metadata.sparse_one_hot(meta, metadata.level_slots(meta, SPARSE), SPARSE, "c_custkey")
    return out.withColumn("levels", F.array_join(F.col("levels").cast("array<string>"), ","))


@book.add("c15_note", sql("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_discount * 10 >= 0.7 THEN 'Stable computationally prioritized driver-associated gene with consistent counterfactual effect.' ELSE 'Computationally prioritized candidate driver gene; interpret with observational caution.' END AS note FROM lineitem"))
def c15(spark, sf):
    return view(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", metadata.note(F.col("l_discount") * 10).alias("note"))


@book.add("c16_confounder_table", sql(f"""
SELECT c_custkey, {SEX} AS env_sex, {SMOKING} AS env_smoking, {HISTOLOGY} AS env_histology, {STAGE} AS env_stage,
  {REGION} AS env_country_or_region, try_cast(age AS DOUBLE) AS age_at_diagnosis,
  ({FILLED} - CAST(age = 'bad' AS INT)) / 12.0::DOUBLE AS metadata_completeness_score
FROM (SELECT * REPLACE (coalesce(age, '') AS age) FROM meta)""".replace("({FILLED}", "(").replace("CAST(age IS NOT NULL AS INT)", "CAST(age <> '' AS INT)"), "age_at_diagnosis metadata_completeness_score"))
def c16(spark, sf):
    from cohortwright.operators.keys import add_keys

    df = add_keys(_canonical(spark, sf), "barcode")
    return metadata.confounder_table(df).select("c_custkey", "env_sex", "env_smoking", "env_histology", "env_stage", "env_country_or_region", "age_at_diagnosis", "metadata_completeness_score")


# ---- profiling and preparation -----------------------------------------------------------------

PROFILED = {
    "c_custkey": "bigint", "barcode": "string", "gender": "string", "smoking_status": "string", "tumor_stage": "string",
    "primary_diagnosis": "string", "country": "string", "race": "string", "age": "string", "days_to_death": "double",
    "project_id": "string", "h": "bigint",
}


@book.add("p1_missing_profile", sql(" UNION ALL ".join(f"SELECT 'meta' AS dataset, '{c}' AS \"column\", count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) AS missing_fraction, '{t}' AS dtype FROM meta" for c, t in PROFILED.items()), "missing_fraction"))
def p1(spark, sf):
    return profile.missing_profile(view(spark, sf, "meta"), "meta")


MISSING_CELLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in PROFILED)


@book.add("p2_missing_total", sql(f"SELECT 'meta' AS dataset, sum({MISSING_CELLS}) AS missing_values FROM meta UNION ALL SELECT 'expr', sum(CAST(value IS NULL AS INT)) FROM expr", ints="missing_values"))
def p2(spark, sf):
    return profile.missing_total({"meta": view(spark, sf, "meta"), "expr": view(spark, sf, "expr")})


@book.add("p3_impute_mean", sql("SELECT sample_id, gene, coalesce(value, avg(value) OVER (PARTITION BY gene)) AS value FROM expr", "value"))
def p3(spark, sf):
    return prepare.impute(view(spark, sf, "expr"))


@book.add("p3_impute_median", sql("SELECT sample_id, gene, coalesce(value, median(value) OVER (PARTITION BY gene)) AS value FROM expr", "value"))
def p3_median(spark, sf):
    return prepare.impute(view(spark, sf, "expr"), stat="median")


MODE = "(SELECT {c} FROM meta WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"
MEDIAN = "(SELECT median(days_to_death) FROM meta)"


@book.add("p4_impute_metadata", sql(f"SELECT c_custkey, coalesce(gender, {MODE.format(c='gender')}) AS gender, coalesce(race, {MODE.format(c='race')}) AS race, coalesce(days_to_death, {MEDIAN}) AS days_to_death FROM meta", "days_to_death"))
def p4(spark, sf):
    return prepare.impute_metadata(view(spark, sf, "meta"), ["gender", "race", "days_to_death"])[0].select("c_custkey", "gender", "race", "days_to_death")


@book.add("p4_imputation_log", sql(f"SELECT 'gender' AS \"column\", 'mode:' || {MODE.format(c='gender')} AS strategy, count(*) - count(gender) AS filled_values FROM meta UNION ALL SELECT 'race', 'mode:' || {MODE.format(c='race')}, count(*) - count(race) FROM meta UNION ALL SELECT 'days_to_death', 'median', count(*) - count(days_to_death) FROM meta"))
def p4_log(spark, sf):
    return prepare.impute_metadata(view(spark, sf, "meta"), ["gender", "race", "days_to_death"])[1]


@book.add("p5_auto_log2", sql("SELECT sample_id, gene, log2(value + 1) AS value, 'log2(x + 1)' AS method FROM expr WHERE (SELECT max(value) > 50 FROM expr) UNION ALL SELECT sample_id, gene, value, 'pre-normalized input retained' FROM expr WHERE (SELECT max(value) <= 50 FROM expr)", "value"))
def p5(spark, sf):
    return prepare.auto_log2(view(spark, sf, "expr"))


ZSCORE = "SELECT sample_id, gene, coalesce((value - avg(value) OVER (PARTITION BY gene)) / nullif(stddev_pop(value) OVER (PARTITION BY gene), 0), 0) AS value FROM expr"


@book.add("p6_zscore", sql(ZSCORE, "value"))
def p6(spark, sf):
    return prepare.scale(view(spark, sf, "expr"), "zscore")


@book.add("p7_minmax", sql("SELECT sample_id, gene, coalesce((value - min(value) OVER (PARTITION BY gene)) / nullif(max(value) OVER (PARTITION BY gene) - min(value) OVER (PARTITION BY gene), 0), 0) AS value FROM expr", "value"))
def p7(spark, sf):
    return prepare.scale(view(spark, sf, "expr"), "minmax")


@book.add("p8_top_variance", sql("SELECT sample_id, gene, value FROM expr WHERE gene IN (SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY var_samp(value) DESC NULLS LAST, gene) AS r, count(*) OVER () AS n FROM expr GROUP BY gene) WHERE r <= greatest(1, ceil(n * 0.1)))", "value"))
def p8(spark, sf):
    return prepare.top_variance(view(spark, sf, "expr"), 10.0)


OUTLIERS = f"SELECT sample_id, avg(CAST(abs(value) > 2.5 AS INT)) AS extreme_fraction, avg(CAST(abs(value) > 2.5 AS INT)) > 0.01 AS is_outlier FROM ({ZSCORE}) GROUP BY 1"


@book.add("p9_outlier_scores", sql(OUTLIERS, "extreme_fraction"))
def p9(spark, sf):
    return prepare.outlier_scores(view(spark, sf, "expr"), 2.5)


@book.add("p10_drop_outliers", sql(f"SELECT sample_id, gene, value FROM expr WHERE sample_id IN (SELECT sample_id FROM ({OUTLIERS}) WHERE NOT is_outlier)", "value"))
def p10(spark, sf):
    return prepare.drop_outliers(view(spark, sf, "expr"), 2.5)


@book.add("p11_detect_label", sql("SELECT project_id AS label, count(*) AS n FROM meta GROUP BY 1"))
def p11(spark, sf):
    # The first candidate is constant and is passed over.
    df = view(spark, sf, "meta").select("c_custkey", F.lit("alive").alias("vital_status"), "project_id")
    return df.groupBy(F.col(profile.detect_label(df, exclude=["c_custkey"])).alias("label")).agg(F.count("*").alias("n"))


@book.add("p11_usable_labels", sql("SELECT 'gender' AS \"column\", count(DISTINCT gender) > 1 AS usable FROM meta UNION ALL SELECT 'flat', count(DISTINCT CASE WHEN h >= 0 THEN 1 END) > 1 FROM meta"))
def p11_usable(spark, sf):
    return profile.usable_labels(view(spark, sf, "meta").select("gender", F.lit("x").alias("flat")), ["gender", "flat"])


SPLIT_HASH = Duck.h("'42:' || sample_id")


@book.add("p12_stratified_split", sql(f"SELECT sample_id, disease_label, CASE WHEN row_number() OVER (PARTITION BY disease_label ORDER BY {SPLIT_HASH}, sample_id) <= ceil(0.2 * count(*) OVER (PARTITION BY disease_label)) THEN 'test' ELSE 'train' END AS split FROM samples", ints="disease_label"))
def p12(spark, sf):
    return prepare.stratified_split(view(spark, sf, "samples").select("sample_id", "disease_label"), "disease_label", 0.2, 42)


FOLDS = (1, 2, 3, 4, 5)
HELD = "(VALUES (1), (2), (3), (4), (5)) AS held(f)"
TRAIN = f"FROM emb JOIN {HELD} ON emb.outer_fold <> held.f"


@book.add("p13_training_variance", sql(f"SELECT gene, f AS outer_fold, count(value) AS n, count(*) - count(value) AS missing, avg(value) AS mean, var_samp(value) AS variance {TRAIN} GROUP BY 1, 2", "mean variance", "outer_fold"))
def p13_stats(spark, sf):
    return prepare.training_stats(view(spark, sf, "emb"), FOLDS)


@book.add("p13_select_features", sql(f"SELECT outer_fold, gene, rank, retained FROM (SELECT gene, f AS outer_fold, row_number() OVER (PARTITION BY f ORDER BY var_samp(value) DESC, gene) AS rank, count(*) OVER (PARTITION BY f) AS retained {TRAIN} GROUP BY gene, f HAVING var_samp(value) > 1e-12) WHERE rank <= 20", ints="outer_fold"))
def p13(spark, sf):
    chosen = prepare.select_features(prepare.training_stats(view(spark, sf, "emb"), FOLDS), 20, 10, 40)
    return chosen.select("outer_fold", "gene", "rank", "retained")


PREP = f"""SELECT t.gene, t.f, max(m) AS median, avg(coalesce(value, m)) AS mean_imputed, stddev_pop(coalesce(value, m)) AS std_imputed
FROM (SELECT gene, f, value {TRAIN}) t JOIN (SELECT gene, f, median(value) AS m {TRAIN} GROUP BY 1, 2) m ON t.gene = m.gene AND t.f = m.f GROUP BY 1, 2"""


@book.add("p14_fit_prep", sql(f"SELECT gene, f AS outer_fold, median, mean_imputed, std_imputed FROM ({PREP})", "median mean_imputed std_imputed", "outer_fold"))
def p14_fit(spark, sf):
    return prepare.fit_prep(view(spark, sf, "emb"), FOLDS).select("gene", "outer_fold", "median", "mean_imputed", "std_imputed")


@book.add("p14_apply_prep", sql(f"SELECT e.sample_id, e.gene, e.outer_fold, (coalesce(e.value, s.median) - s.mean_imputed) / s.std_imputed AS value FROM emb e JOIN ({PREP}) s ON e.gene = s.gene AND e.outer_fold = s.f", "value", "outer_fold"))
def p14(spark, sf):
    emb = view(spark, sf, "emb").drop("disease_label")
    return prepare.apply_prep(emb, prepare.fit_prep(emb, FOLDS))


@book.add("p15_run_summary", sql("SELECT 'label_column' AS metric, 'disease_label' AS value UNION ALL SELECT 'expression_rows', CAST(count(*) AS VARCHAR) FROM samples UNION ALL SELECT 'labelled_rows', CAST(count(disease_label) AS VARCHAR) FROM samples"))
def p15(spark, sf):
    return profile.run_summary(view(spark, sf, "samples"), {"label_column": "disease_label", "expression_rows": F.count("*"), "labelled_rows": F.count("disease_label")})


@book.add("p16_labelled_set", sql("SELECT w.*, g.disease_label FROM wide w JOIN grp g ON w.sample_id = g.sample_id", " ".join(f"e{i}" for i in range(64)), "disease_label"))
def p16(spark, sf):
    return prepare.labelled_set(view(spark, sf, "wide"), view(spark, sf, "grp").select("sample_id", "disease_label"))
