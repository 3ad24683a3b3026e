"""Cohort selection, folds and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwright.operators import cohort, folds

from .support import Book, sql
from .views import Duck, view

book = Book()

BEST = "SELECT *, row_number() OVER (PARTITION BY patient_id, disease_label_name ORDER BY metadata_completeness_score DESC, CASE WHEN original_id IS NULL THEN 1 ELSE 0 END, sample_id) AS r FROM samples WHERE disease_label IS NOT NULL"


def _candidates(spark, sf):
    return view(spark, sf, "samples").filter("disease_label IS NOT NULL")


@book.add("k1_pick_representative", sql(f"SELECT sample_id, patient_id, disease_label, r = 1 AS representative_selected, CASE WHEN r > 1 THEN 'duplicate_' || disease_label_name || '_sample_within_patient' END AS exclusion_reason FROM ({BEST})", ints="disease_label"))
def k1(spark, sf):
    return cohort.mark_representatives(_candidates(spark, sf)).select("sample_id", "patient_id", "disease_label", "representative_selected", "exclusion_reason")


@book.add("k1_duplicate_patients", sql("SELECT count(*) FILTER (WHERE n > 1) AS duplicate_patient_count, sum(n - c) AS duplicate_sample_reductions FROM (SELECT patient_id, count(*) AS n, count(DISTINCT disease_label_name) AS c FROM samples WHERE disease_label IS NOT NULL GROUP BY 1)", ints="duplicate_sample_reductions"))
def k1_counts(spark, sf):
    return cohort.duplicate_patients(_candidates(spark, sf))


DEALT = f"SELECT patient_id, (row_number() OVER (PARTITION BY disease_label ORDER BY {Duck.h("'42:' || patient_id")}, patient_id) - 1) % 5 + 1 AS fold FROM (SELECT DISTINCT patient_id, disease_label FROM grp)"


@book.add("k2_grouped_folds", sql(f"SELECT g.sample_id, g.patient_id, g.disease_label, d.fold AS outer_fold FROM grp g JOIN ({DEALT}) d ON g.patient_id = d.patient_id", ints="disease_label outer_fold"))
def k2(spark, sf):
    return folds.grouped_folds(view(spark, sf, "grp").select("sample_id", "patient_id", "disease_label"))


@book.add("k2_grouped_folds_orders", sql(f"SELECT patient_id, disease_label, (row_number() OVER (PARTITION BY disease_label ORDER BY {Duck.h("'7:' || patient_id")}, patient_id) - 1) % 5 + 1 AS outer_fold, n FROM (SELECT patient_id, CAST(min(patient_no) % 2 AS INT) AS disease_label, count(*) AS n FROM samples GROUP BY 1)", ints="disease_label outer_fold n"))
def k2_orders(spark, sf):
    rows = view(spark, sf, "samples").select("patient_id", (F.col("patient_no") % 2).alias("disease_label"))
    dealt = folds.grouped_folds(rows, seed=7)
    return dealt.groupBy("patient_id", "disease_label", "outer_fold").agg(F.count("*").alias("n"))


@book.add("k3_impure_groups", sql("SELECT patient_id, min(disease_label) AS min_label, max(disease_label) AS max_label FROM samples GROUP BY 1 HAVING count(DISTINCT disease_label) > 1", ints="min_label max_label"))
def k3(spark, sf):
    return folds.impure_groups(view(spark, sf, "samples"))


@book.add("k4_leaking_groups", sql("SELECT patient_id, min(f) AS min_fold, max(f) AS max_fold FROM (SELECT patient_id, row_id % 5 + 1 AS f FROM samples) GROUP BY 1 HAVING count(DISTINCT f) > 1"))
def k4(spark, sf):
    return folds.leaking_groups(view(spark, sf, "samples").withColumn("outer_fold", F.col("row_id") % 5 + 1))


@book.add("k4_fold_facts", sql("SELECT count(*) - count(f) AS missing_fold, count(*) FILTER (WHERE disease_label NOT IN (0, 1)) AS bad_label, count(DISTINCT f) > 1 AS several_folds FROM (SELECT disease_label, CASE WHEN row_id % 11 > 0 THEN row_id % 5 + 1 END AS f FROM samples)"))
def k4_facts(spark, sf):
    return folds.fold_facts(view(spark, sf, "samples").withColumn("outer_fold", F.when(F.col("row_id") % 11 > 0, F.col("row_id") % 5 + 1)))


@book.add("k4_no_leakage", sql("SELECT sample_id, outer_fold FROM grp", ints="outer_fold"))
def k4_check(spark, sf):
    return folds.assert_no_leakage(view(spark, sf, "grp")).select("sample_id", "outer_fold")


HELD = "(VALUES (1), (2), (3), (4), (5)) AS held(f)"


@book.add("k5_expand_folds", sql(f"SELECT sample_id, f AS held_out, CASE WHEN outer_fold = f THEN 'test' ELSE 'train' END AS role FROM grp CROSS JOIN {HELD}", ints="held_out"))
def k5(spark, sf):
    return folds.expand_folds(view(spark, sf, "grp"), [1, 2, 3, 4, 5]).select("sample_id", "held_out", "role")


@book.add("k6_inner_folds", sql(f"SELECT f AS held_out, patient_id, disease_label, (row_number() OVER (PARTITION BY f, disease_label ORDER BY {Duck.h("'42:' || f || ':' || patient_id")}, patient_id) - 1) % 3 + 1 AS inner_fold FROM (SELECT DISTINCT patient_id, disease_label, outer_fold FROM grp) JOIN {HELD} ON outer_fold <> f", ints="held_out disease_label inner_fold"))
def k6(spark, sf):
    return folds.inner_folds(view(spark, sf, "grp"), [1, 2, 3, 4, 5])


@book.add("k7_fold_distribution", sql("SELECT row_id % 5 + 1 AS outer_fold, count(*) FILTER (WHERE disease_label = 0) AS label_0, count(*) FILTER (WHERE disease_label = 1) AS label_1 FROM samples GROUP BY 1"))
def k7(spark, sf):
    return cohort.fold_distribution(view(spark, sf, "samples").withColumn("outer_fold", F.col("row_id") % 5 + 1))


@book.add("k8_category_counts", sql("SELECT 'env_sex' AS \"column\", env_sex AS level, count(*) AS n FROM samples GROUP BY 2 UNION ALL SELECT 'env_stage', env_stage, count(*) FROM samples GROUP BY 2"))
def k8(spark, sf):
    return cohort.category_counts(view(spark, sf, "samples"))


@book.add("k9_available_counts", sql(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS available FROM meta" for c in ("gender", "race", "age"))))
def k9(spark, sf):
    return cohort.available_counts(view(spark, sf, "meta"), ["gender", "race", "age", "absent"])


@book.add("k10_excluded_by_reason", sql("SELECT exclusion_reason, count(*) AS n FROM (SELECT CASE WHEN disease_label IS NULL THEN 'unsupported' WHEN patient_no % 10 = 1 THEN 'unmatched' END AS exclusion_reason FROM samples) GROUP BY 1"))
def k10_reasons(spark, sf):
    s = view(spark, sf, "samples")
    return cohort.excluded_by_reason(s.withColumn("exclusion_reason", F.when(F.col("disease_label").isNull(), "unsupported").when(F.col("patient_no") % 10 == 1, "unmatched")))


@book.add("k10_cohort_summary", sql(f"""
SELECT (SELECT count(*) FROM samples) AS all_samples,
  count(*) FILTER (WHERE r = 1 AND disease_label = 1) AS tumor_count,
  count(*) FILTER (WHERE r = 1 AND disease_label = 0) AS normal_count,
  count(DISTINCT patient_id) AS unique_patient_count,
  (SELECT count(*) FROM (SELECT patient_id FROM samples WHERE disease_label IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_patient_count,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT 'duplicate_' || disease_label_name || '_sample_within_patient' AS k, count(*) AS n FROM ({BEST}) WHERE r > 1 GROUP BY 1)) AS reasons,
  (SELECT string_agg(c || '=' || n, ',' ORDER BY c) FROM (SELECT 'env_stage' AS c, count(env_stage) AS n FROM samples UNION ALL SELECT 'sex_raw', count(env_sex) FROM samples)) AS fields,
  count(*) FILTER (WHERE r = 1 AND env_sex = 'male') AS male,
  count(*) FILTER (WHERE r = 1 AND env_stage IS NULL) AS stage_missing,
  (SELECT string_agg(f || '=' || zero || '/' || one, ',' ORDER BY f) FROM (SELECT row_id % 5 + 1 AS f, count(*) FILTER (WHERE disease_label = 0) AS zero, count(*) FILTER (WHERE disease_label = 1) AS one FROM ({BEST}) WHERE r = 1 GROUP BY 1)) AS folds
FROM ({BEST})"""))
def k10(spark, sf):
    everything = view(spark, sf, "samples")
    kept, rest = cohort.pick_representative(_candidates(spark, sf))
    placed = kept.withColumn("outer_fold", F.col("row_id") % 5 + 1)
    row = cohort.cohort_summary(
        kept, rest, {"metadata": everything}, placed, everything.withColumn("sex_raw", F.col("env_sex")), _candidates(spark, sf), ("env_stage", "sex_raw")
    )
    # Levels of the environments that the row repeats; all of them are in k10_category_counts.
    levels = cohort.category_counts(kept)

    def rows_of(c: str, level: Column) -> Column:
        return levels.agg(F.coalesce(F.sum(F.when((F.col("column") == c) & level, F.col("n"))), F.lit(0))).scalar()

    def listed(c: str, value) -> Column:
        return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))), ",")

    return row.select(
        F.col("matched_sample_counts.metadata").alias("all_samples"), "tumor_count", "normal_count", "unique_patient_count", "duplicate_patient_count",
        listed("excluded_sample_counts_by_reason", lambda n: n.cast("string")).alias("reasons"),
        listed("available_confounder_counts", lambda n: n.cast("string")).alias("fields"),
        rows_of("env_sex", F.col("level") == "male").alias("male"), rows_of("env_stage", F.col("level").isNull()).alias("stage_missing"),
        listed("fold_distribution", lambda c: F.concat_ws("/", c["label_0"].cast("string"), c["label_1"].cast("string"))).alias("folds"),
    )


@book.add("k10_category_counts", sql(f"SELECT 'env_sex' AS \"column\", env_sex AS level, count(*) AS n FROM ({BEST}) WHERE r = 1 GROUP BY 2 UNION ALL SELECT 'env_stage', env_stage, count(*) FROM ({BEST}) WHERE r = 1 GROUP BY 2"))
def k10_levels(spark, sf):
    """Levels of the cohort's environments, in full whatever their number."""
    return cohort.category_counts(cohort.pick_representative(_candidates(spark, sf))[0])


@book.add("k11_histogram", sql("""
SELECT b AS bin, lo + b * w AS bin_start, lo + (b + 1) * w AS bin_end, count(o_totalprice) AS n
FROM (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders)
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS bins(b)
LEFT JOIN orders ON least(floor((o_totalprice - lo) / w), 9) = b GROUP BY b, lo, w""", "bin_start bin_end", "bin"))
def k11(spark, sf):
    return cohort.histogram(view(spark, sf, "orders"), "o_totalprice", 10)


@book.add("k12_capped_sample", sql(f"SELECT sample_id, disease_label FROM samples WHERE disease_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY disease_label ORDER BY {Duck.h("'42:' || sample_id")}, sample_id) <= 25", ints="disease_label"))
def k12(spark, sf):
    return cohort.capped_sample(_candidates(spark, sf).select("sample_id", "disease_label"), "disease_label", 25, 42)
