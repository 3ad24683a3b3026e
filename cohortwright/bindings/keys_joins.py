"""Sources, keys and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwright.plans import files
from cohortwright.functions.identifiers import key_variants, normalize_id, type_code
from cohortwright.operators import joins, keys
from cohortwright.operators.distributed import scratch_root
from cohortwright.sources import gene_sets, matrix, tables

from .support import Book, sql
from .views import view

book = Book()


def _path(spark) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


# ---- sources and schema ------------------------------------------------------------------------


@book.add("s1_read_table", sql("SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer", "c_acctbal c_custkey c_nationkey"))
def s1(spark, sf):
    path = _path(spark)
    messy = F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_mktsegment"))
    view(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", messy.alias("c_mktsegment")).write.csv(path, header=True)
    return tables.read_table(spark, path, fmt="csv")


@book.add("s2_trim_columns", sql("SELECT n_nationkey, n_name FROM nation", ints="n_nationkey"))
def s2(spark, sf):
    return tables.trim_columns(view(spark, sf, "nation").select(F.col("n_nationkey").alias(" n_nationkey"), F.col("n_name").alias("n_name ")))


@book.add("s3_matrix_to_long", sql("SELECT 'TCGA-00-' || substr(gene, 2) AS sample_id, sample_id AS gene, value FROM (UNPIVOT (SELECT * FROM wide) ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME gene VALUE value)", "value"))
def s3(spark, sf):
    # Gene-by-sample input: the embedding slots play the samples.
    wide = view(spark, sf, "wide")
    return matrix.matrix_to_long(wide.toDF("gene_id", *[f"tcga.00.{c[1:]}" for c in wide.columns[1:]])).select(F.upper(F.translate("sample_id", ".", "-")).alias("sample_id"), "gene", "value")


@book.add("s3_wide_text_matrix", sql("SELECT sample_id, gene, value FROM (UNPIVOT (SELECT * FROM wide) ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME gene VALUE value)", "value"))
def s3_text(spark, sf):
    path = _path(spark)
    view(spark, sf, "wide").write.csv(path, header=True)
    return matrix.read_wide_matrix(spark, path)


def _twice(df: DataFrame, later: DataFrame, path: str) -> str:
    """CSV folders of which the second repeats every row with other values."""
    for name, part in (("1", df), ("2", later)):
        part.write.csv(f"{path}/{name}", header=True)
    return f"{path}/*"


@book.add("s3_raw_matrix", sql("SELECT sample_id, gene, value FROM (UNPIVOT (SELECT * FROM wide) ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME gene VALUE value)", "value"))
def s3_raw(spark, sf):
    """A raw matrix with every line twice; the first one counts."""
    wide = view(spark, sf, "wide")
    later = wide.select("sample_id", *[(F.col(c) + 1).alias(c) for c in wide.columns[1:]])
    return files.read_matrix(spark, _twice(wide, later, _path(spark)))


@book.add("s2_raw_clinical", sql("SELECT barcode, race, days_to_death, CAST(h AS DOUBLE) AS h FROM meta", "days_to_death h"))
def s2_raw(spark, sf):
    """A raw clinical table with every row twice: key found, numbers typed, the first row of a key kept."""
    meta = view(spark, sf, "meta").select("race", "barcode", "days_to_death", "h")
    path = _twice(meta, meta.withColumns({"race": F.lit("later"), "h": F.col("h") + 1}), _path(spark))
    table, key, _ = files.read_clinical(spark, path)
    return table.select(F.col(key).alias("barcode"), "race", "days_to_death", "h")


@book.add("s4_gene_sets", sql("SELECT DISTINCT pathway, gene FROM sets"))
def s4(spark, sf):
    # One line per set, written as GMT text; a set holds at most 400 parts by construction.
    path = _path(spark)
    lines = view(spark, sf, "sets").groupBy("pathway").agg(F.concat_ws("\t", F.first("pathway"), F.lit("parts"), F.collect_list("gene")).alias("value"))
    lines.select("value").write.text(path)
    return gene_sets.read_gene_sets(spark, path)


@book.add("s5_optional_input", sql("SELECT c_custkey, c_name FROM customer"))
def s5(spark, sf):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    absent = tables.read_optional(spark, f"{sf}/no_such_table.parquet", schema)
    return tables.read_optional(spark, f"{sf}/customer.parquet", schema).select(*schema.names).unionByName(absent)


@book.add("s6_write_table", sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice"))
def s6(spark, sf):
    path = _path(spark)
    tables.write_table(view(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@book.add("s7_write_summary", sql("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1", "top"))
def s7(spark, sf):
    path = _path(spark)
    stats = view(spark, sf, "orders").groupBy("o_orderstatus").agg(F.struct(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).alias("stats"))
    tables.write_summary(stats, path)
    return spark.read.json(path).select("o_orderstatus", "stats.n", "stats.top")


@book.add("s8_require_columns", sql("SELECT o_orderkey, o_custkey FROM orders"))
def s8(spark, sf):
    return tables.require_columns(view(spark, sf, "orders"), ["o_orderkey", "o_custkey"], "orders").select("o_orderkey", "o_custkey")


@book.add("s9_numeric_columns", sql("SELECT c_custkey, CASE WHEN age <> 'bad' THEN CAST(age AS DOUBLE) END AS age, days_to_death, CAST(h AS DOUBLE) AS h FROM meta", "age days_to_death h"))
def s9(spark, sf):
    df = view(spark, sf, "meta").withColumn("age", F.nullif("age", F.lit("bad")))
    numeric, _ = tables.numeric_columns(df, "c_custkey", coerce=True)
    return df.select("c_custkey", *[F.col(c).cast("double").alias(c) for c in numeric])


@book.add("s10_project_canonical", sql("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(NULL AS DOUBLE) AS days_to_death, o_totalprice FROM orders", "o_totalprice"))
def s10(spark, sf):
    schema = T.StructType([T.StructField("o_orderkey", T.StringType()), T.StructField("days_to_death", T.DoubleType()), T.StructField("o_totalprice", T.DoubleType())])
    return tables.project_canonical(view(spark, sf, "orders"), schema)


# ---- keys --------------------------------------------------------------------------------------

NORMAL = "CASE WHEN trim({c}) = '' OR lower(trim({c})) IN ('nan', 'none', 'null', 'na') THEN NULL ELSE upper(replace(trim({c}), '.', '-')) END"


@book.add("i1_normalize_id", sql(f"SELECT o_orderkey, {NORMAL.format(c='raw')} AS id FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' NA ' WHEN 1 THEN '  ' ELSE ' ' || o_orderpriority || '.' || o_orderkey || ' ' END AS raw FROM orders)"))
def i1(spark, sf):
    raw = F.when(F.col("o_orderkey") % 7 == 0, " NA ").when(F.col("o_orderkey") % 7 == 1, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("."), F.col("o_orderkey").cast("string"), F.lit(" ")))
    return view(spark, sf, "orders").select("o_orderkey", normalize_id(raw).alias("id"))


# Barcodes cut to two to four parts, so that every level is missing somewhere.
CUT = "CASE row_id % 4 WHEN 0 THEN barcode WHEN 1 THEN 'TCGA-' || patient_no WHEN 2 THEN 'TCGA-x-' || patient_no ELSE 'gtex.' || barcode END"
LEVELS = f"""SELECT row_id, f AS key_full,
  CASE WHEN starts_with(f, 'TCGA-') AND len(p) >= 4 THEN array_to_string(p[1:4], '-') END AS key_sample,
  CASE WHEN starts_with(f, 'TCGA-') AND len(p) >= 3 THEN array_to_string(p[1:3], '-') END AS key_patient,
  CASE WHEN starts_with(f, 'TCGA-') THEN nullif(regexp_extract(p[4], '^(\\d{{2}})', 1), '') END AS code
FROM (SELECT row_id, f, string_split(f, '-') AS p FROM (SELECT row_id, upper(replace({CUT}, '.', '-')) AS f FROM samples))"""


def _cut(spark, sf):
    return view(spark, sf, "samples").select("row_id", F.expr(CUT).alias("raw"))


@book.add("i2_key_variants", sql(f"SELECT row_id, key_full, key_sample, key_patient FROM ({LEVELS})"))
def i2(spark, sf):
    return _cut(spark, sf).select("row_id", *[c.alias(f"key_{k}") for k, c in key_variants("raw").items()])


@book.add("i3_type_code", sql(f"SELECT row_id, code FROM ({LEVELS})"))
def i3(spark, sf):
    return _cut(spark, sf).select("row_id", type_code("raw").alias("code"))


@book.add("i4_add_keys", sql(f"SELECT row_id, key_full AS harmonized_id, key_sample AS harmonized_sample_id, key_patient AS harmonized_patient_id, code AS type_code FROM ({LEVELS})"))
def i4(spark, sf):
    return keys.add_keys(_cut(spark, sf), "raw").drop("raw")


@book.add("i5_effective_key", sql(f"SELECT row_id, coalesce(key_sample, key_full) AS sample_key FROM ({LEVELS})"))
def i5(spark, sf):
    return keys.add_keys(_cut(spark, sf), "raw").select("row_id", keys.effective_key().alias("sample_key"))


@book.add("i6_id_profile", sql("""
SELECT col AS "column", count(id) AS n_values, count(DISTINCT id) AS n_distinct,
  count(DISTINCT id) / count(id) AS uniqueness, bool_or(regexp_matches(id, '[A-Z]')) AS has_pattern,
  coalesce(count(num) = count(id) AND count(id) > 1 AND max(num) - min(num) + 1 = count(id) AND count(DISTINCT num) = count(id), false) AS is_sequence,
  count(DISTINCT id) / count(id) >= 0.8 AND (bool_or(regexp_matches(id, '[A-Z]')) OR NOT coalesce(count(num) = count(id) AND count(id) > 1 AND max(num) - min(num) + 1 = count(id) AND count(DISTINCT num) = count(id), false)) AS id_like
FROM (SELECT col, id, try_cast(id AS DOUBLE) AS num FROM (
  SELECT 'o_orderkey' AS col, CAST(o_orderkey AS VARCHAR) AS id FROM orders
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'code', 'K' || o_orderkey FROM orders)) GROUP BY 1""", "uniqueness", "n_values n_distinct"))
def i6(spark, sf):
    df = view(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("code"))
    return keys.id_profile(df, df.columns)


@book.add("i7_detect_key", sql("SELECT row_id, sample_id AS found FROM samples"))
def i7(spark, sf):
    a = view(spark, sf, "samples").select("row_id", "sample_id")
    b = view(spark, sf, "sample_envs").select("sample_id", "env_sex")
    return a.select("row_id", F.col(keys.detect_key([a, b])).alias("found"))


@book.add("i8_name_unnamed_key", sql("SELECT barcode, amount FROM samples", "amount"))
def i8(spark, sf):
    # Two nameless columns: a plain counter, which is passed over, and the barcodes.
    df = view(spark, sf, "samples").select(F.col("row_id").alias("Unnamed: 0"), F.col("barcode").alias("Unnamed: 1"), "amount")
    return keys.name_unnamed_key(df).select("barcode", "amount")


DUPES = "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 9 = 0 THEN 'odd' ELSE lower(c_mktsegment) || ' ' END AS b FROM customer"


def _dupes(spark, sf):
    df = view(spark, sf, "customer").select(
        F.col("c_custkey").alias("c0"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c1"),
        F.when(F.col("c_custkey") % 9 == 0, "odd").otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" "))).alias("c2"),
    )
    return keys.resolve_duplicate_columns(df, ["c_custkey", "segment", "segment"])


@book.add("i9_resolve_duplicates", sql(f"SELECT c_custkey, coalesce(a, b) AS segment FROM ({DUPES})"))
def i9(spark, sf):
    return _dupes(spark, sf)[0]


@book.add("i9_duplicate_report", sql(f"SELECT 'segment' AS \"column\", 1 AS extra_copies, count(*) FILTER (WHERE a IS NOT NULL AND upper(trim(a)) <> upper(trim(b))) AS conflicting_rows FROM ({DUPES})", ints="extra_copies conflicting_rows"))
def i9_report(spark, sf):
    return _dupes(spark, sf)[1]


@book.add("i10_dedupe_first", sql("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "o_totalprice"))
def i10(spark, sf):
    return keys.dedupe_first(view(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [-F.col("o_totalprice"), "o_orderkey"])


@book.add("i11_duplicate_keys", sql("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", ints="l_linenumber n_rows"))
def i11(spark, sf):
    return keys.duplicate_keys(view(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- joins and set operations ------------------------------------------------------------------


@book.add("j1_tiered_join", sql("""
SELECT m.c_custkey, s.row_id, 'patient barcode fallback' AS merge_strategy,
  (SELECT count(*) FROM samples WHERE patient_id IN (SELECT upper(replace(barcode, '.', '-')) FROM meta)) AS match_count
FROM samples s JOIN meta m ON s.patient_id = upper(replace(m.barcode, '.', '-'))"""))
def j1(spark, sf):
    # Samples against patients: neither the full nor the sample key of a patient exists.
    left = keys.add_keys(view(spark, sf, "samples").select("row_id", "barcode"), "barcode").select("row_id", "harmonized_id", "harmonized_sample_id", "harmonized_patient_id")
    right = keys.add_keys(view(spark, sf, "meta").select("c_custkey", "barcode"), "barcode").select("c_custkey", "harmonized_id", "harmonized_sample_id", "harmonized_patient_id")
    joined = joins.tiered_join(left, right, joins.tiers_for("patient"), one_to_one=False)
    return joined.select("c_custkey", "row_id", "merge_strategy", "match_count")


@book.add("j2_unmatched", sql("""
SELECT 'left' AS side, patient_no AS id FROM samples WHERE patient_no NOT IN (SELECT c_custkey FROM meta WHERE c_custkey % 3 > 0)
UNION ALL SELECT 'right', c_custkey FROM meta WHERE c_custkey % 3 > 0 AND c_custkey NOT IN (SELECT patient_no FROM samples)"""))
def j2(spark, sf):
    left = view(spark, sf, "samples").select(F.col("patient_no").alias("id"))
    right = view(spark, sf, "meta").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"))
    a, b = joins.unmatched(left, right, "id")
    return a.select(F.lit("left").alias("side"), "id").unionByName(b.select(F.lit("right").alias("side"), "id"))


@book.add("j3_shared_keys", sql("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"))
def j3(spark, sf):
    orders, items = view(spark, sf, "orders"), view(spark, sf, "lineitem")
    return joins.shared_keys(
        orders.filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("id")),
        items.filter("l_quantity > 40").select(F.col("l_orderkey").alias("id")),
        orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), key="id",
    )


@book.add("j4_restrict", sql("SELECT sample_id, gene, value FROM expr WHERE sample_id IN (SELECT 's' || o_orderkey FROM orders WHERE o_orderstatus = 'F')", "value"))
def j4(spark, sf):
    kept = view(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sample_id"))
    return joins.restrict(view(spark, sf, "expr"), kept)


@book.add("j5_attach_folds", sql("SELECT g.sample_id, g.patient_id, g.disease_label, g.outer_fold, g.outer_fold * 10 AS site FROM grp g", ints="disease_label outer_fold site"))
def j5(spark, sf):
    cohort = view(spark, sf, "grp").drop("vec_id")
    folds = cohort.select("sample_id", F.lit(-1).alias("outer_fold"), (F.col("outer_fold") * 10).alias("site"))
    return joins.attach_folds(cohort, folds)


@book.add("j6_align_matrix", sql("SELECT sample_id, gene, arg_min(v, b) AS value FROM (SELECT e.sample_id, e.gene, {'x': e.value} AS v, copies.b FROM emb e CROSS JOIN (VALUES (1), (2)) AS copies(b)) GROUP BY 1, 2".replace("arg_min(v, b) AS value", "arg_min(v, b).x AS value"), "value"))
def j6(spark, sf):
    # Every row twice, the second copy with another value; the first one counts.
    long = view(spark, sf, "emb").select("sample_id", "gene", F.explode(F.array(F.struct("value", F.lit(1).alias("o")), F.struct((F.col("value") + 1).alias("value"), F.lit(2).alias("o")))).alias("c"))
    long = long.select("sample_id", "gene", "c.value", F.col("c.o").alias("position"))
    return joins.align_matrix(long, view(spark, sf, "grp"), order="position")


@book.add("j7_enrich", sql("SELECT s.row_id, m.gender, m.race FROM samples s LEFT JOIN (SELECT * FROM meta WHERE c_custkey % 5 > 0) m ON s.patient_no = m.c_custkey"))
def j7(spark, sf):
    dim = view(spark, sf, "meta").filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("patient_no"), "gender", "race")
    return joins.enrich(view(spark, sf, "samples").select("row_id", "patient_no"), dim, "patient_no").drop("patient_no")


@book.add("j8_fuse_evidence", sql("""
WITH a AS (SELECT gene, avg(attribution_value) AS attribution_score FROM attr GROUP BY 1),
g AS (SELECT gene, avg(abs_gate_weight) AS gate_score FROM run_weights GROUP BY 1),
s AS (SELECT gene, max(gate_weight) AS stability_score FROM run_weights GROUP BY 1),
p AS (SELECT gene, avg(abs(delta_prob)) AS perturbation_score FROM pert GROUP BY 1)
SELECT coalesce(a.gene, g.gene, s.gene) AS gene, coalesce(attribution_score, 0.0) AS attribution_score,
  coalesce(gate_score, 0.0) AS gate_score, coalesce(stability_score, 0.0) AS stability_score,
  coalesce(perturbation_score, 0.0) AS perturbation_score
FROM a FULL JOIN g ON a.gene = g.gene FULL JOIN s ON coalesce(a.gene, g.gene) = s.gene
LEFT JOIN p ON coalesce(a.gene, g.gene, s.gene) = p.gene""", "attribution_score gate_score stability_score perturbation_score"))
def j8(spark, sf):
    w = view(spark, sf, "run_weights")
    return joins.fuse_evidence(
        view(spark, sf, "attr").groupBy("gene").agg(F.avg("attribution_value").alias("attribution_score")),
        w.groupBy("gene").agg(F.avg("abs_gate_weight").alias("gate_score")),
        w.groupBy("gene").agg(F.max("gate_weight").alias("stability_score")),
        perturbation=view(spark, sf, "pert").groupBy("gene").agg(F.avg(F.abs("delta_prob")).alias("perturbation_score")),
    )


@book.add("j9_join_1to1", sql("SELECT o_orderkey, o_totalprice, n_items FROM orders JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", "o_totalprice"))
def j9(spark, sf):
    items = view(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"))
    return joins.join_1to1(view(spark, sf, "orders").select("o_orderkey", "o_totalprice"), items, "o_orderkey")


@book.add("j10_union_logs", sql("SELECT row_id, amount, 'unsupported_sample_type_for_primary_cohort' AS exclusion_reason FROM samples WHERE disease_label IS NULL UNION ALL SELECT row_id, NULL, 'unmatched_across_input_tables' FROM samples WHERE patient_no % 10 = 1", "amount"))
def j10(spark, sf):
    s = view(spark, sf, "samples")
    return joins.union_logs([
        (s.filter("disease_label IS NULL").select("row_id", "amount"), "unsupported_sample_type_for_primary_cohort"),
        (s.filter("patient_no % 10 = 1").select("row_id"), "unmatched_across_input_tables"),
    ])


@book.add("j11_sorted_output", sql("SELECT row_id, env_stage, amount FROM samples ORDER BY env_stage NULLS LAST, amount DESC, row_id", "amount"))
def j11(spark, sf):
    return joins.sorted_output(view(spark, sf, "samples").select("row_id", "env_stage", "amount"), ["env_stage", "amount", "row_id"], ["amount"])


@book.add("j12_primary_rows", sql("SELECT row_id, patient_id FROM samples WHERE disease_label IS NOT NULL"))
def j12(spark, sf):
    s = view(spark, sf, "samples").withColumn("primary_supported_sample", F.col("disease_label").isNotNull())
    return joins.primary_rows(s).select("row_id", "patient_id")


@book.add("j13_union_runs", sql("SELECT model_name, seed, sample_id, y_prob FROM pred WHERE seed = 1 UNION ALL SELECT model_name, seed, sample_id, y_prob FROM pred WHERE seed = 2", "y_prob", "seed"))
def j13(spark, sf):
    p = view(spark, sf, "pred").select("model_name", "seed", "sample_id", "y_prob")
    return joins.union_runs([p.filter("seed = 1"), p.filter("seed = 2")])
