"""Classifiers over the embedding slots and a slot that separates the label, so that SQL can state what any fit must give."""

from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwright.operators import models as m
from cohortwright.operators import ranking
from cohortwright.operators.distributed import materialize, scratch_root
from cohortwright.operators.prepare import fold_ids, select_features, training_stats

from .support import Book, sql
from .views import view

book = Book()

PLANTED = 4.0
GENES = [*(f"e{i}" for i in range(64)), "planted"]
# Every embedding with a label and one slot that separates it: facts that SQL can state of any fitted model.
LABELLED = "SELECT vec_id, 's' || vec_id AS sample_id, 'p' || vec_id AS patient_id, embedding, CASE WHEN CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) > 0 THEN 1 ELSE 0 END AS label, vec_id % 2 + 1 AS outer_fold FROM embeddings"


def labelled(spark, sf) -> DataFrame:
    """All slots of every embedding, a label (the sum of the first two is positive) and a slot that separates it."""
    e = view(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    label = (x[0] + x[1] > 0).cast("int")
    x = F.concat(x, F.array(F.when(label == 1, PLANTED).otherwise(-PLANTED)))
    return e.select(
        "vec_id",
        F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("patient_id"),
        label.alias("disease_label"),
        (F.col("vec_id") % 2 + 1).cast("int").alias("outer_fold"),
        (F.floor(F.col("vec_id") / 2) % 2 + 1).cast("int").alias("inner_fold"),
        x.alias("x"),
        array_to_vector(x).alias("features"),
    ).withColumn("label", F.col("disease_label").cast("double"))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", "vec_id", F.posexplode("x").alias("pos", "value")).withColumn(
        "gene", F.get(F.array(*[F.lit(g) for g in GENES]), F.col("pos"))
    )


def first_candidate(name: str) -> dict:
    """The first point of a family's own grid."""
    return m.candidates(name)[0] | ({"C": 1.0} if name.startswith("LR") else {})


def _fit(spark, sf, name: str):
    rows = m.balance_weights(labelled(spark, sf)).persist()
    return m.model(name, first_candidate(name), rows.count(), len(GENES)).fit(rows), rows


def _predictions(name: str):
    def query(spark, sf):
        fitted, rows = _fit(spark, sf, name)
        return m.scores_of(fitted, rows, ["sample_id"]).select("sample_id", "y_true", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))

    return query


for _key, _name in (("m1_lr_l1", "LR_L1"), ("m2_lr_elastic_net", "LR_ElasticNet"), ("m3_random_forest", "RandomForest"), ("m4_boosted_trees", "GBT"), ("m5_mlp", "MLP")):
    book.add(_key, sql(f"SELECT sample_id, label AS y_true, label AS y_pred FROM ({LABELLED})", ints="y_true y_pred"))(_predictions(_name))


_GRID = ", ".join(f"({i}, '{json.dumps(p, sort_keys=True)}')" for i, p in enumerate(m.candidates("LR_L1"), 1))


@book.add("m6_grid_search", sql(f"""
SELECT candidate_index, inner_fold, 1.0::DOUBLE AS inner_auc, params_json, 1.0::DOUBLE AS mean_inner_auc, candidate_index = 1 AS selected_best
FROM (VALUES {_GRID}) AS g(candidate_index, params_json) CROSS JOIN (SELECT DISTINCT CAST(floor(vec_id / 2) AS BIGINT) % 2 + 1 AS inner_fold FROM embeddings)""", ints="candidate_index inner_fold"))
def m6(spark, sf):
    """The whole grid; all candidates rank the planted slot, so the first one is chosen."""
    rows = materialize(m.balance_weights(labelled(spark, sf)))
    return m.grid_search(m.inner_sets(rows), rows, "LR_L1")[2]


def nested(spark, sf) -> dict[str, DataFrame]:
    """All slots, with cells missing, and the whole grids of the linear families."""
    rows = materialize(labelled(spark, sf).drop("features"))
    cell = (F.col("vec_id") * 64 + F.col("pos")) * 7919 % 1009 % 19
    long = _long(rows).withColumn("value", F.when((cell > 0) | (F.col("gene") == "planted"), F.col("value")))
    return m.oof_predict(long.select("sample_id", "gene", "value"), rows, {"LR_L1": None, "LR_ElasticNet": None})


@book.add("m7_oof_predictions", sql(f"SELECT sample_id, patient_id, outer_fold, 42 AS seed, model_name, label AS y_true, label AS y_pred FROM ({LABELLED}) CROSS JOIN (VALUES ('LR_L1'), ('LR_ElasticNet')) AS f(model_name)", ints="outer_fold seed y_true y_pred"))
def m7(spark, sf):
    return nested(spark, sf)["predictions"].drop("y_prob")


@book.add("m8_feature_summary", sql("""
SELECT f AS outer_fold, 64 AS original_gene_count, count(*) FILTER (WHERE v > 1e-12) AS retained_gene_count, least(20, count(*) FILTER (WHERE v > 1e-12)) AS selected_variable_genes
FROM (SELECT gene, f, var_samp(value) AS v FROM emb JOIN (VALUES (1), (2), (3), (4), (5)) AS held(f) ON outer_fold <> f GROUP BY 1, 2) GROUP BY 1""", ints="outer_fold original_gene_count selected_variable_genes"))
def m8(spark, sf):
    emb = view(spark, sf, "emb")
    stats = materialize(training_stats(emb, fold_ids(emb)))
    return m.feature_summary(emb.select("gene").distinct().count(), stats, select_features(stats, 20, 10, 40))


@book.add("m9_saved_model", sql(f"SELECT sample_id, label AS y_true, TRUE AS same_score FROM ({LABELLED})", ints="y_true"))
def m9(spark, sf):
    """Every sample's score by the saved and reloaded model, against the fitted one's."""
    fitted, rows = _fit(spark, sf, "LR_L1")
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    m.save_model(fitted, path)
    again = m.scores_of(LogisticRegressionModel.load(path), rows, ["sample_id"]).withColumnRenamed("y_prob", "again")
    both = m.scores_of(fitted, rows, ["sample_id"]).join(again.drop("y_true"), "sample_id")
    return both.select("sample_id", "y_true", (F.col("y_prob") == F.col("again")).alias("same_score"))


@book.add("m10_feature_weights", sql("SELECT 'e' || CAST(i AS VARCHAR) AS gene, FALSE AS selected, FALSE AS positive FROM (SELECT unnest(generate_series(0, (SELECT CAST(max(len(embedding)) AS BIGINT) - 1 FROM embeddings))) AS i) UNION ALL SELECT 'planted', TRUE, TRUE"))
def m10(spark, sf):
    """Which weights an L1 penalty leaves: the planted slot's, positive, and no other."""
    weights = m.feature_weights(_fit(spark, sf, "LR_L1")[0], GENES, spark)
    return weights.select("gene", (F.col("abs_gate_weight") > 0).alias("selected"), (F.col("gate_weight") > 0).alias("positive"))


@book.add("m11_pca2")
def m11(spark, sf):
    return m.pca2(labelled(spark, sf)).select("sample_id", "disease_label", "latent_1", "latent_2")


# Two features have principal axes in closed form: the direction of half the angle of (a - b, 2 c).
HALVES = "SELECT vec_id, list_sum(list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE))) AS u, list_sum(list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE))) AS v FROM embeddings"
AXES = f"""SELECT vec_id, u - avg(u) OVER () AS u, v - avg(v) OVER () AS v, atan2(2 * covar_pop(u, v) OVER (), var_pop(u) OVER () - var_pop(v) OVER ()) / 2 AS angle FROM ({HALVES})"""


@book.add("m11_pca2_of_halves", sql(f"""
SELECT 's' || vec_id AS sample_id, (u * cos(angle) + v * sin(angle)) * CASE WHEN greatest(cos(angle), sin(angle)) >= greatest(-cos(angle), -sin(angle)) THEN 1 ELSE -1 END AS latent_1,
  (v * cos(angle) - u * sin(angle)) * CASE WHEN greatest(cos(angle), -sin(angle)) >= greatest(-cos(angle), sin(angle)) THEN 1 ELSE -1 END AS latent_2 FROM ({AXES})""", "latent_1 latent_2"))
def m11_halves(spark, sf):
    """Both components of the sums of the first and the last 32 slots."""
    half = lambda start: F.aggregate(F.slice("x", start, 32), F.lit(0.0), lambda a, v: a + v)
    two = labelled(spark, sf).withColumn("features", array_to_vector(F.array(half(1), half(33))))
    return m.pca2(two).select("sample_id", "latent_1", "latent_2")


@book.add("m12_history", sql(f"SELECT model_name, -(p * ln(p) + (1 - p) * ln(1 - p)) AS start, TRUE AS falls FROM (SELECT avg(CAST(label AS DOUBLE)) AS p FROM ({LABELLED})) CROSS JOIN (VALUES ('LR_L1'), ('LR_ElasticNet')) AS f(model_name)", "start"))
def m12(spark, sf):
    """The objective of a linear fit starts at the entropy of its (weighted) labels and never rises."""
    parts = [m.history(_fit(spark, sf, name)[0], spark).withColumn("model_name", F.lit(name)) for name in ("LR_L1", "LR_ElasticNet")]
    steps = parts[0].union(parts[1]).groupBy("model_name").agg(F.sort_array(F.collect_list(F.struct("iteration", "objective"))).alias("h"))
    falls = F.forall(F.zip_with(F.slice("h", 2, 1000), "h", lambda b, a: b.isNull() | (b["objective"] <= a["objective"])), lambda x: x)
    return steps.select("model_name", F.col("h")[0]["objective"].alias("start"), falls.alias("falls"))


@book.add("r14_perturb_with_model", sql(f"SELECT sample_id, label AS disease_label, gene, CASE WHEN gene <> 'planted' THEN 0 WHEN label = 1 THEN -1 ELSE 1 END AS direction FROM ({LABELLED}) CROSS JOIN (SELECT 'e' || CAST(i AS VARCHAR) AS gene FROM (SELECT unnest(generate_series(0, 63)) AS i) UNION ALL SELECT 'planted')", ints="disease_label direction"))
def r14_model(spark, sf):
    """All slots against boosted trees: swapping a slot that no tree splits on changes nothing."""
    fitted, rows = _fit(spark, sf, "GBT")
    refs = ranking.class_reference(_long(rows).join(rows.select("sample_id", "disease_label"), "sample_id"))
    out = ranking.perturb_with_model(rows.select("sample_id", "disease_label", "features"), fitted, GENES, refs)
    return out.select("sample_id", "disease_label", "gene", F.signum("delta_prob").cast("int").alias("direction"))
