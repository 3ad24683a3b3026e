"""Metrics, curves, calibration and robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwright.operators import metrics as m
from cohortwright.operators.cohort import histogram

from .support import OFFSET, Book, sql, to_six
from .views import view

book = Book()

RUN = ["model_name", "seed"]
METRIC_LIST = ", ".join(m.METRICS)
DIMS = ["env_sex", "env_smoking", "env_stage", "env_hour", "env_country"]


def ranked(source: str, by: str) -> str:
    """Metrics per group from window ranks over single rows."""
    return f"""
SELECT {by}, count(*) AS n_samples, sum(y_true) AS n_pos, count(*) - sum(y_true) AS n_neg,
  CASE WHEN min(y_true) < max(y_true) THEN (sum(y_true * r) - sum(y_true) * (sum(y_true) + 1) / 2)
    / (sum(y_true) * (count(*) - sum(y_true))) END AS auroc,
  CASE WHEN min(y_true) < max(y_true) THEN sum(y_true * tp / n_above) / sum(y_true) END AS auprc,
  avg((y_prob - y_true) * (y_prob - y_true)) AS brier_score,
  count(*) FILTER (WHERE y_prob < 0.5 AND y_true = 0) AS tn, count(*) FILTER (WHERE y_prob >= 0.5 AND y_true = 0) AS fp,
  count(*) FILTER (WHERE y_prob < 0.5 AND y_true = 1) AS fn, count(*) FILTER (WHERE y_prob >= 0.5 AND y_true = 1) AS tp
FROM (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_prob) + (count(*) OVER (PARTITION BY {by}, y_prob) - 1) / 2.0::DOUBLE AS r,
    CAST(sum(y_true) OVER (PARTITION BY {by} ORDER BY y_prob DESC) AS DOUBLE) AS tp,
    count(*) OVER (PARTITION BY {by} ORDER BY y_prob DESC) AS n_above
  FROM ({source})
) GROUP BY {by}"""


def metrics_sql(source: str, by: str) -> str:
    return f"""
SELECT *, CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn)
    ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS balanced_accuracy,
  coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity
FROM ({ranked(source, by)})"""


D = METRIC_LIST.replace(",", "")


@book.add("e1_confusion", sql(f"SELECT model_name, seed, tn, fp, fn, tp FROM ({ranked('SELECT * FROM pred', 'model_name, seed')})", ints="seed"))
def e1(spark, sf):
    return m.confusion(view(spark, sf, "pred"), RUN)


@book.add("e2_auroc", sql(f"SELECT model_name, seed, auroc FROM ({ranked('SELECT * FROM pred', 'model_name, seed')})", "auroc", "seed"))
def e2(spark, sf):
    return m.auroc(view(spark, sf, "pred"), RUN)


@book.add("e3_average_precision", sql(f"SELECT model_name, seed, auprc FROM ({ranked('SELECT * FROM pred', 'model_name, seed')})", "auprc", "seed"))
def e3(spark, sf):
    return m.average_precision(view(spark, sf, "pred"), RUN)


@book.add("e4_threshold_metrics", sql(f"SELECT model_name, outer_fold, tn, fp, fn, tp, balanced_accuracy, mcc, f1, sensitivity, specificity FROM ({metrics_sql('SELECT * FROM pred', 'model_name, outer_fold')})", "balanced_accuracy mcc f1 sensitivity specificity", "outer_fold"))
def e4(spark, sf):
    return m.threshold_metrics(view(spark, sf, "pred"), ["model_name", "outer_fold"])


@book.add("e5_brier", sql("SELECT model_name, seed, avg(pow(y_prob - y_true, 2)) AS brier_score FROM pred GROUP BY 1, 2", "brier_score", "seed"))
def e5(spark, sf):
    return m.brier(view(spark, sf, "pred"), RUN)


CURVE = "SELECT model_name, seed, y_prob, CAST(sum(sum(y_true)) OVER w AS DOUBLE) AS tp, CAST(sum(count(*) - sum(y_true)) OVER w AS DOUBLE) AS fp, sum(sum(y_true)) OVER (PARTITION BY model_name, seed) AS p, sum(count(*) - sum(y_true)) OVER (PARTITION BY model_name, seed) AS n FROM pred GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY model_name, seed ORDER BY y_prob DESC)"
MODELS = "SELECT DISTINCT model_name, seed FROM pred"


@book.add("e6_roc_points", sql(f"SELECT model_name, seed, y_prob AS threshold, fp / n AS fpr, tp / p AS tpr FROM ({CURVE}) UNION ALL SELECT model_name, seed, NULL, 0, 0 FROM ({MODELS})", "threshold fpr tpr", "seed"))
def e6(spark, sf):
    return m.roc_points(view(spark, sf, "pred"), RUN)


@book.add("e7_pr_points", sql(f"SELECT model_name, seed, y_prob AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM ({CURVE}) UNION ALL SELECT model_name, seed, NULL, 1, 0 FROM ({MODELS})", "threshold precision recall", "seed"))
def e7(spark, sf):
    return m.pr_points(view(spark, sf, "pred"), RUN)


def calibration_sql(by: str, bins: int, adapt: bool) -> str:
    used = f"least({bins}, count(DISTINCT y_prob))" if adapt else str(bins)
    dedupe = "SELECT DISTINCT" if adapt else "SELECT"
    keys = by.split(", ")
    same = " AND ".join(f"p.{k} = e.{k}" for k in keys)
    pick = ", ".join(f"e.{k}" for k in keys)
    return f"""
WITH sorted AS (SELECT {by}, list(y_prob ORDER BY y_prob) AS v, {used} AS q FROM pred GROUP BY {by}),
cuts AS (SELECT {by}, v, (len(v) - 1) * (i / q) AS pos FROM sorted, unnest(generate_series(0, {bins})) AS u(i) WHERE i <= q),
edges AS ({dedupe} {by}, v[CAST(floor(pos) AS BIGINT) + 1] + (v[CAST(ceil(pos) AS BIGINT) + 1] - v[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)) AS edge FROM cuts),
bins AS (SELECT {by}, edge AS lo, lead(edge) OVER (PARTITION BY {by} ORDER BY edge) AS hi, row_number() OVER (PARTITION BY {by} ORDER BY edge) - 1 AS bin FROM edges)
SELECT {pick}, e.bin, avg(p.y_prob) AS mean_predicted_probability, avg(p.y_true) AS observed_fraction, count(p.y_prob) AS samples
FROM bins e LEFT JOIN (SELECT * FROM pred) p ON {same} AND p.y_prob <= e.hi AND (p.y_prob > e.lo OR (e.bin = 0 AND p.y_prob >= e.lo))
WHERE e.hi IS NOT NULL GROUP BY ALL {"" if adapt else "HAVING count(p.y_prob) > 0"}"""


@book.add("e8_calibration", sql(calibration_sql("model_name, outer_fold", 10, True), "mean_predicted_probability observed_fraction", "outer_fold bin samples"))
def e8(spark, sf):
    return m.calibration(view(spark, sf, "pred"), ["model_name", "outer_fold"], 10)


@book.add("e9_calibration_curve", sql(calibration_sql("model_name", 8, False), "mean_predicted_probability observed_fraction", "bin samples"))
def e9(spark, sf):
    return m.calibration(view(spark, sf, "pred"), ["model_name"], 8, adapt=False)


FOLD_SQL = metrics_sql("SELECT * FROM pred", "model_name, seed, outer_fold")
POOLED_SQL = metrics_sql("SELECT * FROM pred", "model_name")
SUMMARY_SQL = f"SELECT a.*, {', '.join(f'b.{c} AS pooled_{c}' for c in (*m.METRICS, *m.COUNTS))} FROM (SELECT model_name, {', '.join(f'avg({x}) AS {x}_mean, stddev_samp({x}) AS {x}_std' for x in m.METRICS)} FROM ({FOLD_SQL}) GROUP BY 1) a JOIN ({POOLED_SQL}) b ON a.model_name = b.model_name"
SUMMARY_DOUBLES = " ".join([f"{x}_{s}" for x in m.METRICS for s in ("mean", "std")] + [f"pooled_{x}" for x in m.METRICS])


def fold_metrics(spark, sf) -> DataFrame:
    return m.binary_metrics(view(spark, sf, "pred"), ["model_name", "seed", "outer_fold"])


def _summary(spark, sf) -> DataFrame:
    return m.summarize_models(fold_metrics(spark, sf), view(spark, sf, "pred"))


@book.add("e10_fold_metrics", sql(f"SELECT model_name, seed, outer_fold, n_samples, {METRIC_LIST}, tn, fp, fn, tp FROM ({FOLD_SQL})", D, "seed outer_fold"))
def e10_folds(spark, sf):
    return fold_metrics(spark, sf)


@book.add("e10_summarize_models", sql(SUMMARY_SQL, SUMMARY_DOUBLES))
def e10(spark, sf):
    return _summary(spark, sf)


LONG_SQL = " UNION ALL ".join(
    f"SELECT model_name, 'fold_seed_mean' AS summary_type, '{x}' AS metric, avg({x}) AS value, stddev_pop({x}) AS std FROM folds GROUP BY 1 "
    f"UNION ALL SELECT model_name, 'pooled_oof', '{x}', {x}, NULL FROM pooled" for x in m.METRICS)


@book.add("e11_summary_long", sql(f"WITH folds AS ({FOLD_SQL}), pooled AS ({POOLED_SQL}) {LONG_SQL}", "value std"))
def e11(spark, sf):
    return m.summary_long(fold_metrics(spark, sf), view(spark, sf, "pred"))


def levels_sql(by: str, missing: str, column: str, level: str) -> str:
    return " UNION ALL ".join(f"SELECT {by}, y_true, y_prob, '{d}' AS {column}, coalesce({d}, '{missing}') AS {level} FROM pred" for d in DIMS)


def masked(source: str, by: str, usable: str, status: str) -> str:
    return f"SELECT {by}, n_samples, {status} AS status, {', '.join(f'CASE WHEN {usable} THEN {c} END AS {c}' for c in (*m.METRICS, *m.COUNTS))} FROM ({source})"


SUB_KEYS = "model_name, seed, subgroup_name, subgroup_value"
SUB_OK = "n_samples >= 10 AND n_pos >= 3 AND n_neg >= 3"
SUB_SQL = masked(metrics_sql(levels_sql("model_name, seed", "unknown", "subgroup_name", "subgroup_value"), SUB_KEYS), SUB_KEYS, SUB_OK, f"CASE WHEN {SUB_OK} THEN 'ok' ELSE 'too_small' END")


@book.add("e12_subgroup_metrics", sql(SUB_SQL, D, "seed"))
def e12(spark, sf):
    return m.subgroup_metrics(view(spark, sf, "pred"), DIMS)


@book.add("e12_subgroup_alternatives", sql(SUB_SQL.replace("'env_sex' AS", "'sex' AS").replace("'env_stage' AS", "'stage' AS").replace("'env_smoking' AS", "'smoking' AS").replace("'env_hour' AS", "'hour' AS").replace("'env_country' AS", "'country_or_region' AS"), D, "seed"))
def e12_alternatives(spark, sf):
    """Subgroups by the first of several column names that the table has; a subgroup without any is left out."""
    dims = dict(m.SUBGROUPS) | {"hour": ("hour_raw", "env_hour"), "country_or_region": ("country", "env_country", "env_sex")}
    return m.subgroup_metrics(view(spark, sf, "pred"), dims)


ENV_KEYS = "seed, outer_fold, environment_column, environment_level"
ENV_OK = "n_samples >= 5 AND n_pos > 0 AND n_neg > 0"
ENV_SQL = masked(metrics_sql(levels_sql("seed, outer_fold", "Unknown", "environment_column", "environment_level"), ENV_KEYS), ENV_KEYS, ENV_OK, f"CASE WHEN {ENV_OK} THEN 'evaluated' ELSE 'skipped_small' END")


def _env(spark, sf, dims=tuple(DIMS)):
    return m.environment_metrics(view(spark, sf, "pred"), list(dims))


@book.add("e13_environment_metrics", sql(f"{ENV_SQL} UNION ALL SELECT DISTINCT seed, outer_fold, 'env_site', 'missing', 0, 'missing', {', '.join('NULL' for _ in (*m.METRICS, *m.COUNTS))} FROM pred", D, "seed outer_fold"))
def e13(spark, sf):
    return _env(spark, sf, (*DIMS, "env_site"))


@book.add("e14_invariance_summary", sql(f"SELECT seed, outer_fold, environment_column, count(auroc) AS n_levels, var_pop(balanced_accuracy) AS environment_risk_variance, max(auroc) - min(auroc) AS environment_auroc_spread FROM ({ENV_SQL}) GROUP BY 1, 2, 3 HAVING count(auroc) >= 2", "environment_risk_variance environment_auroc_spread", "seed outer_fold"))
def e14(spark, sf):
    return m.invariance_summary(_env(spark, sf))


LOSS = "CASE WHEN y_true = 1 THEN -ln(least(greatest(y_prob, 1e-15), 1 - 1e-15)) ELSE -ln(1 - least(greatest(y_prob, 1e-15), 1 - 1e-15)) END"
RISK = f"""SELECT model_name, environment_column, sum(n) AS n_coded, count(*) FILTER (WHERE n >= 2) AS n_levels,
  CASE WHEN sum(n) >= 4 AND count(*) FILTER (WHERE n >= 2) >= 2 THEN var_pop(l) FILTER (WHERE n >= 2) END AS risk_variance
FROM (SELECT model_name, environment_column, level, avg({LOSS}) AS l, count(*) AS n
  FROM ({levels_sql('model_name', 'unknown', 'environment_column', 'level')}) WHERE level <> 'unknown' GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@book.add("e15_risk_variance", sql(f"WITH r AS ({RISK}) SELECT * FROM r UNION ALL SELECT model_name, 'all', sum(n_coded), sum(n_levels), avg(risk_variance) FROM r GROUP BY 1", "risk_variance", "n_coded n_levels"))
def e15(spark, sf):
    return m.risk_variance(view(spark, sf, "pred"), DIMS, ["model_name"])


@book.add("e16_pick_winners", sql(f"""WITH s AS ({SUMMARY_SQL}) SELECT
  (SELECT model_name FROM s ORDER BY auroc_mean DESC, auprc_mean DESC, balanced_accuracy_mean DESC, mcc_mean DESC, brier_score_mean, model_name LIMIT 1) AS best_baseline,
  (SELECT model_name FROM s ORDER BY brier_score_mean, auroc_mean DESC, model_name LIMIT 1) AS best_calibrated,
  (SELECT model_name FROM s ORDER BY auroc_std + auprc_std, auroc_mean DESC, model_name LIMIT 1) AS most_stable"""))
def e16(spark, sf):
    return m.pick_winners(_summary(spark, sf))


@book.add("e17_compare", sql(f"""WITH b AS ({metrics_sql("SELECT * FROM pred WHERE model_name <> 'gamma'", 'model_name')}), c AS ({metrics_sql("SELECT * FROM pred WHERE model_name = 'gamma'", 'model_name')}),
top AS (SELECT * FROM b ORDER BY auroc DESC, auprc DESC, balanced_accuracy DESC, mcc DESC, model_name LIMIT 1)
SELECT model_name, 'baseline' AS model_family, {METRIC_LIST}, 0 AS delta_vs_best_baseline_auroc FROM top
UNION ALL SELECT model_name, 'candidate', {METRIC_LIST}, auroc - (SELECT auroc FROM top) FROM c""", D + " delta_vs_best_baseline_auroc"))
def e17(spark, sf):
    p = view(spark, sf, "pred")
    base, cand = p.filter("model_name <> 'gamma'"), p.filter("model_name = 'gamma'")
    keys = ["model_name", "seed", "outer_fold"]
    return m.compare(m.summarize_models(m.binary_metrics(base, keys), base), m.summary_long(m.binary_metrics(cand, keys), cand))


@book.add("e18_top_models", sql(f"SELECT model_name FROM ({SUMMARY_SQL}) ORDER BY auroc_mean DESC, auprc_mean DESC, model_name LIMIT 2"))
def e18(spark, sf):
    return m.top_models(_summary(spark, sf), 2)


@book.add("e18_top_calibration", sql(f"SELECT model_name, mean_predicted_probability, avg(observed_fraction) AS observed_fraction FROM (SELECT model_name, floor(mean_predicted_probability * 1e6 + {OFFSET}) / 1e6 AS mean_predicted_probability, observed_fraction FROM ({calibration_sql('model_name, outer_fold', 10, True)})) WHERE model_name IN (SELECT model_name FROM ({SUMMARY_SQL}) ORDER BY auroc_mean DESC, auprc_mean DESC, model_name LIMIT 2) AND mean_predicted_probability IS NOT NULL GROUP BY 1, 2", "mean_predicted_probability observed_fraction"))
def e18_calibration(spark, sf):
    bins = m.calibration(view(spark, sf, "pred"), ["model_name", "outer_fold"], 10)
    rounded = bins.withColumn("mean_predicted_probability", to_six(F.col("mean_predicted_probability")))
    return m.top_calibration(rounded, _summary(spark, sf), 2)


@book.add("e18_top_subgroups", sql(f"WITH s AS (SELECT * FROM ({SUB_SQL}) WHERE status = 'ok') SELECT model_name, subgroup_name, subgroup_value, avg(auroc) AS auroc FROM s WHERE model_name IN (SELECT model_name FROM s GROUP BY 1 ORDER BY avg(auroc) DESC, model_name LIMIT 2) GROUP BY 1, 2, 3", "auroc"))
def e18_subgroups(spark, sf):
    return m.top_subgroups(m.subgroup_metrics(view(spark, sf, "pred"), DIMS), 2)


@book.add("e19_env_mean", sql(f"SELECT environment_column, avg(balanced_accuracy) AS balanced_accuracy FROM ({ENV_SQL}) WHERE status = 'evaluated' GROUP BY 1", "balanced_accuracy"))
def e19(spark, sf):
    return m.env_mean(_env(spark, sf))


@book.add("e19_top_weights", sql("SELECT gene, avg(abs_gate_weight) AS abs_gate_weight FROM run_weights GROUP BY 1 ORDER BY avg(abs_gate_weight) DESC, gene LIMIT 20", "abs_gate_weight"))
def e19_weights(spark, sf):
    return m.top_weights(view(spark, sf, "run_weights"), 20)


@book.add("e19_weight_histogram", sql("""
SELECT b AS bin, lo + b * w AS bin_start, lo + (b + 1) * w AS bin_end, count(v) AS n
FROM (SELECT min(gate_weight) AS lo, (max(gate_weight) - min(gate_weight)) / 30 AS w FROM run_weights)
CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS b)
LEFT JOIN (SELECT gate_weight AS v FROM run_weights) ON least(floor((v - lo) / w), 29) = b GROUP BY b, lo, w""", "bin_start bin_end", "bin"))
def e19_histogram(spark, sf):
    return histogram(view(spark, sf, "run_weights"), "gate_weight", 30)
