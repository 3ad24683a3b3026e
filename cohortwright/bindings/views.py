"""Fixture views over the driver tables, each written once and rendered for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Duck:
    @staticmethod
    def h(text: str) -> str:
        return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"

    @staticmethod
    def cross(rows: str, alias: str, cols: str) -> str:
        return f"CROSS JOIN (VALUES {rows}) AS {alias}({cols})"

    @staticmethod
    def unnest(table: str, array: str, pos: str, item: str) -> str:
        return (
            f"(SELECT t.* EXCLUDE ({array}), u.i - 1 AS {pos}, CAST(t.{array}[u.i] AS DOUBLE) AS {item} "
            f"FROM {table} t, unnest(generate_series(1, len(t.{array}))) AS u(i))"
        )

    @staticmethod
    def at(array: str, i: int) -> str:
        return f"CAST({array}[{i + 1}] AS DOUBLE)"


class Spark:
    @staticmethod
    def h(text: str) -> str:
        return f"CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT)"

    @staticmethod
    def cross(rows: str, alias: str, cols: str) -> str:
        structs = ", ".join(f"struct{r}" for r in re.findall(r"\([^()]*\)", rows))
        return f"LATERAL VIEW inline(array({structs})) {alias} AS {cols}"

    @staticmethod
    def unnest(table: str, array: str, pos: str, item: str) -> str:
        return (
            f"(SELECT t.* EXCEPT ({array}), u.{pos}, CAST(u.{item} AS DOUBLE) AS {item} "
            f"FROM {table} t LATERAL VIEW posexplode({array}) u AS {pos}, {item})"
        )

    @staticmethod
    def at(array: str, i: int) -> str:
        return f"CAST({array}[{i}] AS DOUBLE)"


def samples(d) -> str:
    """Orders as samples, customers as patients, status as sample type."""
    return f"""
SELECT row_id, patient_no, barcode, upper(replace(barcode, '.', '-')) AS sample_id,
       'TCGA-' || site || '-' || CAST(patient_no AS STRING) AS patient_id,
       code AS sample_type_code, type_text, amount,
       CASE code WHEN '01' THEN 1 WHEN '11' THEN 0 END AS disease_label,
       CASE code WHEN '01' THEN 'tumor' WHEN '11' THEN 'normal' END AS disease_label_name,
       CAST(h % 13 AS DOUBLE) / 12 AS metadata_completeness_score,
       CASE WHEN h % 11 > 0 THEN upper(replace(barcode, '.', '-')) END AS original_id,
       CASE patient_no % 2 WHEN 0 THEN 'male' ELSE 'female' END AS env_sex,
       CASE WHEN patient_no % 7 = 0 THEN NULL WHEN patient_no % 7 < 4 THEN 'early_stage' ELSE 'late_stage' END
         AS env_stage
FROM (
  SELECT o_orderkey AS row_id, o_custkey AS patient_no, o_totalprice AS amount,
         lpad(CAST(o_custkey % 100 AS STRING), 2, '0') AS site,
         CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '11' ELSE '06' END AS code,
         CASE o_orderkey % 6 WHEN 0 THEN 'Primary Tumor' WHEN 1 THEN 'Solid Tissue Normal' WHEN 2 THEN '11 - normal'
              WHEN 3 THEN ' tumor ' WHEN 4 THEN '' END AS type_text,
         'tcga.' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '.' || CAST(o_custkey AS STRING) || '.'
           || CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '11' ELSE '06' END
           || 'a' || CAST(o_orderkey AS STRING) AS barcode,
         (o_orderkey * 7919 + 13) % 1009 AS h
  FROM {{orders}}
)"""


def grp(d) -> str:
    """Embedding rows as samples of pure patients."""
    return """
SELECT vec_id, 's' || CAST(vec_id AS STRING) AS sample_id,
       'p' || CAST(CAST(floor(vec_id / 2) AS BIGINT) AS STRING) AS patient_id,
       CAST(CAST(floor(vec_id / 2) AS BIGINT) % 2 AS INT) AS disease_label,
       CAST(CAST(floor(vec_id / 2) AS BIGINT) % 5 + 1 AS INT) AS outer_fold
FROM {embeddings}"""


def emb(d) -> str:
    """Long matrix of the embeddings with some cells missing."""
    return f"""
SELECT 's' || CAST(vec_id AS STRING) AS sample_id, 'e' || CAST(pos AS STRING) AS gene,
       CASE WHEN ((vec_id * 64 + pos) * 7919) % 1009 % 19 > 0 THEN x END AS value,
       CAST(CAST(floor(vec_id / 2) AS BIGINT) % 2 AS INT) AS disease_label,
       CAST(CAST(floor(vec_id / 2) AS BIGINT) % 5 + 1 AS INT) AS outer_fold
FROM {d.unnest("{embeddings}", "embedding", "pos", "x")} AS z"""


def wide(d) -> str:
    """Embeddings as a wide matrix."""
    cols = ", ".join(f"{d.at('embedding', i)} AS e{i}" for i in range(64))
    return f"SELECT 's' || CAST(vec_id AS STRING) AS sample_id, {cols} FROM {{embeddings}}"


def expr(d) -> str:
    """Long matrix of the line items: order by part with the quantity, some cells missing."""
    return """
SELECT 's' || CAST(l_orderkey AS STRING) AS sample_id, 'g' || CAST(l_partkey AS STRING) AS gene,
       CASE WHEN (l_orderkey * 7919 + l_partkey * 104729) % 2003 % 17 > 0 THEN l_quantity END AS value
FROM {lineitem}"""


def meta(d) -> str:
    """Customers with messy clinical text."""
    return f"""
SELECT c_custkey, 'tcga.' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '.' || CAST(c_custkey AS STRING) AS barcode,
  CASE h % 7 WHEN 0 THEN 'Male' WHEN 1 THEN ' female ' WHEN 2 THEN 'F' WHEN 3 THEN 'm' WHEN 4 THEN '--'
       WHEN 5 THEN 'other' END AS gender,
  CASE h % 11 WHEN 0 THEN 'Lifelong Non-smoker' WHEN 1 THEN 'Current smoker' WHEN 2 THEN '1' WHEN 3 THEN '4'
       WHEN 4 THEN '60' WHEN 5 THEN 'not reported' WHEN 6 THEN 'reformed' WHEN 7 THEN '10' WHEN 8 THEN 'no'
       WHEN 9 THEN 'unclear' END AS smoking_status,
  CASE h % 9 WHEN 0 THEN 'Stage I' WHEN 1 THEN 'Stage IIA' WHEN 2 THEN 'stage iiib' WHEN 3 THEN 'Stage IV'
       WHEN 4 THEN '3' WHEN 5 THEN 'X' WHEN 6 THEN 'IVb2' WHEN 7 THEN '[Not Available]' END AS tumor_stage,
  CASE h % 6 WHEN 0 THEN 'Squamous cell carcinoma, NOS' WHEN 1 THEN 'Adenocarcinoma' WHEN 2 THEN 'EAC type'
       WHEN 3 THEN 'Carcinoma' WHEN 4 THEN 'unknown' END AS primary_diagnosis,
  CASE WHEN h % 5 = 0 THEN NULL ELSE r_name || '  ' || n_name END AS country,
  CASE WHEN h % 4 = 0 THEN NULL ELSE c_mktsegment END AS race,
  CASE WHEN h % 8 = 0 THEN 'bad' WHEN h % 8 = 1 THEN NULL ELSE CAST(20 + c_custkey % 60 AS STRING) END AS age,
  CASE WHEN h % 10 < 3 THEN NULL ELSE c_acctbal END AS days_to_death,
  c_mktsegment AS project_id, h
FROM (
  SELECT *, (c_custkey * 7919 + 13) % 1009 AS h
  FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
)"""


def pred(d) -> str:
    """Predictions of three models and two seeds for every event."""
    rows = ", ".join(f"('{m}', {s}, {k})" for m, k in (("alpha", 300), ("beta", 200), ("gamma", 100)) for s in (1, 2))
    return f"""
SELECT model_name, seed, outer_fold, sample_id, user_id, y_true,
       CAST(gain * y_true + 7 * ((event_id * 48271 + seed * 69621 + gain * 16807) % 2147483647 % 100) AS DOUBLE)
         / 1000 AS y_prob,
       env_sex, env_smoking, env_stage, env_hour, env_country
FROM (
  SELECT model_name, seed, gain, CAST(user_id % 5 + 1 AS INT) AS outer_fold, CAST(event_id AS STRING) AS sample_id, event_id,
         user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y_true,
         CASE user_id % 2 WHEN 0 THEN 'male' ELSE 'female' END AS env_sex,
         CASE user_id % 3 WHEN 0 THEN 'smoker' WHEN 1 THEN 'non_smoker' ELSE 'unknown' END AS env_smoking,
         CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 < 4 THEN 'early_stage' ELSE 'late_stage' END AS env_stage,
         CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS env_hour,
         CASE WHEN event_id % 1500 = 7 THEN 'rare' ELSE 'c' || CAST(user_id % 9 AS STRING) END AS env_country
  FROM {{events}} {d.cross(rows, "m", "model_name, seed, gain")}
)"""


def run_weights(d) -> str:
    """Signed weight of every part (gene) in every run; binary fractions, so that sums are exact."""
    return f"""
SELECT CAST(l_linenumber % 2 + 1 AS INT) AS seed, CAST(l_orderkey % 5 + 1 AS INT) AS outer_fold,
       'g' || CAST(l_partkey AS STRING) AS gene, CAST(round(l_discount * 100) - 4 AS DOUBLE) / 128 AS gate_weight,
       abs(CAST(round(l_discount * 100) - 4 AS DOUBLE) / 128) AS abs_gate_weight,
       CASE WHEN l_partkey % 10 = l_suppkey % 10 THEN 1 ELSE 0 END AS selected_flag
FROM {{lineitem}}"""


def attr(d) -> str:
    """Attributions of parts (genes) to orders (samples)."""
    return """
SELECT 'o' || CAST(l_orderkey AS STRING) AS sample_id, CAST(l_linenumber % 2 + 1 AS INT) AS seed,
       CAST(l_orderkey % 5 + 1 AS INT) AS outer_fold,
       CASE l_returnflag WHEN 'A' THEN 'integrated_gradients' ELSE 'gradient_x_input' END AS attribution_method,
       'g' || CAST(l_partkey AS STRING) AS gene, l_quantity - 25 AS attribution_value
FROM {lineitem}"""


def pert(d) -> str:
    """Probability changes of orders (samples) per part (gene)."""
    return f"""
SELECT 'o' || CAST(l_orderkey AS STRING) AS sample_id, CAST(l_linenumber % 2 + 1 AS INT) AS seed,
       CAST(l_orderkey % 5 + 1 AS INT) AS outer_fold, CAST(l_orderkey % 2 AS INT) AS disease_label,
       'g' || CAST(l_partkey AS STRING) AS gene, CAST(round(l_tax * 100) - 4 AS DOUBLE) / 128 AS logit_shift,
       CAST((l_orderkey * 7919 + l_partkey * 104729) % 2003 % 201 - 100 AS DOUBLE) / 1024
         AS delta_prob
FROM {{lineitem}}"""


def sample_envs(d) -> str:
    """Environments of the orders; some are missing."""
    return """
SELECT 'o' || CAST(o_orderkey AS STRING) AS sample_id, o_orderstatus AS env_status,
       CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS env_sex
FROM {orders}"""


def sets(d) -> str:
    """Parts (genes) grouped by brand and block."""
    return """
SELECT p_brand || '_' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING) AS pathway,
       'g' || CAST(p_partkey AS STRING) AS gene
FROM {part}"""


VIEWS: dict[str, Callable] = {
    f.__name__: f
    for f in (samples, grp, emb, wide, expr, meta, pred, run_weights, attr, pert, sample_envs, sets)
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A fixture view, or a driver table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    text = VIEWS[name](Spark)
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in used})


def with_views(query: str, body: str) -> str:
    """DuckDB text with the views the body names as common tables."""
    used = [n for n in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{n}\b", body, flags=re.IGNORECASE)]
    if not used:
        return query
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', lambda m: m.group(1), VIEWS[n](Duck)).strip()})" for n in used]
    return "WITH " + ",\n".join(parts) + "\n" + query
