"""pyspark.ml classifiers, grouped search, out-of-fold predictions and their side products.

The loops over seeds, folds and candidates run on the driver and only launch Spark jobs; every fit
and every prediction is distributed. Results of single fits are appended to tables in the scratch
folder, so plans do not grow with the number of fits.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distributed import discard, lookup_join, materialize, scratch_root
from .folds import inner_folds
from .metrics import auroc
from .prepare import fit_prep, fold_ids, select_features, training_medians
from .selection import exact_quantiles

# The candidate grids of each model family.
GRIDS: dict[str, dict[str, list]] = {
    "LR_L1": {"C": [0.01, 0.1, 1.0, 5.0], "class_weight": [None, "balanced"]},
    "LR_ElasticNet": {
        "C": [0.01, 0.1, 1.0, 5.0], "l1_ratio": [0.2, 0.5, 0.8], "class_weight": [None, "balanced"],
    },
    "RandomForest": {
        "n_estimators": [300, 500], "max_depth": [None, 8, 16], "min_samples_split": [2, 5],
        "class_weight": [None, "balanced"],
    },
    "GBT": {"learning_rate": [0.03, 0.1], "max_depth": [3, 5], "n_estimators": [200, 400], "subsample": [0.8, 1.0]},
    "MLP": {"hidden_layer_sizes": [(64,), (128,), (64, 32)]},
}
DEFAULT_MODELS = ("LR_L1", "LR_ElasticNet", "RandomForest", "GBT")
UNLIMITED_DEPTH = 30
# Sums over many rows leave a pure leaf a variance of rounding (about 1e-13 of targets of size 1): no ground for a split.
ROUNDING_GAIN = 1e-9
DRIVER_THREADS = 4


def candidates(name: str, grid: Mapping[str, Sequence] | None = None) -> list[dict]:
    """All combinations of a grid, parameter names in sorted order, last one varying fastest."""
    grid = dict(grid or GRIDS[name])
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


def model(name: str, params: Mapping, n: float, n_features: int, seed: int = 42, label: str = "label") -> Estimator:
    """Estimator of a family; ``n`` is the training size, which sets the penalty per row.

    Balanced class weights come from a column ``weight`` that sums to ``n``.
    """
    common = {"featuresCol": "features", "labelCol": label}
    if params.get("class_weight") == "balanced":
        common["weightCol"] = "weight"
    if name in ("LR_L1", "LR_ElasticNet"):
        mix = 1.0 if name == "LR_L1" else float(params["l1_ratio"])
        return LogisticRegression(
            regParam=1.0 / (float(params["C"]) * n), elasticNetParam=mix, standardization=False,
            maxIter=int(params.get("max_iter", 200)), **common,
        )
    if name == "RandomForest":
        return RandomForestClassifier(
            numTrees=int(params["n_estimators"]), maxDepth=int(params.get("max_depth") or UNLIMITED_DEPTH),
            minInstancesPerNode=max(1, int(params.get("min_samples_split", 2)) // 2),
            featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, **common,
        )
    if name == "GBT":
        return GBTClassifier(
            stepSize=float(params["learning_rate"]), maxDepth=int(params["max_depth"]),
            maxIter=int(params["n_estimators"]), subsamplingRate=float(params["subsample"]), minInfoGain=ROUNDING_GAIN, seed=seed, **common,
        )
    if name == "MLP":
        layers = [n_features, *[int(h) for h in params["hidden_layer_sizes"]], 2]
        return MultilayerPerceptronClassifier(
            layers=layers, maxIter=int(params.get("max_iter", 400)), seed=seed, **common
        )
    raise ValueError(f"Unknown model '{name}'")


def assemble_raw(long: DataFrame, genes: Sequence[str], keep: Sequence[str] = ("sample_id",), name: str = "values") -> DataFrame:
    """Values of the selected genes as one array per sample, in their given order, missing ones null."""
    slots = long.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, _slot int")
    # The list of selected genes sits on the driver and is capped by the selection, so it may be broadcast.
    rows = long.join(F.broadcast(slots), "gene").groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("_slot", "value"))).alias("_cells"))
    return rows.withColumn(name, F.transform("_cells", lambda c: c["value"])).drop("_cells")


def assemble(long: DataFrame, genes: Sequence[str], keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Feature vectors of the selected genes, in their given order; a sample has at most one row per gene."""
    return assemble_raw(long, genes, keep, "_values").withColumn("features", array_to_vector("_values")).drop("_values")


def balance_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Row weights ``n / (classes * class size)``, which sum to ``n``."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(sizes.values())
    table = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, n / (len(sizes) * v))])
    return df.withColumn("weight", table[F.col(label)])


def scores_of(fitted: Model, df: DataFrame, keep: Sequence[str], label: str = "label") -> DataFrame:
    return fitted.transform(df).select(
        *keep, F.col(label).cast("int").alias("y_true"), vector_to_array("probability")[1].alias("y_prob")
    )


def as_candidates(name: str, grid: Mapping[str, Sequence] | Sequence[dict] | None) -> list[dict]:
    return list(grid) if grid is not None and not isinstance(grid, Mapping) else candidates(name, grid)


def choose(scored: DataFrame, grid: Sequence[dict]) -> tuple[int, DataFrame]:
    """Position of the best candidate and the search log, from scored rows of all inner fits.

    A candidate's score is its mean AUROC over inner folds, 0.5 for a fold with one class; the first
    best wins.
    """
    texts = F.create_map(*[x for i, p in enumerate(grid) for x in (F.lit(i + 1), F.lit(json.dumps(p, sort_keys=True)))])
    per_fold = materialize(
        auroc(scored, ["candidate_index", "inner_fold"]).select(
            "candidate_index", "inner_fold", F.coalesce("auroc", F.lit(0.5)).alias("inner_auc"),
            texts[F.col("candidate_index")].alias("params_json"),
        )
    )
    means = per_fold.groupBy("candidate_index").agg(F.avg("inner_auc").alias("mean_inner_auc"))
    best = means.orderBy(F.desc("mean_inner_auc"), "candidate_index").first()["candidate_index"]
    log = per_fold.join(means, "candidate_index").withColumn("selected_best", F.col("candidate_index") == best)
    return best - 1, log


def _param_map(base: Estimator, wanted: Estimator) -> dict:
    """What ``wanted`` sets, as parameters of ``base``."""
    return {base.getParam(p.name): v for p, v in wanted.extractParamMap().items() if wanted.isSet(p)}


def grid_search(
    inner_sets: Mapping[int, tuple[DataFrame, DataFrame]], train: DataFrame, name: str,
    grid: Mapping[str, Sequence] | Sequence[dict] | None = None, seed: int = 42, label: str = "label",
) -> tuple[Model, dict, DataFrame]:
    """Search over inner folds, then refit on ``train``; returns model, parameters and search log.

    ``inner_sets`` gives the prepared (train, validation) rows of each inner fold, views of one shared table
    (see ``inner_sets`` and ``strict_sets``). All tables hold ``features`` and the label, the training ones
    also ``weight``. The candidates of a fold are fitted by ``fitMultiple``, a few at a time, and all of them score
    the fold's validation rows in one pass.
    """
    spark = train.sparkSession
    grid = as_candidates(name, grid)
    width = len(train.first()["features"])
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    for fold, (fit, valid) in inner_sets.items():
        # Stored once: each candidate's fit passes over it twice, and would work out prepared vectors again each time.
        fit = materialize(fit.select("features", label, "weight"))
        size = fit.count()
        base = model(name, {k: v for k, v in grid[0].items() if k != "class_weight"}, size, width, seed, label)
        maps = [_param_map(base, model(name, params, size, width, seed, label)) for params in grid]
        fits = base.fitMultiple(fit, maps)
        with ThreadPoolExecutor(DRIVER_THREADS) as pool:
            fitted = dict(pool.map(lambda _: next(fits), grid))
        scored, columns = valid.select(F.col(label).cast("int").alias("y_true"), "features"), []
        for i in range(len(grid)):
            one = fitted[i]
            one.setProbabilityCol(f"p{i}").setRawPredictionCol(f"r{i}").setPredictionCol(f"y{i}")
            scored = one.transform(scored).drop(f"r{i}", f"y{i}")
            columns.append(F.struct(F.lit(i + 1).alias("candidate_index"), vector_to_array(f"p{i}")[1].alias("y_prob")))
        rows = scored.select("y_true", F.explode(F.array(*columns)).alias("c")).select("y_true", "c.*")
        # A folder per fold: concurrent searches must not commit into the same one.
        rows.withColumn("inner_fold", F.lit(fold)).write.parquet(f"{path}/fold_{fold}")
        discard(fit)
    best, log = choose(spark.read.parquet(f"{path}/fold_*"), grid)
    return model(name, grid[best], train.count(), width, seed, label).fit(train), grid[best], log


def inner_weights(df: DataFrame, inner: str = "inner_fold", label: str = "label") -> dict[int, Column]:
    """For every inner fold, the balanced weights of the other folds' rows, from one count by fold and label."""
    counts = [tuple(r) for r in df.groupBy(inner, label).count().collect()]
    out = {}
    for fold in sorted({f for f, _, _ in counts if f is not None}):
        sizes: dict[float, int] = {}
        for f, value, n in counts:
            if f is not None and f != fold:
                sizes[value] = sizes.get(value, 0) + n
        n = sum(sizes.values())
        out[fold] = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, n / (len(sizes) * v))])[F.col(label)]
    return out


def inner_sets(
    df: DataFrame, inner: str = "inner_fold", features: Mapping[int, Column] | None = None, label: str = "label"
) -> dict[int, tuple[DataFrame, DataFrame]]:
    """(train, validation) rows of each inner fold, all views of ``df``, which the caller stores or caches once.

    ``features``: for each held-out inner fold how its vectors come from a row; as they are by default.
    """
    out = {}
    for fold, weight in inner_weights(df, inner, label).items():
        rows = df if features is None else df.withColumn("features", features[fold])
        out[fold] = (rows.filter(F.col(inner) != fold).withColumn("weight", weight), rows.filter(F.col(inner) == fold))
    return out


def feature_weights(fitted: Model, genes: Sequence[str], spark) -> DataFrame:
    """Coefficients of a linear model as rows; there is one per selected gene."""
    rows = [(g, float(w), abs(float(w))) for g, w in zip(genes, fitted.coefficients.toArray())]
    return spark.createDataFrame(rows, "gene string, gate_weight double, abs_gate_weight double")


def flag_top(df: DataFrame, q: float = 0.9, by: Sequence[str] = ("seed", "outer_fold")) -> DataFrame:
    """Flag weights at or above the run's ``q`` quantile of absolute weights."""
    limits = exact_quantiles(df, by, "abs_gate_weight", {"_limit": q})
    return lookup_join(df, limits, list(by)).withColumn(
        "selected_flag", (F.col("abs_gate_weight") >= F.col("_limit")).cast("int")
    ).drop("_limit")


def sparsity_share(df: DataFrame, below: float = 0.1, by: Sequence[str] = ("seed", "outer_fold")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("abs_gate_weight") < below).cast("int")).alias("gate_sparsity_fraction"))


def history(fitted: Model, spark) -> DataFrame:
    """Objective by iteration of a fitted linear model."""
    rows = [(i, float(v)) for i, v in enumerate(fitted.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration int, objective double")


def pca2(df: DataFrame, features: str = "features") -> DataFrame:
    """Two principal components of the centred features; each component's largest loading is positive."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df).transform(df)
    fitted = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(centred)
    loadings = fitted.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    xy = vector_to_array("_pc")
    return fitted.transform(centred).withColumns(
        {f"latent_{j + 1}": xy[j] * F.lit(signs[j]) for j in range(2)}
    ).drop("_centred", "_pc")


def save_model(fitted: Model, path: str) -> None:
    fitted.write().overwrite().save(path)


def feature_summary(original: int, stats: DataFrame, selected: DataFrame) -> DataFrame:
    """Genes offered, varying in training, and selected, per held-out fold."""
    varying = stats.groupBy("outer_fold").agg(F.count_if(F.col("variance") > 1e-12).alias("retained_gene_count"))
    chosen = selected.groupBy("outer_fold").agg(F.count("*").alias("selected_variable_genes"))
    return varying.join(chosen, "outer_fold", "left").select(
        "outer_fold", F.lit(original).cast("bigint").alias("original_gene_count"), "retained_gene_count",
        F.coalesce("selected_variable_genes", F.lit(0)).alias("selected_variable_genes"),
    )


PREDICTIONS = ("sample_id", "patient_id", "outer_fold", "seed", "model_name", "y_true", "y_prob", "y_pred")


def oof_predict(
    long: DataFrame, cohort: DataFrame, models: Mapping[str, Mapping | Sequence[dict] | None],
    seeds: Sequence[int] = (42,), inner_k: int = 3, top: int = 5000, least: int = 1000, most: int = 8000,
    save_to: str | None = None, inner_strict: bool = True,
) -> dict[str, DataFrame]:
    """Nested grouped cross-validation: out-of-fold predictions of every seed, fold and model.

    ``long`` is ``(sample_id, gene, value)`` and ``cohort`` ``(sample_id, patient_id, disease_label,
    outer_fold)``. Feature choice, imputation and scaling use training rows only; with
    ``inner_strict`` they are also refit inside every inner fold, so that inner scores never see
    statistics of their validation rows. ``models`` maps a family to its grid (``None``: the default).
    Returns predictions, search log, feature summary, linear weights with intercepts, and history.
    """
    spark = long.sparkSession
    keys = ["sample_id", "patient_id", "disease_label", "outer_fold"]
    rows = materialize(long.select("sample_id", "gene", "value").join(cohort.select(*keys), "sample_id"))
    folds = fold_ids(cohort)
    n_genes = long.select("gene").distinct().count()
    # The preparation of a fold is shared by its seeds and models.
    stats = materialize(fit_prep(rows, folds))
    chosen = materialize(select_features(stats, top, least, most).select("outer_fold", "gene", "rank", "retained"))
    root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"

    def keep(df: DataFrame, table: str, *parts: object) -> None:
        # A folder per fit: concurrent jobs must not commit into the same one.
        df.write.parquet("/".join([root, table, "_".join(["fit", *map(str, parts)])]))

    def one_fold(fold: int) -> bool:
        mine = chosen.filter(F.col("outer_fold") == fold)
        genes = [r["gene"] for r in mine.orderBy("rank").select("gene").collect()]
        # At most ``most`` selected genes, whose statistics are literals; every fit reads the same stored vectors.
        fitted_on = {
            r["gene"]: r for r in stats.filter(F.col("outer_fold") == fold).join(mine.select("gene"), "gene", "left_semi").collect()
        }
        prep = Prep(*[np.array([_number(fitted_on[g][c]) for g in genes]) for c in ("median", "mean_imputed", "std_imputed")])
        values = materialize(assemble_raw(rows, genes, keys).withColumn("label", F.col("disease_label").cast("double")))
        vectors = values.withColumn("features", prep.features("values"))
        train, test = vectors.filter(F.col("outer_fold") != fold), vectors.filter(F.col("outer_fold") == fold)
        weighted = balance_weights(train)
        linear = False
        for seed in seeds:
            others = cohort.filter(F.col("outer_fold") != fold)
            inner = materialize(inner_folds(others, [fold], inner_k, seed).select("patient_id", "inner_fold"))
            shared = vectors.filter(F.col("outer_fold") != fold).join(inner, "patient_id").persist()
            features = None
            if inner_strict:
                others_rows = rows.filter(F.col("outer_fold") != fold).join(inner, "patient_id")
                features = {f: p.features("values") for f, p in inner_preps(shared, others_rows, genes).items()}
            sets = inner_sets(shared, features=features)
            for name, grid in models.items():
                fitted, params, log = grid_search(sets, weighted, name, grid, seed)
                tags = {"seed": F.lit(seed), "model_name": F.lit(name)}
                scored = scores_of(fitted, test, ["sample_id", "patient_id", "outer_fold"]).withColumns(tags)
                scored = scored.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
                keep(scored.select(*PREDICTIONS), "predictions", fold, seed, name)
                tags["outer_fold"] = F.lit(fold)
                best = F.lit(json.dumps(params, sort_keys=True))
                keep(log.withColumns(tags | {"best_params_json": best}), "log", fold, seed, name)
                if hasattr(fitted, "coefficients"):
                    linear = True
                    intercept = F.lit(float(fitted.intercept))
                    weights = feature_weights(fitted, genes, spark).withColumns(tags | {"intercept": intercept})
                    keep(weights, "weights", fold, seed, name)
                    keep(history(fitted, spark).withColumns(tags), "history", fold, seed, name)
                if save_to:
                    save_model(fitted, f"{save_to}/{name}_seed_{seed}_outer_fold_{fold}")
            shared.unpersist()
        return linear

    # Folds are independent: running a few at once keeps the cluster busy between small fitting jobs.
    with ThreadPoolExecutor(DRIVER_THREADS) as pool:
        linear = any(list(pool.map(one_fold, folds)))
    names = ("predictions", "log", "weights", "history") if linear else ("predictions", "log")
    tables = {name: spark.read.parquet(f"{root}/{name}/fit_*") for name in names}
    tables["feature_summary"] = feature_summary(n_genes, stats, chosen)
    tables["prep"] = stats
    return tables


def _number(value: float | None) -> float:
    return np.nan if value is None else float(value)


def _literal(values: np.ndarray) -> Column:
    """A literal array of doubles; NaN stays NaN."""
    return F.split(F.lit(",".join(repr(float(v)).replace("nan", "NaN") for v in values)), ",").cast("array<double>")


@dataclass(frozen=True)
class Prep:
    """Fill, shift and width of each selected gene."""

    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def features(self, values: str) -> Column:
        """The vector of an array of values: missing ones filled, then standardized (a constant gene is only shifted)."""
        width = np.where((self.std > 0), self.std, 1.0)
        fill, shift, scale = (_literal(x) for x in (self.median, self.mean, width))
        return array_to_vector(F.transform(values, lambda x, i: (F.coalesce(x, F.get(fill, i)) - F.get(shift, i)) / F.get(scale, i)))


def inner_preps(shared: DataFrame, long: DataFrame, genes: Sequence[str]) -> dict[int, Prep]:
    """Preparation for every held-out inner fold, from the rows of the other inner folds.

    Counts, sums and squares of each fold come from one vector aggregate over the stored arrays; a training part is the total
    minus its fold, so no row is copied per fold. Values are first shifted by the overall mean, which keeps the
    squares exact enough. Medians are needed only for genes with missing values, and selected from ``long`` for those.
    """
    observed = lambda f: F.transform("values", f)
    whole = shared.select(_vector_sums(observed(lambda x: F.coalesce(x, F.lit(0.0)))).alias("s"), _vector_sums(observed(_is_there)).alias("n")).first()
    n_all = whole["n"]["sum"].toArray()
    center = np.divide(whole["s"]["sum"].toArray(), n_all, out=np.zeros(len(genes)), where=n_all > 0)
    middle = _literal(center)
    off = F.transform("values", lambda x, i: F.coalesce(x - F.get(middle, i), F.lit(0.0)))
    rows = shared.groupBy("inner_fold").agg(
        F.count("*").alias("rows"), _vector_sums(off).alias("d"), _vector_sums(F.transform(off, lambda x: x * x)).alias("q"), _vector_sums(observed(_is_there)).alias("n")
    ).collect()  # one row per inner fold, of as many numbers as genes are selected
    parts = {r["inner_fold"]: (r["rows"], *[r[c]["sum"].toArray() for c in ("n", "d", "q")]) for r in rows}
    held = sorted(parts)
    total = [sum(parts[f][i] for f in held) for i in range(4)]
    medians = {f: np.full(len(genes), np.nan) for f in held}
    lacking = [g for g, n in zip(genes, total[1]) if n < total[0]]
    if lacking:
        slot = {g: i for i, g in enumerate(genes)}
        wanted = long.sparkSession.createDataFrame([(g,) for g in lacking], "gene string")
        found = training_medians(long.join(F.broadcast(wanted), "gene", "left_semi"), held, "inner_fold")
        for r in found.collect():  # at most as many as genes are selected, for each inner fold
            medians[r["outer_fold"]][slot[r["gene"]]] = _number(r["median"])
    out = {}
    for f in held:
        n_rows, n, d, q = (t - p for t, p in zip(total, parts[f]))
        missing = n_rows - n
        fill = np.where(missing > 0, np.nan_to_num(medians[f] - center), 0.0)
        mean = (d + missing * fill) / n_rows
        spread = np.maximum((q + missing * fill**2) / n_rows - mean**2, 0.0)
        # A constant gene has no spread but for rounding.
        std = np.where(spread > 1e-13 * np.maximum(center**2, np.maximum(q / np.maximum(n, 1), 1e-300)), np.sqrt(spread), 0.0)
        out[f] = Prep(np.where(np.isnan(medians[f]), center, medians[f]), mean + center, std)
    return out


def _is_there(x: Column) -> Column:
    return F.when(x.isNull(), 0.0).otherwise(1.0)


def _vector_sums(values: Column) -> Column:
    return Summarizer.metrics("sum").summary(array_to_vector(values))
