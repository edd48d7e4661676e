"""Out-of-fold models on window features, and their recording-level scores.

The driver loops over folds (a handful); every fit and prediction runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from waveledger.functions import scalars as sc
from waveledger.operators import forest, kernel, knn, metrics, scaling, splits, voting
from waveledger.sources.tables import staged

Fit = Callable[[DataFrame], Model]

#: The deepest trees Spark grows; the usual forests have no limit.
MAX_DEPTH = 30


def assemble(rows: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector with missing values as 0."""
    filled = rows.withColumns({f: sc.fill_missing(f) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(filled)


def training_weights(train: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Recording-equalised weight, times the balanced class weight when `label` is given."""
    out = splits.group_weights(train, key, "_gw")
    if label is None:
        return out.withColumnRenamed("_gw", "weight")
    out = splits.class_weights(out, label, "_cw")
    return out.withColumn("weight", F.col("_gw") * F.col("_cw")).drop("_gw", "_cw")


def forest_classifier(label: str, trees: int = 500, seed: int = 42, min_leaf: int = 1,
                      depth: int = MAX_DEPTH) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, seed=seed,
        minInstancesPerNode=min_leaf, maxDepth=depth, featureSubsetStrategy="sqrt")


def forest_regressor(label: str, trees: int = 500, seed: int = 42,
                     depth: int = MAX_DEPTH) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, seed=seed,
        maxDepth=depth, featureSubsetStrategy="all")


def out_of_fold(rows: DataFrame, folds: Sequence, fit: Callable[[DataFrame, int], Model],
                fold: str = "fold", parallel: int = 8) -> DataFrame:
    """Fit on everything outside a fold, predict the fold, for each fold; union of all.

    `rows` should be a staged table: it is read once per fold and model pass.
    """
    def one(item: tuple[int, object]) -> DataFrame:
        position, f = item
        model = fit(rows.where(F.col(fold) != F.lit(f)), position)
        return model.transform(rows.where(F.col(fold) == F.lit(f)))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        parts = list(pool.map(one, enumerate(folds)))
    return reduce(DataFrame.unionByName, parts)


def forest_oof(rows: DataFrame, folds: Sequence, key: str, label: str, n_classes: int,
               trees: int, seed: int = 42, depth: int = MAX_DEPTH, min_leaf: int = 1) -> DataFrame:
    """Classifier predictions of held-out windows; adds `probabilities` and `prediction`."""
    numbered, few = _numbered(rows)
    if few:
        votes = forest.out_of_fold_votes(numbered, folds, key, label, n_classes, trees,
                                         _sqrt(numbered), depth, min_leaf, seed)
        top = F.array_position("probabilities", F.array_max("probabilities")) - 1
        return numbered.join(votes.withColumnRenamed("votes", "probabilities"), "_row").drop("_row").withColumn(
            "prediction", top.cast("double"))

    def fit(train: DataFrame, position: int) -> Model:
        # Declare all classes, also those absent from this training set.
        weighted = _with_classes(training_weights(train, key, label), label, n_classes)
        return _fit_kept(forest_classifier(label, trees, seed + position + 1, min_leaf, depth),
                         weighted.select("features", label, "weight"))

    out = out_of_fold(numbered.drop("_row"), folds, fit)
    return out.withColumn("probabilities", vector_to_array("probability"))


def _numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows, written with a number each, and whether they are few enough to be dealt whole to tasks."""
    out = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
    return out, 0 < out.count() <= forest.MOST


def _n_features(rows: DataFrame) -> int:
    return len(rows.select("features").first().features)


def _sqrt(rows: DataFrame) -> int:
    return math.ceil(math.sqrt(_n_features(rows)))


def _fit_kept(estimator, train: DataFrame) -> Model:
    """Fit on a kept copy: a fit passes over its input several times."""
    kept = train.persist()
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def _with_classes(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    meta = {"ml_attr": {"type": "nominal", "name": label,
                        "vals": [str(i) for i in range(n_classes)]}}
    return df.withMetadata(label, meta)


def forest_regression_oof(rows: DataFrame, folds: Sequence, key: str, target: str,
                          trees: int, seed: int = 42, depth: int = MAX_DEPTH) -> DataFrame:
    numbered, few = _numbered(rows)
    if few:
        votes = forest.out_of_fold_votes(numbered, folds, key, target, 0, trees, _n_features(numbered), depth, 1, seed)
        return numbered.join(votes.select("_row", F.get("votes", F.lit(0)).alias("prediction")), "_row").drop("_row")

    def fit(train: DataFrame, position: int) -> Model:
        return _fit_kept(forest_regressor(target, trees, seed + position + 1, depth),
                         training_weights(train, key).select("features", target, "weight"))

    return out_of_fold(numbered.drop("_row"), folds, fit)


def recording_predictions(oof: DataFrame, key: str, label: str, n_classes: int) -> DataFrame:
    """Soft vote over the windows of each held-out recording."""
    return voting.soft_vote(oof, ["fold", key, label], "probabilities",
                            [float(i) for i in range(n_classes)])


def fold_metrics(recordings: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    return metrics.class_metrics(
        recordings.withColumn("_t", F.col(label).cast("double")), "_t", predicted, ["fold"])


def feature_importance(model: Model, spark, features: Sequence[str], top: int = 8) -> DataFrame:
    """The `top` features of a fitted forest (one value per feature, so small)."""
    values = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top)


def forest_importance(rows: DataFrame, label: str, n_classes: int, features: Sequence[str], trees: int = 500,
                      seed: int = 42, top: int = 8, depth: int = MAX_DEPTH) -> DataFrame:
    """The `top` features of a forest over all rows, which count alike."""
    if rows.count() > forest.MOST:
        model = forest_classifier(label, trees, seed, depth=depth).fit(rows.withColumn("weight", F.lit(1.0)))
        return feature_importance(model, rows.sparkSession, features, top)
    found = forest.importance(rows, label, n_classes, features, trees, math.ceil(math.sqrt(len(features))), depth, seed=seed)
    return found.orderBy(F.desc("importance"), "feature").limit(top)


# Nearest neighbours and the kernel machine -------------------------------------------

def knn_oof(rows: DataFrame, features: Sequence[str], k_folds: int, id_col: str, label: str,
            k: int = 5, pivots: int | None = None, block_rows: int = knn.BLOCK_ROWS) -> DataFrame:
    """k-nearest-neighbour label of every row, from the rows outside its fold.

    Features are standardised per fold with training statistics.  `rows` should be a
    staged table: it is read for the pivots, the cells and the comparison.
    """
    stats = staged(scaling.fold_scaler(rows, features, k_folds), "scaler")
    test = scaling.scaled_vectors(rows, stats, features)
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k_folds - 1).cast("bigint")),
                      lambda f: f != F.col("_own"))
    spread = rows.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(others))
    train = scaling.scaled_vectors(spread, stats, features)
    found = knn.nearest(train, test, k, ["fold"], id_col, "scaled", label, pivots, block_rows)
    return knn.vote(found, ["fold"]).withColumnRenamed("test_id", id_col)


def fourier_map(scaled: Column, n_features: int, gamma: float, n_out: int, seed: int) -> Column:
    """Random Fourier features sqrt(2/m) cos(w.x + b) approximating exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_out, n_features))
    b = rng.uniform(0.0, 2 * np.pi, size=n_out)
    rows = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in w[j]]).alias("w"),
                              F.lit(float(b[j])).alias("b")) for j in range(n_out)])

    def dot(r: Column) -> Column:
        return F.aggregate(F.zip_with(r["w"], scaled, lambda p, q: p * q), r["b"],
                           lambda acc, x: acc + x)

    return F.transform(rows, lambda r: F.lit(float(np.sqrt(2.0 / n_out))) * F.cos(dot(r)))


def kernel_svm_oof(rows: DataFrame, features: Sequence[str], folds: Sequence, label: str,
                   n_out: int = 64, c: float = 1.0, seed: int = 7, max_iter: int = 10) -> DataFrame:
    """RBF support vector machine, approximated: random Fourier features + linear SVM.

    gamma = 1 / number of features, which is the usual `scale` choice for standardised
    inputs.  One-vs-rest over the classes.
    """
    stats = scaling.fold_scaler(rows, features, len(folds))

    def mapped(df: DataFrame, f) -> DataFrame:
        here = scaling.scaled_vectors(
            df.withColumnRenamed("fold", "_own").withColumn("fold", F.lit(f).cast("bigint")),
            stats, features)
        phi = fourier_map(F.col("scaled"), len(features), 1.0 / len(features), n_out, seed)
        return here.withColumn("phi", phi).withColumn("features", array_to_vector("phi")).drop(
            "fold", "phi", "scaled").withColumnRenamed("_own", "fold")

    def one(f) -> DataFrame:
        train = staged(mapped(rows.where(F.col("fold") != F.lit(f)), f).select(
            F.col(label).cast("double").alias(label), "features"), "kernel")
        test = mapped(rows.where(F.col("fold") == F.lit(f)), f)
        # C weighs the sum of losses; here their mean is minimised
        svm = LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(train.count(), 1)), labelCol=label,
                        featuresCol="features", standardization=False)
        model = _fit_kept(OneVsRest(classifier=svm, labelCol=label, featuresCol="features",
                                    parallelism=8), train.select("features", label))
        return model.transform(test)

    with ThreadPoolExecutor(max_workers=4) as pool:
        parts = list(pool.map(one, folds))
    return reduce(DataFrame.unionByName, parts)


def svm_rows(rows: DataFrame, features: Sequence[str], k_folds: int, id_col: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of the kernel machine: fold, id, label, x, gamma.

    Features are standardised with the statistics of the fold's training rows. gamma is 1 / (features
    x variance of all standardised values), which is 1 / the number of features that vary.
    """
    stats = staged(scaling.fold_scaler(rows, features, k_folds), "scaler")
    varied = stats.where(F.col("feature").isin(*features)).groupBy("fold").agg(
        (F.lit(1.0) / F.greatest(F.count_if(F.col("std") > 0), F.lit(1))).alias("gamma"))

    def placed(df: DataFrame) -> DataFrame:
        return scaling.scaled_vectors(df, stats, features).join(F.broadcast(varied), "fold").select(
            F.col("fold").cast("bigint").alias("fold"), F.col(id_col).cast("string").alias("id"),
            F.col(label).cast("double").alias("label"), F.col("scaled").alias("x"), "gamma")

    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k_folds - 1).cast("bigint")), lambda f: f != F.col("_own"))
    spread = rows.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(others))
    return placed(spread), placed(rows)


def svm_oof(rows: DataFrame, features: Sequence[str], k_folds: int, id_col: str, label: str, c: float = 1.0
            ) -> tuple[DataFrame, DataFrame]:
    """(rows with `prediction`, support vectors): a radial support vector machine, one against one.

    Solved in the dual to convergence; the gap between primal and dual value stands with the vectors.
    """
    known, asked = svm_rows(rows, features, k_folds, id_col, label)
    model = kernel.train(known, c)
    found = kernel.predict(asked, model).select(F.col("id").alias("_id"), "prediction")
    return rows.join(found, F.col(id_col).cast("string") == F.col("_id")).drop("_id"), model


# Experiments ---------------------------------------------------------------------------

def subset_ablation(rows: DataFrame, subsets: Mapping[str, Sequence[str]],
                    models: Mapping[str, Callable[[DataFrame, Sequence[str]], DataFrame]],
                    key: str, label: str, labels: Sequence) -> DataFrame:
    """One row per (feature subset, model).

    A model is a function (rows, features) -> rows with key, label and `predicted`.  All
    predictions are written to one table first, so that no model runs twice.
    """
    def one(case: tuple[str, str]) -> DataFrame:
        subset, name = case
        out = models[name](rows, subsets[subset]).select(key, label, "predicted")
        return staged(out, "ablation").withColumns({"features": F.lit(subset), "model": F.lit(name)})

    cases = [(s, m) for s in subsets for m in models]
    with ThreadPoolExecutor(max_workers=len(cases)) as pool:
        every = reduce(DataFrame.unionByName, pool.map(one, cases))
    by = ["features", "model"]
    window = metrics.class_metrics(every, label, "predicted", by, labels)
    voted = voting.majority_vote(every, [*by, key, label], "predicted", "voted")
    record = metrics.class_metrics(voted, label, "voted", by, labels)
    return window.select(*by, F.col("accuracy").alias("accuracy_window"),
                         F.col("macro_f1").alias("macro_f1_window")).join(
        record.select(*by, F.col("accuracy").alias("accuracy_record"),
                      F.col("macro_f1").alias("macro_f1_record")), by)


def task_folds(rows: DataFrame, key: str, label: str, most: int = 5) -> tuple[DataFrame, int]:
    """(rows with `fold`, k): k is `most` or the groups of the smallest class, if fewer.

    Folds are stratified by the task's own label; a fold the rows already have is replaced. A
    group with rows of several classes is one group all the same.
    """
    rows = rows.drop("fold")
    groups = rows.select(key, label).distinct()
    k = max(2, splits.min_class_folds(groups, key, label, most).first()["n_folds"] or 0)
    return rows.join(splits.group_folds(rows, key, label, k), key), k


def validation_sensitivity(rows: DataFrame, key: str, label: str, n_classes: int,
                           setpoint: str, setpoints: Sequence, trees: int = 10, most: int = 5,
                           depth: int = MAX_DEPTH) -> DataFrame:
    """Macro F1 over the task's folds (mean, population std) against leave-one-setpoint-out."""
    def voted(some: DataFrame, folds: Sequence) -> DataFrame:
        oof = forest_oof(some, folds, key, label, n_classes, trees, depth=depth)
        return recording_predictions(oof, key, label, n_classes)

    def dealt() -> DataFrame:
        some, k = task_folds(rows, key, label, most)
        return fold_metrics(voted(some, range(k)), label).agg(
            F.avg("macro_f1").alias("cv_macro_f1_mean"), F.stddev_pop("macro_f1").alias("cv_macro_f1_std"),
            F.lit(0).alias("_k"))

    # the two know nothing of each other: neither waits while the other one is written
    with ThreadPoolExecutor(max_workers=2) as pool:
        by_fold = pool.submit(dealt)
        by_setpoint = pool.submit(voted, rows.drop("fold").withColumn("fold", F.col(setpoint)), list(setpoints))
        cv, held = by_fold.result(), by_setpoint.result()
    loso = metrics.class_metrics(
        held.withColumn("_t", F.col(label).cast("double")), "_t", "predicted").select(
        F.col("macro_f1").alias("leave_one_out_macro_f1"), F.lit(0).alias("_k"))
    return cv.join(loso, "_k").drop("_k")
