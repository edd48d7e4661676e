"""Model queries: no SQL equivalent, so only their rows can be checked."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from waveledger.operators import kernel, metrics, models, splits, voting
from waveledger.plans import spectral_queries, standins as S
from waveledger.plans.registry import query
from waveledger.sources import tables

TIME = ["RMS", "PTP", "CF", "Kurtosis"]
BANDS = [f"band_{lo}_{hi}" for lo, hi in S.UNIT_BANDS]
BOTH = [*TIME, *BANDS]
N_CLASSES, K = 10, 3
CLASSES = [float(i) for i in range(N_CLASSES)]


def _rows(spark, sf):
    """Feature rows with folds, written once: models read them many times."""
    feats = spectral_queries.short_window_table(spark, sf).select(
        "vec_id", "group_id", "label", *BOTH)
    groups = feats.select("group_id", "label").distinct()
    folds = splits.stratified_group_folds(groups, "group_id", "label", K)
    out = feats.join(folds.select("group_id", "fold"), "group_id").withColumns({
        "label": F.col("label").cast("double"),
        "setpoint": (F.col("vec_id") % 10).cast("double")})
    return tables.staged(out, "model-rows")


@query("rf_oof")
def rf_oof(spark, sf):
    rows = models.assemble(_rows(spark, sf), BOTH)
    oof = models.forest_oof(rows, range(K), "group_id", "label", N_CLASSES, trees=500)
    voted = models.recording_predictions(oof, "group_id", "label", N_CLASSES)
    return voted.select("fold", "group_id", "label", "n_segments", "predicted")


@query("rf_fold_metrics")
def rf_fold_metrics(spark, sf):
    rows = models.assemble(_rows(spark, sf), BOTH)
    oof = models.forest_oof(rows, range(K), "group_id", "label", N_CLASSES, trees=500)
    voted = models.recording_predictions(oof, "group_id", "label", N_CLASSES)
    return models.fold_metrics(voted, "label")


@query("rf_reg_oof")
def rf_reg_oof(spark, sf):
    rows = models.assemble(_rows(spark, sf), BOTH)
    oof = models.forest_regression_oof(rows, range(K), "group_id", "setpoint", trees=500)
    per = voting.median_vote(oof, ["fold", "group_id", "setpoint"], "prediction", "load_pred")
    return metrics.regression_metrics(per, "setpoint", "load_pred", ["fold"])


@query("rff_svm_oof")
def rff_svm_oof(spark, sf):
    oof = models.kernel_svm_oof(_rows(spark, sf), BOTH, range(K), "label")
    voted = voting.majority_vote(oof, ["fold", "group_id", "label"], "prediction", "predicted")
    return voted.select("fold", "group_id", "label", "predicted", "n_segments")


@query("svm_oof")
def svm_oof(spark, sf):
    """Votes of a radial support vector machine that is solved to convergence."""
    oof, _ = models.svm_oof(_rows(spark, sf), BOTH, K, "vec_id", "label")
    voted = voting.majority_vote(oof, ["fold", "group_id", "label"], "prediction", "predicted")
    return voted.select("fold", "group_id", "label", "predicted", "n_segments")


@query("svm_conditions", f"""
WITH {S.WIN}, groups AS (SELECT DISTINCT group_id, label FROM win),
folds AS (SELECT group_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', group_id))) - 1
    + CAST(concat('0x', substr(md5(concat('42:', label)), 1, 8)) AS BIGINT) % {K}) % {K} AS fold FROM groups),
r AS (SELECT DISTINCT vec_id, win.label, fold FROM win JOIN folds ON folds.group_id = win.group_id),
c AS (SELECT f AS fold, label, count(*) AS n FROM r, range({K}) t(f) WHERE f <> fold GROUP BY ALL)
SELECT a.fold, a.label::DOUBLE AS lo, b.label::DOUBLE AS hi, a.n + b.n AS n_rows, true AS settled, true AS balanced
FROM c a JOIN c b ON a.fold = b.fold AND a.label < b.label""")
def svm_conditions(spark, sf):
    """Of each machine: its training rows, whether primal and dual value meet, and whether its weights balance."""
    known, _ = models.svm_rows(_rows(spark, sf), BOTH, K, "vec_id", "label")
    known = tables.staged(known, "svm-rows")
    model = tables.staged(kernel.train(known), "svm")
    key = ["fold", "lo", "hi"]
    got = model.groupBy(*key).agg((F.max("gap") < 0.01 * F.sum("alpha")).alias("settled"),
                                  (F.abs(F.sum(F.col("alpha") * F.col("y"))) < 1e-6).alias("balanced"))
    counts = known.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = (counts.select("fold", F.col("label").alias(c), F.col("n").alias(f"n_{c}")) for c in ("lo", "hi"))
    return got.join(lo, ["fold", "lo"]).join(hi, ["fold", "hi"]).select(
        *key, (F.col("n_lo") + F.col("n_hi")).alias("n_rows"), "settled", "balanced")


@query("subset_ablation")
def subset_ablation(spark, sf):
    def forest(rows, features):
        return models.forest_oof(models.assemble(rows, features), range(K), "group_id", "label",
                                 N_CLASSES, trees=200, min_leaf=2
                                 ).withColumn("predicted", F.col("prediction"))

    def nearest(rows, features):
        found = models.knn_oof(rows, features, K, "vec_id", "label")
        return rows.join(found.drop("fold"), "vec_id").withColumn(
            "predicted", F.col("predicted").cast("double"))

    def svm(rows, features):
        return models.svm_oof(rows, features, K, "vec_id", "label")[0].withColumn("predicted", F.col("prediction"))

    return models.subset_ablation(
        _rows(spark, sf), {"time": TIME, "frequency": BANDS, "both": BOTH},
        {"kNN": nearest, "SVM": svm, "Random Forest": forest}, "group_id", "label", CLASSES)


def _tasks(rows):
    """Classes and rows of each task; `label` is the condition on the way in, the target on the way out."""
    operation = F.floor(F.col("label") / 3).cast("double")
    return {"condition": (N_CLASSES, rows),
            "operation": (4, rows.withColumn("label", operation)),
            "reversal": (2, rows.withColumn("label", F.col("label") % 2)),
            "binary": (2, rows.withColumn("label", operation).where("label < 2"))}


_TASK_LABELS = {"condition": "label", "operation": "label // 3", "reversal": "label % 2", "binary": "label // 3"}
_TASKS_SQL = S.WIN + ", g AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS task, group_id, CAST({e} AS BIGINT) AS label FROM win"
    + (f" WHERE {e} < 2" if t == "binary" else "") for t, e in _TASK_LABELS.items()) + """),
sizes AS (SELECT task, label, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT task, greatest(2, least(5, min(n))) AS n_folds FROM sizes GROUP BY task),
f AS (
  SELECT g.task, g.group_id, g.label, n_folds, (row_number() OVER (PARTITION BY g.task, g.label ORDER BY md5(concat('42:', g.group_id))) - 1
    + CAST(concat('0x', substr(md5(concat('42:', CAST(g.label AS DOUBLE))), 1, 8)) AS BIGINT) % n_folds) % n_folds AS fold
  FROM g JOIN k USING (task))"""


@query("task_folds", f"""
WITH {_TASKS_SQL} SELECT task, group_id, CAST(label AS DOUBLE) AS label, n_folds, fold FROM f""")
def task_folds(spark, sf):
    """Folds of each task, stratified by its own target and as many as its smallest class allows."""
    out = None
    base = S.windows(spark, sf).select("group_id", F.col("label").cast("double").alias("label")).distinct()
    for task, (_, rows) in _tasks(base).items():
        dealt, k = models.task_folds(rows.distinct(), "group_id", "label")
        part = dealt.select(F.lit(task).alias("task"), "group_id", "label", F.lit(k).cast("bigint").alias("n_folds"), "fold")
        out = part if out is None else out.unionByName(part)
    return out


@query("validation_sensitivity")
def validation_sensitivity(spark, sf):
    """Folds against leave-one-setpoint-out for condition, operation, reversal and a pair."""
    rows = models.assemble(_rows(spark, sf), BOTH)
    setpoints = [float(i) for i in range(10)]
    tasks = _tasks(rows)

    def score(task: str):
        n, data = tasks[task]
        return models.validation_sensitivity(data, "group_id", "label", n, "setpoint", setpoints, trees=10).withColumn("task", F.lit(task))

    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        return reduce(DataFrame.unionByName, pool.map(score, tasks))


@query("rf_importance")
def rf_importance(spark, sf):
    rows = models.assemble(_rows(spark, sf), BOTH)
    return models.forest_importance(rows, "label", N_CLASSES, BOTH, trees=500, top=8)
