"""The whole comparison: manifest, shared windows, shared folds, models per sensor, verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from waveledger.operators import metrics, models, splits, stats, voting, windows as W
from waveledger.sources.tables import staged


@dataclass
class Plan:
    """What every sensor is trained and tested on.

    `manifest`: points that all sensors observed, with `common_windows` and `fold`.
    `rows`: kept windows with `fold`. `shortages`: points and sensors with fewer windows than
    their manifest promises; they should be looked at before models are compared.
    """

    manifest: DataFrame
    rows: DataFrame
    shortages: DataFrame
    k: int


def plan(windows: DataFrame, durations: DataFrame, modalities: Sequence[str], window_s: float, overlap: float,
         key: str = "group_id", label: str = "label", k: int = 5) -> Plan:
    """Cut all sensors to the windows they share and deal points to folds.

    `windows`: key, label, modality, segment_index and features. `durations`: key, modality,
    duration_s. Points that a sensor lacks, or whose shared span holds no window, are left out. A
    point whose windows have several labels has none in the manifest; its windows keep theirs.
    """
    spans = durations.groupBy(key).pivot("modality", list(modalities)).agg(F.max("duration_s"))
    spans = spans.dropna(subset=list(modalities))
    count = W.common_window_count(F.least(*[F.col(m) for m in modalities]) if len(modalities) > 1
                                  else F.col(modalities[0]), window_s, overlap)
    labels = windows.groupBy(key).agg(F.when(F.min(label).eqNullSafe(F.max(label)), F.min(label)).alias(label))
    shared = staged(spans.select(key, count.alias("common_windows")).where("common_windows > 0").join(labels, key),
                    "manifest")
    dealt = windows.select(key, label).join(shared.select(key), key, "left_semi")
    manifest = staged(shared.join(splits.group_folds(dealt, key, label, k), key), "manifest")
    kept = W.keep_common_windows(windows.where(F.col("modality").isin(*modalities)), manifest, key)
    kept = kept.drop("common_windows").join(manifest.select(key, "fold"), key)
    short = [W.window_shortages(windows.where(F.col("modality") == m), manifest, key).withColumn("modality", F.lit(m))
             for m in modalities]
    return Plan(manifest, staged(kept, "kept-windows"), reduce(DataFrame.unionByName, short), k)


def training_rows(made: Plan, key: str = "group_id", label: str = "label") -> DataFrame:
    """Every window once per fold it trains in, with the weight it has there.

    The weight is the recording's share times the class's, within the fold's training rows of
    one sensor, as the forests use it.
    """
    rows = splits.fold_membership(made.rows.withColumnRenamed("fold", "_dealt"), made.manifest.select(key, "fold"),
                                  key, made.k).where("role = 'train'").drop("role", "_dealt")
    by = ["fold", "modality"]
    per_group = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_g"))
    per_class = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    totals = per_group.groupBy(*by).agg(F.sum("_g").alias("_n"), F.count(F.lit(1)).alias("_groups")).join(
        per_class.groupBy(*by).agg(F.count(F.lit(1)).alias("_classes")), by)
    out = rows.join(per_group, [*by, key]).join(per_class, [*by, label]).join(totals, by)
    weight = F.col("_n") / F.col("_groups") / F.col("_g") * (F.col("_n") / F.col("_classes") / F.col("_c"))
    return out.withColumn("weight", weight).drop("_g", "_c", "_n", "_groups", "_classes")


def compare(made: Plan, features: Mapping[str, Sequence[str]], candidate: str, n_classes: int, target: str,
            key: str = "group_id", label: str = "label", trees: int = 500, n_iter: int = 5000
            ) -> tuple[DataFrame, DataFrame]:
    """(fold metrics per sensor, comparison of the candidate with each other sensor).

    For each sensor a forest classifies the label (macro F1 of recordings) and another estimates
    the numeric target (mean absolute error of recordings), on the shared folds.
    """
    tables = []
    for name, columns in features.items():
        rows = staged(models.assemble(made.rows.where(F.col("modality") == name), columns), "sensor-rows")
        folds = list(range(made.k))
        classes = models.recording_predictions(
            models.forest_oof(rows, folds, key, label, n_classes, trees), key, label, n_classes)
        values = voting.median_vote(models.forest_regression_oof(rows, folds, key, target, trees),
                                    ["fold", key, target], "prediction", "estimate")
        f1 = models.fold_metrics(classes, label).select("fold", "macro_f1")
        mae = metrics.regression_metrics(values, target, "estimate", ["fold"]).select("fold", "mae")
        tables.append(f1.join(mae, "fold").withColumn("modality", F.lit(name)))
    table = staged(reduce(DataFrame.unionByName, tables), "fold-metrics")
    return table, stats.compare_modalities(table, candidate, n_iter)
