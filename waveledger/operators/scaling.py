"""Standardisation statistics of feature vectors, from training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def train_stats(rows: DataFrame, vector: str, split: str = "split",
                present: str | None = None, epsilon: float = 1e-6) -> DataFrame:
    """Per dimension: mean and population std + epsilon over the training split.

    Rows whose modality is absent are left out, unless it is absent from all of them.
    """
    train = rows.where(F.col(split) == "train")
    seen = F.lit(True) if present is None else F.col(present)
    dims = train.select(seen.alias("_on"), F.posexplode(vector).alias("dim", "_x"))
    x, on = F.col("_x").cast("double"), F.col("_on")
    out = dims.groupBy("dim").agg(
        F.avg(F.when(on, x)).alias("_m1"), F.stddev_pop(F.when(on, x)).alias("_s1"),
        F.avg(x).alias("_m0"), F.stddev_pop(x).alias("_s0"))
    return out.select("dim", F.coalesce("_m1", "_m0").alias("mean"),
                      (F.coalesce("_s1", "_s0") + epsilon).alias("std"))


def fold_scaler(rows: DataFrame, features: Sequence[str], k: int, fold: str = "fold") -> DataFrame:
    """Mean and population std per (fold, feature) over the rows outside that fold.

    Rows are summarised once per own fold; the k training sets are then put together from
    those summaries (n, mean, squared deviations), not from the rows.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                      for f in features])
    own = (rows.select(F.col(fold).alias("_own"), F.explode(pairs).alias("_p"))
           .groupBy("_own", F.col("_p.feature").alias("feature"))
           .agg(F.count("_p.x").alias("_n"), F.avg("_p.x").alias("_m"),
                F.var_pop("_p.x").alias("_v")))
    others = own.withColumn("fold", F.explode(F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
        lambda f: f != F.col("_own"))))
    n = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_m")) / n
    square = F.sum(F.col("_n") * (F.col("_v") + F.col("_m") * F.col("_m"))) / n
    return others.groupBy("fold", "feature").agg(
        n.alias("n"), mean.alias("mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def scaled_vectors(rows: DataFrame, stats: DataFrame, features: Sequence[str],
                   fold: str = "fold") -> DataFrame:
    """Add `scaled`: the features standardised with the statistics of the row's `fold`.

    A constant feature is only centred.  The statistics are one row per fold, a number
    fixed by the caller, so they are broadcast.
    """
    names = F.array(*[F.lit(f) for f in features])
    by_fold = stats.where(F.col("feature").isin(*features)).groupBy("fold").agg(F.array_sort(F.collect_list(
        F.struct(F.array_position(names, F.col("feature")).alias("at"), "mean", "std"))).alias("_s"))
    spread = rows.join(F.broadcast(by_fold.withColumnRenamed("fold", fold)), fold)
    values = F.array(*[F.col(f).cast("double") for f in features])
    return spread.withColumn("scaled", F.zip_with(values, "_s", lambda x, s: (x - s["mean"]) / F.when(
        s["std"] > 0, s["std"]).otherwise(1.0))).drop("_s")
