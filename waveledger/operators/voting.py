"""Softmax, pooling and votes that turn window outputs into recording outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waveledger.functions import ordered
from waveledger.functions.arrays import let, total
from waveledger.functions.scalars import col


def softmax(logits: Column | str) -> Column:
    """Probabilities of a logit array (one entry per class)."""
    a = col(logits)
    shifted = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def first_argmax(values: Column | str) -> Column:
    """Index of the largest entry; the lowest on a tie."""
    v = col(values)
    return F.array_position(v, F.array_max(v)) - 1


def masked_softmax_pool(tokens: DataFrame, key: str, modality: str = "modality",
                        logit: str = "logit", present: str = "present",
                        vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(weights, pooled) of per-modality vectors; absent modalities weigh nothing.

    Weights are the softmax of the logits of the present modalities.  A key with none
    present gets weights 0 and a zero vector.  Modalities per key are few by design.
    """
    w = Window.partitionBy(key)
    live = F.col(present)
    e = F.when(live, F.exp(F.col(logit) - F.max(F.when(live, F.col(logit))).over(w))).otherwise(0.0)
    weighted = (tokens.withColumn("_e", e)
                .withColumn("weight", F.coalesce(
                    F.try_divide(F.col("_e"), F.sum("_e").over(w)), F.lit(0.0))).drop("_e"))
    pooled = (weighted.select(key, "weight", F.posexplode(vector).alias("dim", "_x"))
              .groupBy(key, "dim").agg(F.sum(F.col("weight") * F.col("_x")).alias("value")))
    return weighted.select(key, modality, "weight"), pooled


def soft_vote(windows: DataFrame, keys: Sequence[str], probabilities: str,
              classes: Sequence) -> DataFrame:
    """Mean probability per class over a recording's windows; the first largest wins."""
    k = len(classes)
    means = [F.avg(F.get(F.col(probabilities), F.lit(i))) for i in range(k)]
    voted = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"),
                                       F.array(*means).alias("mean_prob"))
    names = F.array(*[F.lit(c) for c in classes])
    return voted.withColumn("predicted", F.get(names, first_argmax("mean_prob").cast("int")))


def median_vote(windows: DataFrame, keys: Sequence[str], prediction: str,
                out: str = "load_pred") -> DataFrame:
    return ordered.quantiles(windows, keys, prediction, {out: 0.5})


def majority_vote(windows: DataFrame, keys: Sequence[str], prediction: str,
                  out: str = "predicted") -> DataFrame:
    """Most frequent prediction per recording; a tie goes to the lowest class."""
    counts = windows.groupBy(*keys, prediction).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(
        F.min_by(prediction, F.struct(-F.col("_c"), F.col(prediction))).alias(out),
        F.sum("_c").alias("n_segments"))


def attention_summary(weights: DataFrame, present: str = "present",
                      modality: str = "modality") -> DataFrame:
    """Mean and std of the weight where the modality is present, and how often it is."""
    live = F.when(F.col(present), F.col("weight"))
    return weights.groupBy(modality).agg(
        F.coalesce(F.avg(live), F.lit(0.0)).alias("mean_weight"),
        F.coalesce(F.stddev_pop(live), F.lit(0.0)).alias("std_weight"),
        F.avg(F.col(present).cast("double")).alias("availability"))


def attention_by_class(weights: DataFrame, label: str, modalities: Sequence[str],
                       modality: str = "modality") -> DataFrame:
    return weights.groupBy(label).pivot(modality, list(modalities)).agg(F.avg("weight"))
