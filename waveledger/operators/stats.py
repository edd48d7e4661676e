"""Paired comparison of sensors over folds: intervals, tests and decisions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema

from waveledger import fixed_values as fv
from waveledger.sources.tables import staged
from waveledger.functions import ordered
from waveledger.functions.scalars import nan_to_null, portable_hash


def fold_summary(folds: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample std per metric."""
    aggs = [f(F.col(m)).alias(f"{m}_{s}") for m in metrics
            for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return folds.groupBy(*keys).agg(*aggs)


def t_interval(folds: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean with its 95 % interval; collapses for one value, null for none."""
    v = nan_to_null(metric)
    out = folds.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                   F.stddev_samp(v).alias("_sd"))
    t = F.when(F.col("n") <= fv.T_SMALL_N, fv.T_CRITICAL_SMALL).otherwise(fv.T_CRITICAL_LARGE)
    half = F.when(F.col("n") == 1, 0.0).otherwise(t * F.col("_sd") / F.sqrt("n"))
    return out.select(*keys, "n", "mean", (F.col("mean") - half).alias("ci_low"),
                      (F.col("mean") + half).alias("ci_high"))


def paired_deltas(folds: DataFrame, candidate: str, metrics: Sequence[str],
                  modality: str = "modality") -> DataFrame:
    """Candidate minus reference per fold, for every other modality as reference."""
    mine = folds.where(F.col(modality) == candidate).select(
        "fold", *[F.col(m).alias(f"_c_{m}") for m in metrics])
    others = folds.where(F.col(modality) != candidate)
    return others.join(mine, "fold").select(
        F.col(modality).alias("reference"), "fold",
        *[(F.col(f"_c_{m}") - F.col(m)).alias(f"delta_{m}") for m in metrics])


def bootstrap_interval(folds: DataFrame, keys: Sequence[str], value: str, n_iter: int = 5000,
                       seed: int = 42) -> DataFrame:
    """Mean and percentile interval (2.5, 97.5) of the mean of draws with replacement.

    Draw `d` of iteration `i` takes the value at position md5(seed:i:d) mod n in fold
    order, so results are the same everywhere.  The input has one row per fold: its
    groups are the k folds of a comparison, and k x n_iter draws are made per group.
    Groups of many rows are for `bootstrap_interval_sliced`.
    """
    pairs = F.array_sort(F.collect_list(F.struct("fold", F.col(value).alias("v"))))
    grouped = folds.groupBy(*keys).agg(pairs.alias("_p"), F.avg(value).alias("mean"))
    n = F.size("_p")
    draws = (grouped.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
             .withColumn("_d", F.explode(F.sequence(F.lit(0), n - 1)))
             .withColumn("_x", F.get(F.col("_p"), (portable_hash(F.lit(seed), "_i", "_d") % n)
                                     .cast("int"))["v"]))
    means = draws.groupBy(*keys, "mean", "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy(*keys, "mean").agg(
        F.percentile("_m", F.lit(0.025)).alias("ci_low"),
        F.percentile("_m", F.lit(0.975)).alias("ci_high"))


def drawn_sums(x: np.ndarray, draws: np.ndarray, rng: np.random.Generator, at_once: int = 500_000) -> list[float]:
    """For each number of draws the sum of so many values of `x`, drawn with replacement; many iterations at a time."""
    ends = np.cumsum(draws)
    out = np.zeros(len(draws))
    first = 0
    while first < len(draws):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + at_once, "right")))
        values = x[rng.integers(0, len(x), int(ends[last - 1] - base))]
        some = np.flatnonzero(draws[first:last])  # an iteration without draws has no sum to reduce
        if len(some):
            starts = (ends[first:last] - draws[first:last] - base)[some]
            out[first + some] = np.add.reduceat(values, starts)
        first = last
    return out.tolist()


def bootstrap_interval_sliced(rows: DataFrame, keys: Sequence[str], order: str, value: str, n_iter: int = 5000,
                              seed: int = 42, slice_rows: int = 65_536) -> DataFrame:
    """Mean and percentile interval of the mean of draws with replacement, for groups of any size.

    No task holds a group. Its rows are dealt to slices by the hash of `order`, which should tell
    them apart. The n draws of an iteration go down a binary tree whose leaves are the slices: at
    each node a binomial number goes left, by the rows on either side, from a generator named by
    (seed, node), so all tasks below a node agree on it. A slice draws its share among its own
    rows, and the sums of the slices add up. Together the draws are multinomial, as if they had
    been made from the whole group. Null values are left out.
    """
    if not keys:
        one = rows.withColumn("_all", F.lit(0))
        return bootstrap_interval_sliced(one, ["_all"], order, value, n_iter, seed, slice_rows).drop("_all")
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x"))
    counts = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("mean")), "bootstrap-groups")
    largest = counts.agg(F.max("_n")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(largest, 1) / slice_rows)))
    leaf = F.pmod(F.xxhash64("_o"), F.lit(1 << depth)).alias("_leaf")
    leaves = rows.groupBy(*keys, leaf).agg(F.count(F.lit(1)).alias("_m"))
    # of each node on the way to a leaf: rows below its left and its right side
    steps = []
    for level in range(depth):
        side = F.shiftright("_leaf", level).bitwiseAND(F.lit(1))
        node = Window.partitionBy(*keys, F.shiftright("_leaf", level + 1))
        steps.append(F.struct(F.shiftright("_leaf", level + 1).alias("node"), side.alias("side"),
                              F.sum(F.when(side == 0, F.col("_m")).otherwise(0)).over(node).alias("left"),
                              F.sum(F.when(side == 1, F.col("_m")).otherwise(0)).over(node).alias("right")))
    way = F.array(*reversed(steps)) if steps else F.expr("cast(array() as array<struct<node:bigint,side:bigint,left:bigint,right:bigint>>)")
    name = F.xxhash64(*[F.col(k).cast("string") for k in keys])
    known = leaves.withColumn("_way", way).join(counts, list(keys)).select(*keys, "_leaf", "_way", "_n", name.alias("_name"))
    part = [*keys, "_leaf"]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def draw(here: pa.Table, facts: pa.Table) -> pa.Table:
        out = {k: [] for k in keys} | {"_sums": []}
        if here.num_rows and facts.num_rows:
            f = facts.to_pylist()[0]
            order = np.lexsort((here["_x"].to_numpy(), np.array([str(o) for o in here["_o"].to_pylist()])))
            x = here["_x"].to_numpy()[order]
            draws = np.full(n_iter, f["_n"], np.int64)
            for depth_here, step in enumerate(f["_way"]):
                entropy = [seed, f["_name"] & (2**64 - 1), depth_here, step["node"]]
                left = np.random.default_rng(entropy).binomial(draws, step["left"] / (step["left"] + step["right"]))
                draws = left if step["side"] == 0 else draws - left
            rng = np.random.default_rng([seed, f["_name"] & (2**64 - 1), 1 << 32, f["_leaf"]])
            sums = drawn_sums(x, draws, rng)
            out = {k: [f[k]] for k in keys} | {"_sums": [sums]}
        return pa.table(out, schema=to_arrow_schema(schema))

    dealt = rows.withColumn("_leaf", leaf)
    sums = dealt.groupBy(*part).cogroup(known.toDF(*known.columns).groupBy(*part)).applyInArrow(draw, schema)
    totals = sums.select(*keys, F.posexplode("_sums").alias("_i", "_s")).groupBy(*keys, "_i").agg(F.sum("_s").alias("_s"))
    return totals.join(counts, list(keys)).groupBy(*keys, "mean").agg(
        F.percentile(F.col("_s") / F.col("_n"), F.lit(0.025)).alias("ci_low"),
        F.percentile(F.col("_s") / F.col("_n"), F.lit(0.975)).alias("ci_high"))


def _exact_two_sided(n: Column, statistic: Column) -> Column:
    """P-value from all 2^n sign patterns: counts per rank sum, built rank by rank."""
    def add(ways: Column, r: Column) -> Column:
        pad = F.array_repeat(F.lit(0.0), r.cast("int"))
        return F.zip_with(F.concat(ways, pad), F.concat(pad, ways), lambda a, b: a + b)

    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), add)
    tail = F.aggregate(F.slice(ways, 1, statistic.cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n.cast("double")))


@arrow_udf(T.DoubleType())
def _normal_two_sided(z: pa.Array) -> pa.Array:
    return pa.array([None if v is None else math.erfc(abs(v) / math.sqrt(2)) for v in z.to_pylist()],
                    type=pa.float64())


def signed_rank(rows: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Two-sided signed-rank test: n, r_plus, r_minus, z, p_value.

    Zero differences are dropped.  The exact distribution is used up to n = 50 without
    zeros or ties, the normal approximation with tie correction otherwise; with no
    difference left p is 1.
    """
    d = F.col(delta)
    sizes = rows.groupBy(*keys).agg(F.count_if(d == 0).alias("zeros"))
    counts = (rows.where(d != 0).groupBy(*keys, F.abs(d).alias("_a"))
              .agg(F.count_if(d > 0).alias("_pos"), F.count_if(d < 0).alias("_neg"),
                   F.count(F.lit(1)).alias("_t")))
    ranked = ordered.running_sums(counts, keys, ["_a"], ordered.value_slice("_a"), {"_cum": "_t"})
    rank = F.col("_cum") - (F.col("_t") - 1) / F.lit(2.0)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_t").alias("n"), F.sum(F.col("_pos") * rank).alias("r_plus"),
        F.sum(F.col("_neg") * rank).alias("r_minus"), F.sum(t * t * t - t).alias("_ties"))
    out = sizes.join(sums, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n").cast("double")
    low = F.least("r_plus", "r_minus")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    out = out.withColumn("z", F.try_divide(low - n * (n + 1) / 4, F.sqrt(spread)))
    out = out.withColumn("_normal", _normal_two_sided(F.col("z")))
    exact = (F.col("n") <= 50) & (F.col("_ties") == 0) & (F.col("zeros") == 0)
    p = (F.when(F.col("n") == 0, 1.0)
         .when(exact, _exact_two_sided(F.least("n", F.lit(50)), low)).otherwise(F.col("_normal")))
    return out.withColumn("p_value", p).select(*keys, "n", "r_plus", "r_minus", "z", "p_value")


def compare_modalities(folds: DataFrame, candidate: str, n_iter: int = 5000, seed: int = 42,
                       f1_margin: float = fv.F1_MARGIN, mae_margin: float = fv.MAE_MARGIN
                       ) -> DataFrame:
    """Per reference: mean deltas with intervals, signed-rank p and the non-inferiority verdict."""
    deltas = paired_deltas(folds, candidate, ["macro_f1", "mae"])
    # both metrics go through each step together; the fold table is computed once
    pair = F.explode(F.array(F.struct(F.lit("f1").alias("metric"), F.col("delta_macro_f1").alias("delta")),
                             F.struct(F.lit("mae").alias("metric"), F.col("delta_mae").alias("delta")))).alias("_d")
    keys = ["reference", "metric"]
    long = staged(deltas.select("reference", "fold", pair).select("reference", "fold", "_d.metric", "_d.delta"), "deltas")
    ci = bootstrap_interval(long, keys, "delta", n_iter, seed)
    facts = ci.join(signed_rank(long, keys, "delta").select(*keys, F.col("p_value").alias("wilcoxon_p")), keys)
    out = facts.groupBy("reference").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"delta_{m}_{c}")
        for m in ("f1", "mae") for c in ("mean", "ci_low", "ci_high", "wilcoxon_p")])
    return noninferiority(out, f1_margin, mae_margin)


def noninferiority(comparison: DataFrame, f1_margin: float = fv.F1_MARGIN,
                   mae_margin: float = fv.MAE_MARGIN) -> DataFrame:
    f1 = F.col("delta_f1_ci_low") > -f1_margin
    mae = F.col("delta_mae_ci_high") < mae_margin
    return comparison.withColumns({"noninferior_f1": f1, "noninferior_mae": mae,
                                   "noninferior_overall": f1 & mae})


def quartile_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles and the furthest values within 1.5 interquartile ranges."""
    probs: Mapping[str, float] = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = ordered.quantiles(rows, keys, value, probs)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    within = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return ordered.attach(rows, q, keys, [value]).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(within, v)).alias("whisker_low"), F.max(F.when(within, v)).alias("whisker_high"),
        F.count_if(~within).alias("outliers"))
