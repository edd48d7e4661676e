"""Classification, regression and ROC metrics from prediction tables.

Everything starts from small counts: predictions are reduced to (true, predicted) or to
(score, positive) counts before anything else happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from waveledger.functions import ordered
from waveledger.sources.tables import staged


def confusion_counts(rows: DataFrame, true: str, predicted: str,
                     keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, true: str, predicted: str, keys: Sequence[str] = (),
                 labels: Sequence | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a ratio has no denominator.

    Labels are those seen as truth or prediction, or exactly `labels` when given.
    """
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("true").alias("label"), n.alias("s"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("true") == F.col("predicted"), n).otherwise(0).alias("t")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("s"),
                 n.alias("p"), F.lit(0).cast("bigint").alias("t")))
    counts = confusion_counts(rows, true, predicted, keys)
    per = (counts.withColumn("_x", F.explode(sides))
           .groupBy(*keys, F.col("_x.label").alias("label"))
           .agg(F.sum("_x.t").alias("tp"), F.sum("_x.s").alias("support"),
                F.sum("_x.p").alias("predicted")))
    if labels is not None:
        wanted = F.array(*[F.lit(x) for x in labels])
        base = (per.select(*keys).distinct() if keys else per.agg(F.lit(1).alias("_one")))
        grid = base.withColumn("label", F.explode(wanted))
        per = grid.join(per, [*keys, "label"], "left").na.fill(0, ["tp", "support", "predicted"])
        per = per.select(*keys, "label", "tp", "support", "predicted")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return per.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")),
        "recall": ratio(F.col("tp"), F.col("support")),
        "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
    })


def class_metrics(rows: DataFrame, true: str, predicted: str, keys: Sequence[str] = (),
                  labels: Sequence | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and weighted F1, one row per key."""
    per = class_report(rows, true, predicted, keys, labels)
    seen = F.col("support") > 0
    return per.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def confusion_matrix(rows: DataFrame, true: str, predicted: str, labels: Sequence) -> DataFrame:
    """Long matrix over fixed labels: count and share of the true row (0 rows stay 0)."""
    counts = confusion_counts(rows, true, predicted)
    names = F.array(*[F.lit(x) for x in labels])
    grid = (rows.sparkSession.range(1)
            .select(F.explode(names).alias("true"))
            .withColumn("predicted", F.explode(names)))
    full = grid.join(counts, ["true", "predicted"], "left").na.fill(0, ["n"])
    row_total = F.sum("n").over(Window.partitionBy("true"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), row_total), F.lit(0.0)))


def regression_metrics(rows: DataFrame, true: str, predicted: str,
                       keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, median absolute error and mean residual; R2 null for constant truth."""
    e = F.col(predicted) - F.col(true)
    df = rows.withColumn("_abs", F.abs(e))
    one_pass = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_abs").alias("mae"), F.avg(e * e).alias("_mse"),
        F.var_pop(F.col(true)).alias("_var"), F.avg(e).alias("mean_residual"))
    mid = ordered.quantiles(df, keys, "_abs", {"median_abs_err": 0.5})
    out = one_pass.join(mid, list(keys)) if keys else (
        one_pass.withColumn("_k", F.lit(0)).join(mid.withColumn("_k", F.lit(0)), "_k").drop("_k"))
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var"))
    return (out.withColumn("rmse", F.sqrt("_mse")).withColumn("r2", r2).drop("_mse", "_var"))


def split_mae(rows: DataFrame, true: str, predicted: str, limit: float) -> DataFrame:
    """Mean absolute error at and below a setpoint, and above it."""
    err = F.abs(F.col(predicted) - F.col(true))
    low = F.col(true) <= limit
    return rows.agg(F.avg(F.when(low, err)).alias("mae_low"),
                    F.avg(F.when(~low, err)).alias("mae_high"))


def residual_by_truth(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.groupBy(true).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(predicted) - F.col(true)).alias("mean_residual"))


def error_anatomy(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """How often family and reversal agree, and how many errors stay inside the family."""
    from waveledger.functions.scalars import condition_family, reversal_flag

    same_family = condition_family(true) == condition_family(predicted)
    same_flag = reversal_flag(true) == reversal_flag(predicted)
    wrong = F.col(true) != F.col(predicted)
    return rows.agg(
        F.avg(same_family.cast("double")).alias("family_accuracy"),
        F.avg(same_flag.cast("double")).alias("reversal_accuracy"),
        F.count_if(wrong & same_family).alias("errors_within_family"),
        F.count_if(wrong).alias("errors_total"))


#: Curve points that one task orders.
SLICE_POINTS = 20_000

# ROC -----------------------------------------------------------------------------------

def score_counts(scored: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """pos and neg rows of each distinct score."""
    return scored.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))


def curve_points(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score counts with running tp, fp from the highest score down, and n_pos, n_neg."""
    down = -F.col("score")
    return ordered.running_sums(counts, keys, [down], ordered.value_slice(down),
                                {"tp": "pos", "fp": "neg"}, totals={"n_pos": "tp", "n_neg": "fp"})


def roc_points(scored: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """One curve point per distinct score: true and false positives down to that score.

    Columns: keys, score, tp, fp (running), pos, neg (of this score), n_pos, n_neg.
    """
    return curve_points(score_counts(scored, keys, score, positive), keys)


def auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under the curve; null without positives or negatives."""
    step = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0
    return points.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.sum(step).alias("_area")).withColumn(
        "auc", F.try_divide(F.col("_area"), F.col("n_pos").cast("double") * F.col("n_neg"))
    ).drop("_area")


def one_vs_rest(rows: DataFrame, label: str, scores: str, classes: Sequence) -> DataFrame:
    """One row per (row, class): class, score, positive."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.get(F.col(scores), F.lit(i)).alias("score"))
                      for i, c in enumerate(classes)])
    return (rows.select(F.col(label).alias("_label"), F.explode(pairs).alias("_p"))
            .select(F.col("_p.class").alias("class"), F.col("_p.score").alias("score"),
                    (F.col("_label") == F.col("_p.class")).alias("positive")))


def roc_auc_ovr(rows: DataFrame, label: str, scores: str, classes: Sequence) -> DataFrame:
    """AUC per class, pooled (micro) and averaged (macro, weighted): columns curve, auc."""
    long = one_vs_rest(rows, label, scores, classes)
    # rows are scanned and counted once; the pooled curve sums the counts of the classes
    counts = staged(score_counts(long, ["class"], "score", "positive"), "roc-counts")
    per = staged(auc(curve_points(counts, ["class"]), ["class"]), "roc-areas")
    pooled = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    micro = auc(curve_points(pooled.withColumn("class", F.lit("micro")), ["class"]), ["class"])
    present = per.where("n_pos > 0")
    macro = present.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("curve"), "auc")
    weighted = present.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc"))
    return (present.select(F.col("class").cast("string").alias("curve"), "auc")
            .unionByName(micro.select(F.col("class").alias("curve"), "auc"))
            .unionByName(macro)
            .unionByName(weighted.select(F.lit("weighted").alias("curve"), "auc")))


def macro_roc_curve(rows: DataFrame, label: str, scores: str, classes: Sequence,
                    slices: int | None = None) -> DataFrame:
    """Mean true-positive rate of all classes on the union of their false-positive rates.

    Each class is read by linear interpolation; at a vertical step the upper end counts.
    Neighbours are looked up inside slices of the rate axis, with the last and first
    point of the slices around carried over; their number follows from the points.  The class curves are written once, because
    they serve as grid, as known points and as neighbours.
    """
    pts = roc_points(one_vs_rest(rows, label, scores, classes), ["class"], "score", "positive")
    pts = pts.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    fpr, tpr = F.col("fp") / F.col("n_neg"), F.col("tp") / F.col("n_pos")
    first = F.col("tp") == F.col("pos")
    start = (F.col("fp") == F.col("neg")) & first
    steps = pts.select("class", fpr.alias("fpr"), tpr.alias("tpr")).unionByName(
        pts.where(start).select("class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    curve = staged(steps.groupBy("class", "fpr").agg(
        F.min("tpr").alias("lo"), F.max("tpr").alias("hi")), "roc-curves")

    if slices is None:
        slices = curve.count() // SLICE_POINTS + 1
    n_classes = curve.agg(F.count_distinct("class").alias("c")).scalar()
    names = curve.agg(F.sort_array(F.collect_set("class")).alias("c")).scalar()
    grid = curve.select("fpr").distinct().withColumn("class", F.explode(names))
    at = grid.join(curve, ["class", "fpr"], "left").withColumn(
        "_s", F.floor(F.col("fpr") * slices))

    known = F.col("hi").isNotNull()
    me = F.when(known, F.struct("fpr", "lo", "hi"))
    ends = at.where(known).groupBy("class", "_s").agg(
        F.max_by(F.struct("fpr", "lo", "hi"), "fpr").alias("_last"),
        F.min_by(F.struct("fpr", "lo", "hi"), "fpr").alias("_first"))
    # what follows is looked up from the other end: a frame that runs to the end is summed anew for every row
    across = Window.partitionBy("class").orderBy("_s")
    back = Window.partitionBy("class").orderBy(F.desc("_s"))
    all_slices = at.select("class", "_s").distinct().join(ends, ["class", "_s"], "left")
    around = all_slices.select(
        "class", "_s",
        F.last("_last", ignorenulls=True).over(
            across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(
            back.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inside = Window.partitionBy("class", "_s").orderBy("fpr")
    near = at.withColumn("_p", F.last(me, ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    from_end = Window.partitionBy("class", "_s").orderBy(F.desc("fpr"))
    near = near.withColumn("_n", F.last(me, ignorenulls=True).over(
        from_end.rowsBetween(Window.unboundedPreceding, -1)))
    near = near.join(around, ["class", "_s"])
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    between = p["hi"] + (n["lo"] - p["hi"]) * (F.col("fpr") - p["fpr"]) / (n["fpr"] - p["fpr"])
    value = F.when(known, F.col("hi")).when(n.isNull(), p["hi"]).otherwise(between)
    return near.groupBy("fpr").agg((F.sum(value) / n_classes).alias("macro_tpr"))


def curve_auc(curve: DataFrame, x: str, y: str, slices: int | None = None) -> DataFrame:
    """Trapezoid area under a curve of distinct x in [0, 1], added up in slices of x."""
    if slices is None:
        curve = staged(curve, "curve")
        slices = curve.count() // SLICE_POINTS + 1
    cut = curve.withColumn("_s", F.floor(F.col(x) * slices))
    inside = Window.partitionBy("_s").orderBy(x)
    steps = cut.withColumns({"_px": F.lag(x).over(inside), "_py": F.lag(y).over(inside)})
    area = F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2)
    per = steps.groupBy("_s").agg(
        F.coalesce(area, F.lit(0.0)).alias("_a"), F.min(F.struct(x, y)).alias("_f"),
        F.max(F.struct(x, y)).alias("_l"))
    w = Window.partitionBy(F.lit(0)).orderBy("_s")
    prev = F.lag("_l").over(w)
    gap = (F.col("_f")[x] - prev[x]) * (F.col("_f")[y] + prev[y]) / 2
    return per.withColumn("_g", F.coalesce(gap, F.lit(0.0))).agg(
        F.sum(F.col("_a") + F.col("_g")).alias("auc"))
