"""Models: coverage and leakage of out-of-fold predictions, and the kernel map."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveledger.operators import models, splits, voting


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    data = []
    for c in range(4):
        for g in range(4):
            for w in range(5):
                x = rng.normal(loc=3.0 * c, scale=0.5, size=2)
                data.append((len(data), f"c{c}_{g}", float(c), float(x[0]), float(x[1]), 10.0 * c + g))
    df = spark.createDataFrame(
        data, "id bigint, group_id string, label double, a double, b double, load double")
    folds = splits.stratified_group_folds(
        df.select("group_id", "label").distinct(), "group_id", "label", 2)
    path = str(tmp_path_factory.mktemp("rows") / "t")
    df.join(folds.select("group_id", "fold"), "group_id").write.parquet(path)
    return spark.read.parquet(path)


def test_forest_out_of_fold(rows):
    oof = models.forest_oof(models.assemble(rows, ["a", "b"]), [0, 1], "group_id", "label", 4,
                            trees=10, depth=4)
    assert oof.count() == rows.count() == oof.select("id").distinct().count()
    voted = models.recording_predictions(oof, "group_id", "label", 4).collect()
    assert len(voted) == 16 and all(r.n_segments == 5 for r in voted)
    assert np.mean([r.predicted == r.label for r in voted]) > 0.9
    scores = models.fold_metrics(models.recording_predictions(oof, "group_id", "label", 4), "label")
    assert all(r.macro_f1 > 0.8 for r in scores.collect())


def test_forest_regression(rows):
    oof = models.forest_regression_oof(models.assemble(rows, ["a", "b"]), [0, 1], "group_id", "load",
                                       trees=10, depth=4)
    per = voting.median_vote(oof, ["group_id", "load"], "prediction").collect()
    assert len(per) == 16 and max(abs(r.load - r.load_pred) for r in per) < 8


def test_missing_features_become_zero(spark):
    df = spark.createDataFrame([(float("nan"), None)], "a double, b double")
    assert list(models.assemble(df, ["a", "b"]).first().features.toArray()) == [0.0, 0.0]


def test_knn_and_kernel_machine(rows):
    found = models.knn_oof(rows, ["a", "b"], 2, "id", "label", k=3, pivots=4, block_rows=10)
    joined = found.drop("fold").join(rows, "id")
    assert joined.count() == rows.count()
    assert joined.where(F.col("predicted").cast("double") == F.col("label")).count() > 70
    svm = models.kernel_svm_oof(rows, ["a", "b"], [0, 1], "label", n_out=32, max_iter=10)
    assert svm.count() == rows.count()
    assert svm.where("prediction = label").count() > 60


def test_fourier_map_approximates_the_kernel(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "id int, v array<double>")
    phi = np.array([r.p for r in df.select("id", models.fourier_map(F.col("v"), 3, 0.3, 2000, 1).alias("p"))
                    .orderBy("id").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(phi @ phi.T - want).max() < 0.1


def test_importance_and_ablation(rows):
    spark = rows.sparkSession
    noisy = rows.withColumn("noise", F.rand(1))
    kept = models.assemble(noisy, ["a", "noise"]).withColumn("weight", F.lit(1.0))
    model = models.forest_classifier("label", trees=10, depth=4).fit(kept)
    top = models.feature_importance(model, spark, ["a", "noise"], top=1).first()
    assert top.feature == "a" and top.importance > 0.5

    def constant(df, features):
        return df.withColumn("predicted", F.lit(0.0))

    def truth(df, features):
        return df.withColumn("predicted", F.col("label"))

    table = models.subset_ablation(rows, {"one": ["a"], "two": ["a", "b"]},
                                   {"constant": constant, "truth": truth}, "group_id", "label",
                                   [0.0, 1.0, 2.0, 3.0]).collect()
    assert len(table) == 4
    for r in table:
        assert r.accuracy_record == (1.0 if r.model == "truth" else 0.25)


def test_composed_comparison(spark):
    from waveledger.operators import benchmark

    rng = np.random.default_rng(7)
    windows, spans = [], []
    for c in range(3):
        for g in range(5):
            for m, noise in (("good", 0.3), ("poor", 8.0)):
                for w in range(4 + (m == "good")):
                    x = rng.normal(loc=4.0 * c, scale=noise)
                    windows.append((f"c{c}_{g}", float(c), m, w, float(x), 10.0 * c + g))
                spans.append((f"c{c}_{g}", m, 4.0 + (m == "good")))
    spans.append(("lonely", "good", 9.0))
    made = benchmark.plan(
        spark.createDataFrame(windows, "group_id string, label double, modality string, segment_index bigint, a double, load double"),
        spark.createDataFrame(spans, "group_id string, modality string, duration_s double"), ["good", "poor"], 1.0, 0.0, k=2)
    assert made.manifest.count() == 15 and {r.common_windows for r in made.manifest.collect()} == {4}
    assert made.rows.count() == 15 * 8 and made.shortages.count() == 0
    weights = benchmark.training_rows(made)
    assert weights.where("fold = 0").select("group_id").intersect(
        made.manifest.where("fold = 0").select("group_id")).count() == 0
    folds, verdict = benchmark.compare(made, {"good": ["a"], "poor": ["a"]}, "poor", 3, "load", trees=5, n_iter=200)
    score = {(r.modality, r.fold): r for r in folds.collect()}
    assert len(score) == 4 and all(score["good", f].macro_f1 > 0.9 > score["poor", f].macro_f1 for f in (0, 1))
    assert [r.noninferior_overall for r in verdict.collect()] == [False]


def test_penalty_follows_the_rows(rows):
    few = models.kernel_svm_oof(rows, ["a", "b"], [0, 1], "label", n_out=32)
    twice = rows.union(rows)
    many = models.kernel_svm_oof(twice, ["a", "b"], [0, 1], "label", n_out=32)
    a = {r.id: r.prediction for r in few.collect()}
    b = {r.id: r.prediction for r in many.collect()}
    assert sum(a[i] == b[i] for i in a) >= 0.9 * len(a)
