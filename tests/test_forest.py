"""Forests grown in tasks: splits against brute force, votes, weights, independence of row order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveledger.operators import forest, models


def brute(bins, y, w, n_classes):
    """(gain, feature, cut) of the best split by trying all."""
    def score(part):
        if not len(part):
            return 0.0
        sums = np.bincount(y[part], w[part], n_classes) if n_classes else np.array([(w[part] * y[part]).sum()])
        return (sums ** 2).sum() / w[part].sum()

    every = np.arange(len(y))
    found = [(score(every[bins[:, j] <= c]) + score(every[bins[:, j] > c]) - score(every), j, c)
             for j in range(bins.shape[1]) for c in range(31) if 0 < (bins[:, j] <= c).sum() < len(y)]
    return max(found)


@pytest.mark.parametrize("n_classes", [3, 0])
@pytest.mark.parametrize("n", [12, 300])
def test_best_split_is_that_of_brute_force(n_classes, n):
    rng = np.random.default_rng(n + n_classes)
    bins = rng.integers(0, 32, (n, 4)).astype(np.uint8)
    y = rng.integers(0, 3, n) if n_classes else rng.normal(size=n)
    g = forest.Grower(bins, y, rng.uniform(0.5, 2, n), bins, n_classes, 4, 30, 1)
    rows, times = np.arange(n), np.ones(n, np.int64)
    total, mass = g._sums(np.zeros(n, np.int64), rows, g.weight, 1)
    feature, cut, gain = g._best(rows, times, g.weight, np.zeros(n, np.int64), total, mass, rng)
    want, j, c = brute(bins, y, g.weight, n_classes)
    assert gain[0] == pytest.approx(want)
    left = bins[:, feature[0]] <= cut[0]
    assert (left == (bins[:, j] <= c)).all()


def test_many_nodes_are_split_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 32, (400, 3)).astype(np.uint8), rng.integers(0, 4, 400)
    votes = []
    for pairs in (50, 1 << 16):
        monkeypatch.setattr(forest, "PAIRS", pairs)
        # all features are tried, so that the draws do not matter
        g = forest.Grower(bins, y, np.ones(400), bins, 4, 3, 30, 1)
        g.grow([np.random.default_rng(t) for t in range(3)], np.random.default_rng(0))
        votes.append(g.votes.reshape(400, 4))
    assert np.abs(votes[0].sum(1) - 3).max() < 1e-9 and (votes[0].argmax(1) == y).mean() > 0.8
    assert (votes[0].argmax(1) == votes[1].argmax(1)).mean() > 0.95


def test_cuts():
    assert forest.cuts(np.array([1.0, 3, 3, 5])).tolist() == [2.0, 4.0]
    x = np.random.default_rng(1).normal(size=5000)
    sizes = np.bincount(np.searchsorted(forest.cuts(x), x))
    assert len(sizes) == 32 and sizes.min() > 140
    assert forest.cuts(np.array([-np.inf, 0.0, np.inf])).tolist() == [-np.inf, 0.0]


def test_weights_are_those_of_the_tables(spark):
    rows = [(f"g{i % 3 if i < 9 else 3}", float(i % 2)) for i in range(30)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, label double")
    want = [r.weight for r in models.training_weights(df, "g", "label").orderBy("id").collect()]
    got = forest.recording_weights(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert np.allclose(got, want)


def test_forests_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, f"g{i // 10}", float(i // 10 % 3), i // 10 % 2, *(float(v) for v in rng.normal(size=4))) for i in range(300)]
    df = spark.createDataFrame(data, "id int, g string, label double, fold int, a double, b double, c double, d double")
    got = []
    for order, parts in (("id", 1), ("b", 5)):
        rows = models.assemble(df.orderBy(order).repartition(parts), ["a", "b", "c", "d"])
        oof = models.forest_oof(rows, [0, 1], "g", "label", 3, trees=24)
        reg = models.forest_regression_oof(rows, [0, 1], "g", "a", trees=8)
        got.append(({r.id: r.probabilities for r in oof.collect()}, {r.id: r.prediction for r in reg.collect()}))
    assert len(got[0][0]) == len(got[0][1]) == 300 and got[0] == got[1]
    assert all(abs(sum(p) - 1) < 1e-9 for p in got[0][0].values())


def test_importance_adds_to_one(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(i % 2), float(i % 2 + rng.normal(scale=0.3)), float(rng.normal())) for i in range(200)],
                               "label double, a double, noise double")
    found = models.forest_importance(models.assemble(df, ["a", "noise"]), "label", 2, ["a", "noise"], trees=20).collect()
    assert [r.feature for r in found] == ["a", "noise"] and sum(r.importance for r in found) == pytest.approx(1)
    assert found[0].importance > 0.6


def test_labels_out_of_range_are_refused(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 1.0), ("b", 5.0, 1, 2.0)], "g string, label double, fold int, x double")
    with pytest.raises(Exception, match="labels are not 0 to 1"):
        models.forest_oof(models.assemble(df, ["x"]), [0, 1], "g", "label", 2, trees=4).collect()


def test_a_small_forest_reads_the_rows_once_for_each_fold(spark):
    rows = models.assemble(spark.range(40).selectExpr("id AS _row", "id % 4 AS g", "double(id % 2) AS label", "double(id) AS a"), ["a"])
    held = [F.struct(F.lit(p).alias("part"), (F.col("g") == p).alias("asked")) for p in range(4)]
    plain, blocks = forest._plain(rows, "g", "label", held, 10)
    assert blocks == 1 and plain.count() == 4 * 40
