"""Sliced ranks, quantiles and runs against plain computations, also with one huge group."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from waveledger.functions import ordered
from waveledger.operators import knn, metrics, stats


def values(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "k string, v double")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {
        "hot": np.concatenate([rng.normal(size=4000), [0.0] * 900, rng.normal(size=50) * 1e9]),
        "ties": [2.0] * 7 + [5.0] * 2, "one": [-3.5], "tiny": [1e-12, -1e-12, 3e-300, 0.0],
        "neg": -rng.exponential(size=333)}
    probs = {"p01": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1.0}
    got = {r.k: r for r in ordered.quantiles(values(spark, groups), ["k"], "v", probs).collect()}
    for k, vs in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300)


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", 4.0), ("a", 2.0)],
                               "k string, v double")
    assert ordered.quantiles(df, ["k"], "v", {"m": 0.5}).first().m == 3.0


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False), st.floats(allow_nan=False, allow_infinity=False))
def test_slices_never_decrease(a, b):
    """The slice rule, replayed in Python: order of slices follows order of values."""
    import math

    def slice_of(v):
        level = math.floor((math.log2(max(abs(v), 1e-300)) + 1000.0) * 1024) + 1
        return level if v > 0 else -level if v < 0 else 0

    lo, hi = min(a, b), max(a, b)
    assert slice_of(lo) <= slice_of(hi)


def test_slice_expression_is_monotone(spark):
    rng = np.random.default_rng(2)
    v = np.sort(np.concatenate([rng.normal(size=500), rng.normal(size=500) * 1e-200, [0.0, 1e300]]))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    slices = [r.s for r in df.select("v", ordered.value_slice("v").alias("s")).orderBy("v").collect()]
    assert slices == sorted(slices)


@pytest.mark.parametrize("target", [1, 3, 1000])
def test_index_by_time(spark, target):
    import datetime as dt

    base = dt.datetime(2024, 3, 31, 0, 59, 0)
    rng = np.random.default_rng(target)
    rows = [(k, base + dt.timedelta(seconds=int(rng.integers(0, 50))), e)
            for e, k in enumerate(["hot"] * 60 + ["a"] * 5 + ["b"])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, e bigint")
    got = {(r.k, r.e): (r.i, r.n) for r in ordered.index_by_time(
        df, ["k"], "ts", "e", target_rows=target).collect()}
    for key in ("hot", "a", "b"):
        mine = sorted([(t, e) for k, t, e in rows if k == key])
        assert {(key, e): (i, len(mine)) for i, (t, e) in enumerate(mine)} == {
            x: y for x, y in got.items() if x[0] == key}


@pytest.mark.parametrize("slice_len", [1, 4, 7, 100])
def test_runs_cross_slices(spark, slice_len):
    rng = np.random.default_rng(5)
    flags = {"a": rng.random(200) < 0.7, "b": np.ones(30, bool), "c": np.zeros(9, bool)}
    df = spark.createDataFrame([(k, i, bool(f)) for k, fs in flags.items() for i, f in enumerate(fs)],
                               "k string, i bigint, f boolean")
    got = {(r.k, r.start, r.end) for r in ordered.runs(df, ["k"], "i", F.col("f"), slice_len).collect()}
    want = set()
    for k, fs in flags.items():
        edge = np.diff(np.concatenate([[0], fs.astype(int), [0]]))
        want |= {(k, int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_with_next(spark, chunk):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(10)], "k string, i bigint, v double")
    rows = ordered.with_next(df, ["k"], "i", ["v"], chunk).orderBy("i").collect()
    assert [r.next_v for r in rows] == [float((i + 1) ** 2) for i in range(9)] + [None]


def test_average_ranks(spark):
    df = values(spark, {"a": [1, 1, 2, 5, 5, 5]})
    got = {r.v: (r.ties, r.avg_rank, r.n) for r in ordered.average_ranks(df, ["k"], "v").collect()}
    assert got == {1.0: (2, 1.5, 6), 2.0: (1, 3.0, 6), 5.0: (3, 5.0, 6)}


@pytest.mark.parametrize("pivots,block,spread", [(1, 13, 0), (7, 13, 0), (200, 1000, 0), (9, 5, 50)])
def test_knn_cells_equal_brute_force(spark, pivots, block, spread):
    """Ties everywhere; `spread` puts the points into far clusters, so that cells are skipped."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, size=(120, 3)).astype(float)
    x[:, 0] += spread * (np.arange(120) % 4)
    rows = [(i, [float(v) for v in x[i]], int(i % 3), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int, fold bigint")
    train, test = df.where("id < 80"), df.where("id >= 80")
    got = {}
    for r in knn.nearest(train, test, 5, ["fold"], "id", "v", "label", pivots, block).collect():
        got.setdefault(r.test_id, {})[r.rank] = (r.train_id, r.distance2)
    for t in range(80, 120):
        d = ((x[:80] - x[t]) ** 2).sum(axis=1)
        best = sorted(range(80), key=lambda j: (d[j], j))[:5]
        assert got[t] == {k + 1: (j, d[j]) for k, j in enumerate(best)}


def test_signed_rank_known_values(spark):
    def p(*d):
        df = spark.createDataFrame([("x", float(v)) for v in d], "k string, d double")
        return stats.signed_rank(df, ["k"], "d").first()

    assert p(1, 2, 3, 4, 5).p_value == pytest.approx(2 / 32)
    assert p(-1, 2, 3, 4, 5).p_value == pytest.approx(4 / 32)
    assert p(0, 0, 0).p_value == 1.0 and p(0, 0, 0).n == 0
    assert p(0.5, -1.5, 2.5, 0, -3.5, 4.5).n == 5
    # n = 60: normal approximation, z from n(n+1)/4 and its variance.
    row = p(*range(1, 61))
    assert row.z == pytest.approx((0 - 915) / np.sqrt(60 * 61 * 121 / 24))
    assert 0 < row.p_value < 1e-9


def test_roc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double").select(
        (F.col("y") == 1).alias("positive"), "s", F.lit("c").alias("class"))
    out = metrics.auc(metrics.roc_points(df, ["class"], "s", "positive"), ["class"]).first()
    assert out.auc == pytest.approx(0.875)


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "t double, p double")
    row = metrics.regression_metrics(df, "t", "p").first()
    assert row.r2 is None and row.mae == 1.0 and row.median_abs_err == 1.0


def test_fixed_labels_keep_zero_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "t int, p int")
    rows = {r.label: r for r in metrics.class_report(df, "t", "p", labels=[0, 1, 2]).collect()}
    assert rows[2].f1 == 0.0 and rows[0].precision == 0.5 and rows[1].recall == 0.0
    assert metrics.class_metrics(df, "t", "p", labels=[0, 1, 2]).first().macro_f1 == pytest.approx(
        (2 / 3) / 3)


def test_time_slices_follow_each_recording(spark, monkeypatch):
    """Short recordings in a long campaign, and bursts in one recording: no slice far above its target."""
    from pyspark.sql import functions as F

    from waveledger.functions import ordered

    rows = spark.range(20_000).select(
        (F.col("id") % 10).alias("k"), F.col("id").alias("e"),
        F.timestamp_micros(F.when(F.col("id") % 10 < 9, (F.col("id") % 10) * 10**12 + F.col("id") * 1000)
                           .otherwise(F.when(F.col("id") < 19_000, F.col("id")).otherwise(10**11 + F.col("id") * 10**6))).alias("ts"))
    seen = []
    plain = ordered.running_sums

    def spy(df, keys, order, slice_of, sums, totals=None):
        seen.append(df.withColumn("_s", slice_of).groupBy(*keys, "_s").count().agg(F.max("count")).first()[0])
        return plain(df, keys, order, slice_of, sums, totals)

    monkeypatch.setattr(ordered, "running_sums", spy)
    got = ordered.index_by_time(rows, ["k"], "ts", "e", target_rows=200).collect()
    assert seen[0] <= 400
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append(r)
    for mine in by_key.values():
        assert [r.i for r in sorted(mine, key=lambda r: (r.ts, r.e))] == list(range(len(mine)))


def test_infinities_have_slices(spark):
    from waveledger.functions import ordered
    from waveledger.operators import metrics, voting

    inf = float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", inf), ("a", 2.0), ("b", -inf), ("b", 0.0), ("b", 5.0), ("c", inf)],
                               "k string, v double")
    got = {r.k: r.m for r in ordered.quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": 0.0, "c": inf}
    slices = [r.s for r in df.select(ordered.value_slice("v").alias("s"), "v").orderBy("v").collect()]
    assert slices == sorted(slices)
    assert {r.k: r.p for r in voting.median_vote(df, ["k"], "v", "p").collect()} == got
    ranks = {(r.k, r.v): r.avg_rank for r in ordered.average_ranks(df, ["k"], "v").collect()}
    assert ranks["a", inf] == 3.0 and ranks["b", -inf] == 1.0
    scored = spark.createDataFrame([(inf, True), (1.0, False), (0.5, True), (-inf, False)], "s double, p boolean")
    points = metrics.roc_points(scored, [], "s", "p")
    assert metrics.auc(points, []).first().auc == 0.75
