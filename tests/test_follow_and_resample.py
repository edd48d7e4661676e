"""Tables that follow their inputs, resampling and spaced windows of chunks, bootstrap of large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveledger.functions import spectra
from waveledger.operators import chunked, spectral, stats, windows
from waveledger.sources import tables

KEYS = ["path"]


# ---- tables that follow their inputs

def follow(spark, root, state, asked):
    inputs = spark.createDataFrame([(k, len(v), v) for k, v in state.items()], "path string, length bigint, digest string")

    def build(keys):
        names = [r.path for r in keys.collect()]
        asked.append(sorted(names))
        rows = [(n, state[n], i) for n in names for i in range(len(state[n]))]  # an empty content gives no rows
        return spark.createDataFrame(rows, "path string, content string, i int")

    out = tables.incremental_table(spark, root, inputs, build, buckets=4)
    return sorted((r.path, r.content, r.i) for r in out.collect())


def test_only_changed_inputs_are_built(spark, tmp_path):
    root, asked = str(tmp_path / "t"), []
    want = lambda s: sorted((n, v, i) for n, v in s.items() for i in range(len(v)))
    state = {f"f{k}": "ab" * (k % 3) for k in range(12)}
    assert follow(spark, root, state, asked) == want(state)
    assert asked[0] == sorted(state)

    asked.clear()  # the same inputs: nothing is asked for but the empty frame that knows the columns
    assert follow(spark, root, state, asked) == want(state) and asked == [[]]
    assert tables._current(spark, root) == 1

    asked.clear()
    state |= {"f3": "changed", "new": "n"}
    del state["f5"]
    assert follow(spark, root, state, asked) == want(state)
    assert asked[0] == ["f3", "new"] and tables._current(spark, root) == 2
    inputs = spark.createDataFrame([(k, len(v), v + "x" * (k == "f1")) for k, v in state.items()], "path string, length bigint, digest string")
    assert [r.path for r in tables.changed_inputs(spark, root, inputs, buckets=4).collect()] == ["f1"]

    asked.clear()
    assert follow(spark, root, {}, asked) == [] and follow(spark, root, state, asked) == want(state)


def test_an_unfinished_run_is_not_read(spark, tmp_path):
    root, asked = str(tmp_path / "t"), []
    state = {"a": "1", "b": "22"}
    kept = follow(spark, root, state, asked)
    (tmp_path / "t" / "nodes-2").mkdir()  # no marker of success
    (tmp_path / "t" / "v-lost").mkdir()
    assert follow(spark, root, state, asked) == kept and tables._current(spark, root) == 1


# ---- resampling and windows

def pieces(spark, data, seed=0, sizes=(1, 2, 17, 300)):
    rng = random.Random(seed)
    rows = []
    for path, x in data.items():
        at = 0
        while at < len(x):
            n = rng.choice(sizes)
            rows.append((path, at, len(x), [float(v) for v in x[at:at + n]]))
            at += n
    long = [(p, i, len(x), float(v)) for p, x in data.items() for i, v in enumerate(x)]
    return (spark.createDataFrame(rows, "path string, start_sample bigint, n bigint, samples array<double>"),
            spark.createDataFrame(long, "path string, i bigint, n bigint, value double"))


def outputs(df):
    rows = df.select("path", "start_sample", F.posexplode("samples").alias("k", "v")).collect()
    got = {(r.path, r.start_sample + r.k): r.v for r in rows}
    assert len(got) == len(rows)  # every output once
    return got


@pytest.mark.parametrize("source,target", [(8, 12), (12, 8), (50, 1), (1, 7), (44, 48), (5, 5)])
def test_resampled_chunks_equal_the_long_form(spark, source, target):
    rng = np.random.default_rng(source)
    data = {"long": rng.normal(size=700), "short": rng.normal(size=5), "one": [3.0], "flat": [1.0] * 333}
    chunks, long = pieces(spark, data)
    got = outputs(chunked.resample(chunks, KEYS, source, target))
    want = {(r.path, r.i): r.value for r in spectral.resample(long, KEYS, source, target).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_a_megahertz_capture_keeps_its_tone(spark):
    """1 MHz to 20 kHz from chunks, no row per input; the transform is cut into blocks."""
    chunks = spark.range(30).selectExpr(
        "'x' as path", "id * 10000 as start_sample", "300000L as n",
        "transform(sequence(0, 9999), k -> sin(2 * pi() * 1000 * (id * 10000 + k) / 1e6)) as samples")
    got = outputs(chunked.resample(chunks, KEYS, 1_000_000, 20_000))
    y = np.array([got["x", m] for m in range(6000)])
    t = np.arange(6000) / 20_000
    assert np.abs(y - np.sin(2 * np.pi * 1000 * t))[50:-50].max() < 2e-3  # the filter's ripple in its pass band


def test_chunk_longer_than_a_fourier_block(spark, monkeypatch):
    monkeypatch.setattr(spectra, "RESAMPLE_INPUTS", 64)
    x = np.random.default_rng(1).normal(size=1000)
    chunks, long = pieces(spark, {"p": x}, sizes=(1000,))
    got = outputs(chunked.resample(chunks, KEYS, 3, 2))
    want = {(r.path, r.i): r.value for r in spectral.resample(long, KEYS, 3, 2).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9 and got.keys() == want.keys()


@pytest.mark.parametrize("usable,skip", [(8.0, 0.5), (3.0, 0.0), (30.0, 2.0)])
def test_spaced_windows(spark, usable, skip):
    rng = np.random.default_rng(2)
    chunks, long = pieces(spark, {"long": rng.normal(size=500), "short": rng.normal(size=9), "mid": rng.normal(size=60)}, sizes=(1, 4, 9, 40))
    options = {"fs": 8.0, "window_s": 2.0, "n_windows": 4, "usable_s": usable, "skip_s": skip}
    row = lambda r: (r.path, r.segment_index, r.start_sample, r.n_present, tuple(r.samples))
    assert sorted(map(row, chunked.spaced_windows(chunks, KEYS, **options).collect())) == sorted(
        map(row, windows.spaced_windows(long, KEYS, **options).collect()))


# ---- bootstrap

def test_every_draw_is_made_once(spark):
    """All values 1: the draws of an iteration add up to the group, whatever its slices."""
    rows = spark.range(5000).selectExpr("cast(id % 3 = 0 as string) as k", "id", "1.0D as v")
    got = stats.bootstrap_interval_sliced(rows, ["k"], "id", "v", n_iter=50, slice_rows=100).collect()
    assert len(got) == 2 and all(r.mean == r.ci_low == r.ci_high == 1.0 for r in got)


def test_sliced_intervals_have_the_right_width(spark):
    rows = spark.range(20_000).selectExpr("'a' as k", "id", "double(id % 1000) + if(id < 10000, 5000, 0) as v")
    whole = rows.agg(F.avg("v").alias("m"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("e")).first()
    for size in (50_000, 700):
        r = stats.bootstrap_interval_sliced(rows, ["k"], "id", "v", n_iter=1500, slice_rows=size).first()
        assert r.mean == pytest.approx(whole.m)
        assert r.ci_low == pytest.approx(whole.m - 1.96 * whole.e, abs=0.3 * whole.e)
        assert r.ci_high == pytest.approx(whole.m + 1.96 * whole.e, abs=0.3 * whole.e)


def test_sliced_draws_are_repeatable_and_need_no_keys(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 10 = 0, null, rand(3)) as v")
    kept = rows.where("v is not null").collect()
    frames = [spark.createDataFrame(kept, "id bigint, v double").repartition(n) for n in (1, 5)]
    a, b = (stats.bootstrap_interval_sliced(f, [], "id", "v", n_iter=200, slice_rows=64).first() for f in frames)
    assert a.ci_low == pytest.approx(b.ci_low, rel=1e-12) and a.ci_high == pytest.approx(b.ci_high, rel=1e-12)
    assert stats.bootstrap_interval_sliced(frames[0].where("false"), [], "id", "v").count() == 0
