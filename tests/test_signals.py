"""Signals with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveledger.functions import arrays as A, spectra
from waveledger.operators import quality, spectral, timefeat, windows


def frame(spark, *signals):
    return spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(signals)],
                                 "id int, samples array<double>")


def long(spark, values, rec=1):
    n = len(values)
    return spark.createDataFrame([(rec, i, float(v), n) for i, v in enumerate(values)],
                                 "recording_id int, i bigint, value double, n bigint")


def test_sine_short_features(spark):
    n, fs = 22050, 44100
    x = 0.25 * np.sin(2 * np.pi * 300 * np.arange(n) / fs)
    row = spectral.short_features(frame(spark, x), fs).first()
    assert row.RMS == pytest.approx(0.25 / math.sqrt(2))
    assert row.CF == pytest.approx(math.sqrt(2), abs=1e-3)
    assert row.Kurtosis == pytest.approx(1.5, abs=1e-6)
    assert row.band_250_500 == pytest.approx(1.0)


def test_rejected_windows_keep_their_row(spark):
    rows = spectral.short_features(
        frame(spark, [0.0] * 64, [float("nan")] * 64, [3.0] * 64), 64.0,
        bands=[(0, 10)]).orderBy("id").collect()
    assert [r.status for r in rows] == ["zero energy", "non-finite", "zero energy"]
    assert all(r.RMS is None and r.band_0_10 is None for r in rows)


@pytest.mark.parametrize("n", [1000, 1001])
def test_amplitude_of_constant(spark, n):
    out = spectral.amplitude_spectrum(frame(spark, [3.0] * n)).first().amplitude
    assert out[0] == pytest.approx(3.0)


def test_amplitude_at_nyquist_and_sine(spark):
    alternating = [2.0, -2.0] * 500
    sine = 4 * np.sin(2 * np.pi * 100 * np.arange(1000) / 1000)
    a, b = [r.amplitude for r in spectral.amplitude_spectrum(
        frame(spark, alternating, sine)).orderBy("id").collect()]
    assert a[-1] == pytest.approx(2.0)
    assert b[100] == pytest.approx(4.0, rel=1e-3)


@pytest.mark.parametrize("n", [10000, 10001])
def test_dc_and_tone(spark, n):
    x = 0.4 + 0.25 * np.cos(2 * np.pi * 300 * np.arange(n) / 10000)
    amp = spectral.amplitude_spectrum(frame(spark, x)).first().amplitude
    step = 10000 / n
    assert amp[0] == pytest.approx(0.4, abs=1e-3)
    assert amp[round(300 / step)] == pytest.approx(0.25, rel=1e-2)


def test_spectrum_kernels_skip_bad_rows(spark):
    rows = frame(spark, [1.0, float("nan"), 2.0], [1.0, 2.0, 4.0], []).select(
        "id", spectra.raw_magnitude("samples").alias("m")).orderBy("id").collect()
    assert rows[0].m is None and len(rows[1].m) == 2 and rows[2].m is None


def test_window_lengths_and_bounds(spark):
    assert windows.window_lengths(2.0, 0.5, 16000) == (32000, 16000)
    with pytest.raises(ValueError):
        windows.window_lengths(0, 0.5, 10)
    with pytest.raises(ValueError):
        windows.window_lengths(1, 1.0, 10)
    counts = spark.range(1).select(
        windows.window_count(F.lit(18 * 16000), 32000, 16000).alias("a"),
        windows.window_count(F.lit(40001), 40000, 20000).alias("b"),
        windows.window_count(F.lit(39999), 40000, 20000).alias("c")).first()
    assert tuple(counts) == (17, 1, 0)


@pytest.mark.parametrize("size,hop", [(8, 4), (7, 3), (5, 5), (6, 1)])
def test_sliding_windows_match_slices(spark, size, hop):
    x = np.arange(23) ** 1.5
    got = {r.segment_index: (r.start_sample, r.samples) for r in windows.sliding_windows(
        long(spark, x), ["recording_id"], size, hop).collect()}
    want = {k: (s, list(x[s:s + size])) for k, s in enumerate(range(0, 23 - size + 1, hop))}
    assert got == want


@pytest.mark.parametrize("chunk", [4, 9, 64])
@pytest.mark.parametrize("size,hop", [(8, 4), (7, 3), (20, 20), (6, 1)])
def test_windows_from_chunks_match_slices(spark, chunk, size, hop):
    x = [float(v) for v in np.arange(43) ** 1.5]
    rows = [("a", s, x[s:s + chunk], 43) for s in range(0, 43, chunk)]
    chunks = spark.createDataFrame(rows, "k string, start_sample bigint, samples array<double>, n bigint")
    got = [(r.segment_index, r.start_sample, r.samples) for r in windows.windows_from_chunks(
        chunks, ["k"], size, hop).orderBy("segment_index").collect()]
    assert got == [(k, s, x[s:s + size]) for k, s in enumerate(range(0, 43 - size + 1, hop))]


def test_time_features_need_32_samples(spark):
    rows = timefeat.window_time_features(frame(spark, range(31), range(32))).orderBy("id").collect()
    assert rows[0].feat_valid == 0.0 and rows[0].rms is None
    assert rows[1].feat_valid == 1.0 and rows[1].skew == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("n", [1, 7, 2000, 10007])
def test_envelope_covers_every_sample(spark, n):
    x = np.sin(np.arange(n))
    x[-1] = 50
    rows = windows.envelope(long(spark, x), ["recording_id"], 1.0, bins=2000).orderBy("bin").collect()
    assert len(rows) == min(n, 2000)
    assert sum(r.n_samples for r in rows) == n and rows[-1].high == 50
    edges = [int(b * n / len(rows)) for b in range(len(rows) + 1)]
    assert [r.n_samples for r in rows] == list(np.diff(edges))


def test_quiet_start_is_found(spark):
    fs = 1000.0
    x = [0.0] * 270 + [0.1 * (-1) ** k for k in range(5730)]
    block = quality.block_samples(fs)
    s = long(spark, x)
    blocks = quality.quiet_blocks(s, ["recording_id"], block)
    assert quality.leading_quiet(s, blocks, ["recording_id"], block, fs).first()[1] == pytest.approx(0.27)
    runs = quality.long_quiet_runs(quality.quiet_runs(blocks, ["recording_id"], block, fs), block, fs)
    assert {(r.kind, r.start_s, round(r.end_s, 6)) for r in runs.collect()} == {
        ("flat", 0.0, 0.27), ("silent", 0.0, 0.27)}


def test_all_quiet_and_too_short(spark):
    s = long(spark, [0.0] * 40)
    blocks = quality.quiet_blocks(s, ["recording_id"], 10)
    assert quality.leading_quiet(s, blocks, ["recording_id"], 10, 10.0).first()[1] == 4.0
    s = long(spark, [1.0, 2.0])
    blocks = quality.quiet_blocks(s, ["recording_id"], 10)
    assert quality.leading_quiet(s, blocks, ["recording_id"], 10, 10.0).first()[1] == 0.0


def test_zero_baseline(spark):
    base = [0.0] * 200 + [10.0 + k % 5 for k in range(300)]
    live = [0.0 if k % 7 == 0 else 20.0 for k in range(500)]
    got = quality.zero_baseline(long(spark, base), ["recording_id"]).first()
    assert got.zero_is_baseline and got.base_run == 200 and got.headroom_code == 10
    assert not quality.zero_baseline(long(spark, live), ["recording_id"]).first().zero_is_baseline


def test_resample_keeps_a_tone(spark):
    fs, up = 800, 1600
    t = np.arange(4000) / fs
    out = spectral.resample(long(spark, np.sin(2 * np.pi * 20 * t)), ["recording_id"], fs, up,
                            block=700).orderBy("i").collect()
    assert [r.i for r in out] == list(range(8000))
    y = np.array([r.value for r in out])
    want = np.sin(2 * np.pi * 20 * np.arange(8000) / up)
    assert np.max(np.abs(y[200:-200] - want[200:-200])) < 2e-3


@pytest.mark.parametrize("src,dst", [(8, 12), (441, 160), (50, 1)])
def test_resample_matches_direct_sum(spark, src, dst):
    from math import gcd

    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    up, down = dst // gcd(src, dst), src // gcd(src, dst)
    taps = spectra.resampling_filter(up, down)
    half = len(taps) // 2
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[half:half + len(wide)]
    n_out = -(-len(x) * up // down)
    want = np.pad(full, (0, down * n_out))[::down][:n_out]
    out = spectral.resample(long(spark, x), ["recording_id"], src, dst, block=64).orderBy("i").collect()
    assert len(out) == n_out
    assert np.allclose([r.value for r in out], want, atol=1e-9)


def test_log_mel_shape_and_scale(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    row = spectral.log_mel(frame(spark, x, x[:9000]), 16000, need=16000).orderBy("id").collect()
    for r in row:
        z = np.array(r.log_mel).reshape(64, 64)
        assert abs(z.mean()) < 1e-9 and z.std() == pytest.approx(1.0, abs=1e-3)
        assert np.array_equal(z[:, 62], z[:, 63])
    # 440 Hz lies in the lower part of the scale.
    assert 5 < np.array(row[0].log_mel).reshape(64, 64)[:, 30].argmax() < 15


def test_mel_filters_have_equal_area_and_cover(spark):
    bank = spectra.mel_filters(16000, 1024, 64)
    assert bank.shape == (64, 513) and (bank >= 0).all() and (bank.max(axis=1) > 0).all()


def test_welch_uses_all_segments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1000)
    got = np.array(spectral.welch_psd(frame(spark, x), 50.0, segment=256).first().psd)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    acc = []
    for s in range(0, 1000 - 256 + 1, 128):
        seg = x[s:s + 256] - x[s:s + 256].mean()
        p = np.abs(np.fft.rfft(seg * w)) ** 2 / (50.0 * (w * w).sum())
        p[1:-1] *= 2
        acc.append(p)
    assert np.allclose(got, np.mean(acc, axis=0))


def test_mono_and_fit(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0], [5.0, 7.0]],)], "c array<array<double>>")
    row = df.select(A.mono("c").alias("m"), A.fit_length(F.col("c")[0], 4).alias("f"),
                    A.fit_length(F.col("c")[0], 1).alias("g")).first()
    assert row.m == [3.0, 5.0] and row.f == [1.0, 3.0, 0.0, 0.0] and row.g == [1.0]


def test_stereo_summary_and_dc(spark):
    df = spark.createDataFrame([("a", "L", 1.0), ("a", "L", 3.0), ("a", "R", -5.0), ("a", "R", -1.0)],
                               "recording_id string, channel string, value double")
    row = timefeat.worst_dc_offset(df, ["recording_id"], "channel").first()
    assert row.dc_offset == -3.0 and row.channels == 2
    unknown = timefeat.clipping(df, ["recording_id"], None, None).first()
    assert unknown.clip_count is None and unknown.clipping_status == "unverifiable"


def test_sql_names(spark):
    from waveledger.functions.register import register

    register(spark)
    frame(spark, [3.0] * 100).createOrReplaceTempView("w")
    row = spark.sql("SELECT amplitude_spectrum(samples) AS a, power_spectrum(samples) AS p FROM w").first()
    assert row.a[0] == pytest.approx(3.0) and max(row.p) == pytest.approx(0.0)


def test_resampling_a_fast_recording(spark):
    """1 MHz to 20 kHz, as the default of the original: a slow tone survives, in small blocks."""
    from waveledger.operators import spectral

    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.lit(n).cast("bigint").alias("n"),
                               F.sin(F.col("id") * 2 * np.pi * 500 / 1e6).alias("value"))
    got = np.array([r.value for r in spectral.resample(df, ["k"], 1_000_000, 20_000, block=20_000).orderBy("i").collect()])
    want = np.sin(np.arange(len(got)) * 2 * np.pi * 500 / 20_000)
    assert len(got) == 1200 and np.abs(got - want)[30:-30].max() < 0.01
