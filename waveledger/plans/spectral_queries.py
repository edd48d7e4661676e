"""Spectral queries over embeddings read as 64-sample windows at a notional 64 Hz."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveledger.functions.scalars import rounded
from waveledger.operators import chunked, spectral, timefeat, windows
from waveledger.plans import standins as S
from waveledger.plans.registry import ORACLES, query

FS = S.UNIT_RATE
STEP = F.lit  # step column helper: STEP(1.0) is 1 Hz

_AC = "ac AS (SELECT vec_id, label, group_id, j, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM win)"
_SIDES = "CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END"
# Sum of squares of the 64-point periodic Hann window is 3/8 of its length.
_PSD = f"psd AS (SELECT vec_id, k, (re * re + im * im) / 24.0 / 64.0 * {_SIDES} AS p FROM dft)"

# Mean of three half-overlapping 32-sample segments, each centred: bins 2 Hz apart.
_WELCH32 = f"""seg AS (
  SELECT vec_id * 10 + s AS sid, vec_id, s, j - s * 16 AS j,
         x - avg(x) OVER (PARTITION BY vec_id, s) AS x
  FROM win, range(3) t(s) WHERE j >= s * 16 AND j < s * 16 + 32),
{S.dft("seg", "sid", 32, S.periodic_hann(32))},
welch AS (
  SELECT sid // 10 AS vec_id, k, avg((re * re + im * im) / 12.0 / 64.0
         * CASE WHEN k = 0 OR k = 16 THEN 1 ELSE 2 END) AS p
  FROM dft GROUP BY sid // 10, k)"""


@query("welch_psd", f"""
WITH {S.WIN}, {_WELCH32}
SELECT vec_id, k AS bin, round(k * 2.0, 6) + 0.0 AS freq, round(greatest(p, 1e-18), 8) + 0.0 AS psd
FROM welch""")
def welch_psd(spark, sf):
    out = spectral.welch_psd(S.windows(spark, sf), FS, segment=32)
    long = spectral.bins_long(out, ["vec_id"], "psd", FS / 32, "p")
    return long.select("vec_id", F.col("bin").cast("bigint").alias("bin"),
                       rounded("freq").alias("freq"), rounded("p", 8).alias("psd"))


@query("periodogram", f"""
WITH {S.WIN}, {S.dft("win", "vec_id", 64, S.periodic_hann(64))}, {_PSD}
SELECT vec_id, k AS bin, round(p, 8) + 0.0 AS psd FROM psd""")
def periodogram(spark, sf):
    out = spectral.periodogram(S.windows(spark, sf), FS)
    long = spectral.bins_long(out, ["vec_id"], "psd", 1.0, "p")
    return long.select("vec_id", F.col("bin").cast("bigint").alias("bin"),
                       rounded("p", 8).alias("psd"))


@query("amplitude_spectrum", f"""
WITH {S.WIN}, {S.dft("win", "vec_id", 64, S.symmetric_hann(64))}
SELECT vec_id, k AS bin, round(sqrt(re * re + im * im) / 31.5 * {_SIDES}, 6) + 0.0 AS amplitude FROM dft""")
def amplitude_spectrum(spark, sf):
    out = spectral.amplitude_spectrum(S.windows(spark, sf))
    long = spectral.bins_long(out, ["vec_id"], "amplitude", 1.0, "a")
    return long.select("vec_id", F.col("bin").cast("bigint").alias("bin"),
                       rounded("a").alias("amplitude"))


@query("dominant_freq", f"""
WITH {S.WIN}, {_AC},
{S.dft("ac", "vec_id", 64, S.periodic_hann(64), "d1")},
{S.dft("ac", "vec_id", 64, "1.0", "d2")},
{S.dft("ac", "vec_id", 64, S.symmetric_hann(64), "d3")},
seg AS (SELECT vec_id, j, x * ({S.periodic_hann(64)}) AS y, x FROM ac),
a AS (SELECT vec_id, k FROM d1 QUALIFY row_number() OVER (
        PARTITION BY vec_id ORDER BY (re * re + im * im) * {_SIDES} DESC, k) = 1),
b AS (SELECT vec_id, k FROM d2 WHERE k > 0 QUALIFY row_number() OVER (
        PARTITION BY vec_id ORDER BY re * re + im * im DESC, k) = 1),
c AS (SELECT vec_id, k FROM d3 WHERE k >= 10 QUALIFY row_number() OVER (
        PARTITION BY vec_id ORDER BY re * re + im * im DESC, k) = 1)
SELECT a.vec_id, a.k::DOUBLE AS dom_psd, b.k::DOUBLE AS dom_fft, c.k::DOUBLE AS dom_hann
FROM a JOIN b USING (vec_id) JOIN c USING (vec_id)""")
def dominant_freq(spark, sf):
    out = spectral.dominant_frequencies(S.windows(spark, sf), FS)
    return out.select("vec_id", "dom_psd", "dom_fft", "dom_hann")


_SHAPE = f"""tot AS (SELECT vec_id, sum(p) AS total, sum(k * p) / sum(p) AS centroid FROM psd GROUP BY vec_id),
cdf AS (SELECT vec_id, k, p, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM psd),
shape AS (
  SELECT vec_id, arg_max(k, p) AS dom, any_value(t.centroid) AS centroid,
         sqrt(sum((k - t.centroid) * (k - t.centroid) * p) / any_value(t.total)) AS bandwidth,
         coalesce(min(k) FILTER (WHERE run / t.total >= 0.85), 32) AS rolloff
  FROM cdf JOIN tot t USING (vec_id) GROUP BY vec_id)"""
_BANDS = ", ".join(
    f"sum(p) FILTER (WHERE k >= {lo} AND k < {hi}) / sum(p) AS band_{lo}_{hi}"
    for lo, hi in S.UNIT_BANDS)
_BAND_NAMES = [f"band_{lo}_{hi}" for lo, hi in S.UNIT_BANDS]
_BAND_ROUNDED = ", ".join(f"round({b}, 6) + 0.0 AS {b}" for b in _BAND_NAMES)


@query("spectral_shape", f"""
WITH {S.WIN}, {S.dft("win", "vec_id", 64, S.periodic_hann(64))}, {_PSD}, {_SHAPE}
SELECT vec_id, dom::DOUBLE AS dom_freq, round(centroid, 6) + 0.0 AS spec_centroid,
       round(bandwidth, 6) + 0.0 AS spec_bandwidth, rolloff::DOUBLE AS spec_rolloff85 FROM shape""")
def spectral_shape(spark, sf):
    df = spectral.periodogram(S.windows(spark, sf), FS)
    out = spectral.spectral_shape(df, "psd", F.lit(1.0))
    return out.select("vec_id", "dom_freq", rounded("spec_centroid").alias("spec_centroid"),
                      rounded("spec_bandwidth").alias("spec_bandwidth"), "spec_rolloff85")


@query("band_power", f"""
WITH {S.WIN}, {S.dft("win", "vec_id", 64, S.periodic_hann(64))}, {_PSD},
b AS (SELECT vec_id, {_BANDS} FROM psd GROUP BY vec_id)
SELECT vec_id, {_BAND_ROUNDED} FROM b""")
def band_power(spark, sf):
    df = spectral.periodogram(S.windows(spark, sf), FS)
    out = spectral.band_power(df, "psd", F.lit(1.0), S.UNIT_BANDS)
    return out.select("vec_id", *[rounded(b).alias(b) for b in _BAND_NAMES])


@query("spectrogram", f"""
WITH {S.WIN}, fr AS (
  SELECT vec_id * 10 + f AS fid, vec_id, f, j - f * 8 AS j, x FROM win, range(7) t(f)
  WHERE j >= f * 8 AND j < f * 8 + 16),
{S.dft("fr", "fid", 16, S.periodic_hann(16))}
SELECT fid // 10 AS vec_id, fid % 10 AS frame, k AS bin, round((fid % 10 * 8 + 8) / 64.0 + 1.0, 6) + 0.0 AS t,
  round(k * 4.0, 6) + 0.0 AS freq,
  round(10 * log10(greatest((re * re + im * im) / 6.0 / 64.0 * CASE WHEN k = 0 OR k = 8 THEN 1 ELSE 2 END, 1e-20)), 5)
    + 0.0 AS db
FROM dft WHERE k * 4.0 <= 24.0""")
def spectrogram(spark, sf):
    out = spectral.spectrogram_db(S.windows(spark, sf), ["vec_id"], FS, 16, 8, 24.0, start_s=1.0)
    return out.select("vec_id", F.col("frame").cast("bigint").alias("frame"),
                      F.col("bin").cast("bigint").alias("bin"), rounded("t").alias("t"),
                      rounded("freq").alias("freq"), rounded("db", 5).alias("db"))


@query("log_mel", f"""
WITH {S.WIN}, fr AS (
  SELECT vec_id * 100 + f AS fid, j + 8 - f * 4 AS j, x FROM win, range(17) t(f) WHERE j + 8 >= f * 4 AND j + 8 < f * 4 + 16),
{S.dft("fr", "fid", 16, S.periodic_hann(16))},
bank AS (SELECT b, k, greatest(0, least((k * 4.0 - b * 32.0 / 7) / (32.0 / 7), ((b + 2) * 32.0 / 7 - k * 4.0) / (32.0 / 7)))
  * 2 / (2 * 32.0 / 7) AS wt FROM range(6) p(b), range(9) q(k)),
mel AS (SELECT fid // 100 AS vec_id, fid % 100 AS f, b, sum(wt * (re * re + im * im)) AS p FROM dft JOIN bank USING (k) GROUP BY ALL),
db AS (SELECT vec_id, f, b, 10 * log10(greatest(p, 1e-10)) - 10 * log10(greatest(max(p) OVER (PARTITION BY vec_id), 1e-10)) AS d FROM mel),
cut AS (SELECT vec_id, f, b, greatest(d, max(d) OVER (PARTITION BY vec_id) - 80) AS d FROM db),
pad AS (SELECT * FROM cut UNION ALL SELECT vec_id, 17, b, d FROM cut WHERE f = 16)
SELECT vec_id, b AS band, f AS frame, round((d - avg(d) OVER w) / (stddev_pop(d) OVER w + 1e-6), 5) + 0.0 AS z
FROM pad WINDOW w AS (PARTITION BY vec_id)""")
def log_mel(spark, sf):
    out = spectral.log_mel(S.windows(spark, sf), FS, need=64, n_fft=16, hop=4, n_mels=6, frames=18)
    return out.select("vec_id", F.posexplode("log_mel").alias("cell", "z")).select(
        "vec_id", F.floor(F.col("cell") / 18).alias("band"), (F.col("cell") % 18).cast("bigint").alias("frame"),
        rounded("z", 5).alias("z"))


@query("log_psd_grid", f"""
WITH {S.WIN}, {_WELCH32},
db AS (SELECT vec_id, k, 10 * log10(p + 1e-20) AS d FROM welch WHERE k * 2.0 <= 30.0),
grid AS (SELECT g, least(g * 30.0 / 20 / 2.0, 15.0) AS pos FROM range(21) t(g)),
pts AS (
  SELECT a.vec_id, g, a.d + (b.d - a.d) * (pos - floor(pos)) AS v
  FROM grid JOIN db a ON a.k = floor(pos) JOIN db b ON b.vec_id = a.vec_id AND b.k = least(floor(pos) + 1, 15))
SELECT vec_id, g AS point,
  round((v - avg(v) OVER (PARTITION BY vec_id)) / (stddev_pop(v) OVER (PARTITION BY vec_id) + 1e-6), 5) + 0.0 AS z
FROM pts""")
def log_psd_grid(spark, sf):
    out = spectral.log_psd(S.windows(spark, sf), FS, need=64, max_hz=30.0, points=21, segment=32)
    return out.select("vec_id", F.posexplode("log_psd").alias("point", "z")).select(
        "vec_id", F.col("point").cast("bigint").alias("point"), rounded("z", 5).alias("z"))


@query("preprocess", f"""
WITH {S.WIN}, mixed AS (
  SELECT a.vec_id, a.j, (a.x + b.x) / 2 AS x
  FROM win a JOIN win b ON a.vec_id = b.vec_id AND b.j = 63 - a.j),
ac AS (SELECT vec_id, j, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM mixed),
padded AS (SELECT vec_id, j, x FROM ac UNION ALL
           SELECT vec_id, t.j, 0.0 FROM (SELECT DISTINCT vec_id FROM win), range(64, 80) t(j))
SELECT vec_id, j, round(x, 6) + 0.0 AS x FROM padded""")
def preprocess(spark, sf):
    from waveledger.functions import arrays as A

    two = S.windows(spark, sf).withColumn("channels", F.array("samples", F.reverse("samples")))
    mono = two.withColumn("mono", A.mono("channels"))
    ac = mono.withColumn("ac", A.centred("mono", A.mean("mono")))
    fit = ac.withColumn("fit", A.fit_length("ac", 80))
    return fit.select("vec_id", F.posexplode("fit").alias("j", "x")).select(
        "vec_id", F.col("j").cast("bigint").alias("j"), rounded("x").alias("x"))


@query("harmonic_amplitude", f"""
WITH {S.WIN}, {S.dft("win", "vec_id", 64, S.symmetric_hann(64))},
amp AS (SELECT vec_id, k, sqrt(re * re + im * im) / 31.5 * {_SIDES} AS a FROM dft),
mk AS (SELECT unnest([3.0, 6.0, 9.5, 12.25])::DOUBLE AS marker_hz)
SELECT vec_id, marker_hz, k AS bin, k::DOUBLE AS freq, round(a, 6) + 0.0 AS amplitude
FROM amp, mk QUALIFY row_number() OVER (PARTITION BY vec_id, marker_hz ORDER BY abs(k - marker_hz), k) = 1""")
def harmonic_amplitude(spark, sf):
    df = spectral.amplitude_spectrum(S.windows(spark, sf))
    out = spectral.harmonic_amplitudes(df, ["vec_id"], "amplitude", F.lit(1.0), [3.0, 6.0, 9.5, 12.25])
    return out.select("vec_id", "marker_hz", F.col("bin").cast("bigint").alias("bin"), "freq",
                      rounded("amplitude").alias("amplitude"))


_FLAGSHIP_SQL = f"""
WITH {S.WIN}, {_AC}, {S.dft("ac", "vec_id", 64, S.periodic_hann(64))}, {_PSD}, {_SHAPE},
b AS (SELECT vec_id, {_BANDS} FROM psd GROUP BY vec_id),
m AS (SELECT vec_id, any_value(label) AS label, any_value(group_id) AS group_id,
        avg(x * x) AS m2, avg(x * x * x * x) AS m4, max(abs(x)) AS peak, max(x) - min(x) AS ptp
      FROM ac GROUP BY vec_id),
feat AS (
  SELECT vec_id, label, group_id, sqrt(m2) AS "RMS", ptp AS "PTP", peak / sqrt(m2) AS "CF",
         m4 / (m2 * m2) AS "Kurtosis", {", ".join(_BAND_NAMES)}
  FROM m JOIN b USING (vec_id))"""
_SHORT = ["RMS", "PTP", "CF", "Kurtosis", *_BAND_NAMES]


def short_window_table(spark, sf):
    """The flagship feature table: one short feature row per window."""
    return spectral.short_features(S.windows(spark, sf), FS, bands=S.UNIT_BANDS)


@query("window_features", _FLAGSHIP_SQL + """
SELECT vec_id, label, group_id, 'ok' AS status, """ + ", ".join(
    f'round("{c}", 6) + 0.0 AS "{c}"' for c in _SHORT) + " FROM feat")
def window_features(spark, sf):
    return short_window_table(spark, sf).select(
        "vec_id", "label", "group_id", "status", *[rounded(c).alias(c) for c in _SHORT])


@query("window_feature_means", _FLAGSHIP_SQL + """
SELECT group_id, count(*) AS n_windows, """ + ", ".join(
    f'round(avg("{c}"), 6) + 0.0 AS "{c}"' for c in _SHORT) + " FROM feat GROUP BY group_id")
def window_feature_means(spark, sf):
    out = timefeat.recording_means(short_window_table(spark, sf), ["group_id"], _SHORT)
    return out.select("group_id", "n_windows", *[rounded(c).alias(c) for c in _SHORT])


_LONG_NAMES = ["mean", "std", "rms", "peak", "crest", "zcr", "skew", "kurtosis", "dom_freq",
               "spec_centroid", "spec_bandwidth", "spec_rolloff85", *_BAND_NAMES]


@query("benchmark_features", f"""
WITH {S.WIN}, {_AC}, {S.dft("ac", "vec_id", 64, S.periodic_hann(64))}, {_PSD}, {_SHAPE},
b AS (SELECT vec_id, {_BANDS} FROM psd GROUP BY vec_id),
pr AS (SELECT *, x * lag(x) OVER (PARTITION BY vec_id ORDER BY j) AS prod FROM ac),
m AS (SELECT vec_id, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4,
             max(abs(x)) AS pk, count(*) FILTER (WHERE prod < 0) AS crossings FROM pr GROUP BY vec_id),
f AS (SELECT vec_id, m1 AS mean, sqrt(m2) AS std, sqrt(m2) AS rms, pk AS peak, pk / (sqrt(m2) + 1e-12) AS crest,
        crossings / 63.0 AS zcr, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurtosis, dom::DOUBLE AS dom_freq,
        centroid AS spec_centroid, bandwidth AS spec_bandwidth, rolloff::DOUBLE AS spec_rolloff85,
        {", ".join(_BAND_NAMES)}
      FROM m JOIN shape USING (vec_id) JOIN b USING (vec_id))
SELECT vec_id, 1.0::DOUBLE AS feat_valid, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _LONG_NAMES)} FROM f""")
def benchmark_features(spark, sf):
    out = spectral.benchmark_features(S.windows(spark, sf), FS, bands=S.UNIT_BANDS)
    return out.select("vec_id", "feat_valid", *[rounded(c).alias(c) for c in _LONG_NAMES])


# Taps of a 3/2 conversion: 61-point Kaiser (beta 5) low-pass; the Bessel function as a series.
_TAPS = """b AS (SELECT t, (SELECT sum(pow(25.0 * (1 - pow((t - 30) / 30.0, 2)) / 4, k) / pow(factorial(CAST(k AS INT)), 2)) FROM range(26) s(k)) AS w
  FROM range(61) r(t)),
raw AS (SELECT t, w * CASE WHEN t = 30 THEN 1 ELSE sin(pi() * (t - 30) / 3.0) / (pi() * (t - 30) / 3.0) END AS h FROM b),
taps AS (SELECT t, 3 * h / (SELECT sum(h) FROM raw) AS h FROM raw)"""


@query("resample", f"""
WITH {S.SIG}, {_TAPS},
outputs AS (SELECT recording_id, unnest(range(CAST(ceil(count(*) * 1.5) AS BIGINT))) AS m FROM sig GROUP BY recording_id)
SELECT o.recording_id, m AS i, round(sum(value * h), 6) + 0.0 AS value
FROM outputs o JOIN sig s ON s.recording_id = o.recording_id AND s.i * 3 BETWEEN m * 2 - 30 AND m * 2 + 30
  JOIN taps ON t = m * 2 - s.i * 3 + 30
GROUP BY o.recording_id, m""")
def resample(spark, sf):
    """Signal at 3/2 of its rate; blocks of 32 outputs."""
    out = spectral.resample(S.samples(spark, sf).select("recording_id", "i", "n", "value"),
                            ["recording_id"], source_hz=8, target_hz=12, block=32)
    return out.select("recording_id", "i", rounded("value").alias("value"))


@query("chunk_resample", ORACLES["resample"])
def chunk_resample(spark, sf):
    """The same from chunks of 24 samples, arrays in and out."""
    out = chunked.resample(S.chunks(S.samples(spark, sf), ["recording_id"], 24), ["recording_id"], source_hz=8, target_hz=12)
    return out.select("recording_id", "start_sample", F.posexplode("samples").alias("k", "v")).select(
        "recording_id", (F.col("start_sample") + F.col("k")).alias("i"), rounded("v").alias("value"))


@query("signal_spectrum", f"""
WITH {S.SIG}, placed AS (
  SELECT recording_id, i, value, n, unnest(range(CASE WHEN i < 32 THEN 0 ELSE (i - 32) // 16 + 1 END, i // 16 + 1)) AS s
  FROM sig),
w AS (SELECT recording_id * 1000000000 + s AS wid, i - s * 16 AS j, value AS x
      FROM placed WHERE s * 16 + 32 <= n),
{S.dft("w", "wid", 32, S.symmetric_hann(32))}
SELECT wid // 1000000000 AS recording_id, wid % 1000000000 AS segment_index, k AS bin,
  round(sqrt(re * re + im * im) / 15.5 * CASE WHEN k = 0 OR k = 16 THEN 1 ELSE 2 END, 6) + 0.0 AS amplitude
FROM dft""")
def signal_spectrum(spark, sf):
    """Amplitude spectra of sliding windows cut from the long sample table."""
    w = windows.sliding_windows(S.samples(spark, sf), ["recording_id"], 32, 16)
    out = spectral.amplitude_spectrum(w)
    long = spectral.bins_long(out, ["recording_id", "segment_index"], "amplitude", 0.25, "a")
    return long.select("recording_id", "segment_index", F.col("bin").cast("bigint").alias("bin"),
                       rounded("a").alias("amplitude"))
