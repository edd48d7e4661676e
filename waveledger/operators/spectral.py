"""Spectra of windows: kernels from `functions.spectra`, the rest as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import arrays as A, spectra
from waveledger.functions.scalars import col, finite_or_zero
from waveledger.operators import timefeat


def welch_psd(windows: DataFrame, fs: float, samples: str = "samples", out: str = "psd",
              segment: int = 16384, floor: float = fv.PSD_FLOOR, centre: bool = False) -> DataFrame:
    """Welch density: periodic Hann, half-overlapping segments, mean removed per segment."""
    return windows.withColumn(
        out, spectra.power_density(samples, fs, segment, floor=floor, centre=centre))


def periodogram(windows: DataFrame, fs: float, samples: str = "samples",
                out: str = "psd", centre: bool = False) -> DataFrame:
    """Density of the whole window: periodic Hann, no detrending."""
    return windows.withColumn(
        out, spectra.power_density(samples, fs, None, 0.0, detrend=False, centre=centre))


def amplitude_spectrum(windows: DataFrame, samples: str = "samples",
                       out: str = "amplitude") -> DataFrame:
    return windows.withColumn(out, spectra.amplitude_spectrum(samples))


def bins_long(df: DataFrame, keys: Sequence[str], spectrum: str, step_hz: Column | float,
              value: str) -> DataFrame:
    """One row per frequency bin: keys, bin, freq, value."""
    step = step_hz if isinstance(step_hz, Column) else F.lit(float(step_hz))
    return (df.select(*keys, step.alias("_step"), F.posexplode(spectrum).alias("bin", value))
            .withColumn("freq", F.col("bin") * F.col("_step")).drop("_step"))


def first_peak(spectrum: Column | str) -> Column:
    """Index of the largest bin; the lowest one on a tie."""
    s = col(spectrum)
    return F.array_position(s, F.array_max(s)) - 1


def dominant_frequencies(windows: DataFrame, fs: float, samples: str = "samples",
                         min_hz: float = 10.0) -> DataFrame:
    """Three readings of the strongest frequency.

    `dom_psd`: peak of the Welch density.  `dom_fft`: peak of the plain spectrum without
    DC.  `dom_hann`: peak of the Hann-windowed spectrum at or above `min_hz`.
    """
    n = F.size(samples).cast("double")
    step = F.lit(float(fs)) / n
    df = welch_psd(windows, fs, samples, "_psd")
    df = df.withColumns({"_fft": spectra.raw_magnitude(samples),
                         "_hann": spectra.hann_magnitude(samples)})
    above = A.let(step, lambda hz: F.transform(
        "_hann", lambda a, k: F.when(k * hz >= min_hz, a).otherwise(0.0)))
    no_dc = F.slice("_fft", 2, F.greatest(F.size("_fft") - 1, F.lit(0)))
    return df.withColumns({
        "dom_psd": first_peak("_psd") * step,
        "dom_fft": (first_peak(no_dc) + 1) * step,
        "dom_hann": first_peak(above) * step,
    }).drop("_psd", "_fft", "_hann")


def spectral_shape(df: DataFrame, spectrum: str, step_hz: Column) -> DataFrame:
    """Dominant frequency, centroid, bandwidth and 85 % roll-off of a density column."""
    p = F.col(spectrum)
    df = df.withColumn("_total", A.total(spectrum))
    by_bin = A.total(F.transform(p, lambda x, k: x * k))
    df = df.withColumn("_centre", by_bin / F.col("_total"))
    spread = A.let(F.col("_centre"), lambda c: A.total(
        F.transform(p, lambda x, k: (k - c) * (k - c) * x)))
    # Bins whose running share stays under the limit; the next bin is the roll-off.
    below = A.let(F.col("_total") * fv.ROLLOFF_SHARE, lambda limit: F.aggregate(
        p, F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("k")),
        lambda acc, x: F.struct(
            (acc["run"] + x).alias("run"),
            (acc["k"] + F.when(acc["run"] + x < limit, 1).otherwise(0)).alias("k")),
        lambda acc: acc["k"]))
    return df.withColumns({
        "dom_freq": first_peak(spectrum) * step_hz,
        "spec_centroid": F.col("_centre") * step_hz,
        "spec_bandwidth": F.sqrt(spread / F.col("_total")) * step_hz,
        "spec_rolloff85": F.least(below, F.size(p) - 1) * step_hz,
    }).drop("_total", "_centre")


def band_power(df: DataFrame, spectrum: str, step_hz: Column,
               bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Share of the total in half-open bands [lo, hi); one column per band.

    Bands need not cover the whole range, so shares need not add up to 1.
    """
    p = F.col(spectrum)
    df = df.withColumn("_total", A.total(spectrum))

    def share(lo: float, hi: float) -> Column:
        a = F.least(F.ceil(F.lit(float(lo)) / step_hz), F.size(p)).cast("int")
        b = F.least(F.ceil(F.lit(float(hi)) / step_hz), F.size(p)).cast("int")
        return F.try_divide(A.total(F.slice(p, a + 1, b - a)), F.col("_total"))

    return df.withColumns({f"band_{lo:g}_{hi:g}": share(lo, hi) for lo, hi in bands}).drop("_total")


def benchmark_features(windows: DataFrame, fs: float, samples: str = "samples",
                       bands: Sequence[tuple[float, float]] = fv.WIDE_BANDS) -> DataFrame:
    """The long feature row: time statistics, spectral shape and band shares."""
    df = timefeat.window_time_features(windows, samples)
    df = welch_psd(df, fs, samples, "_psd", centre=True)
    n = F.least(F.size(samples), F.lit(16384)).cast("double")
    step = F.lit(float(fs)) / n
    df = band_power(spectral_shape(df, "_psd", step), "_psd", step, bands)
    names = ["dom_freq", "spec_centroid", "spec_bandwidth", "spec_rolloff85",
             *[f"band_{lo:g}_{hi:g}" for lo, hi in bands]]
    valid = F.col("feat_valid") == 1.0
    return df.withColumns({c: F.when(valid, finite_or_zero(c)) for c in names}).drop("_psd")


def short_features(windows: DataFrame, fs: float, samples: str = "samples",
                   bands: Sequence[tuple[float, float]] = fv.FINE_BANDS) -> DataFrame:
    """The short feature row: RMS, peak-to-peak, crest, kurtosis and periodogram band shares."""
    df = timefeat.short_window_features(windows, samples)
    df = periodogram(df, fs, samples, "_psd", centre=True)
    step = F.lit(float(fs)) / F.size(samples).cast("double")
    df = band_power(df, "_psd", step, bands)
    ok = F.col("status") == "ok"
    names = [f"band_{lo:g}_{hi:g}" for lo, hi in bands]
    return df.withColumns({c: F.when(ok, F.col(c)) for c in names}).drop("_psd")


def spectrogram_db(windows: DataFrame, keys: Sequence[str], fs: float, segment: int, hop: int,
                   max_hz: float, start_s: float = 0.0, samples: str = "samples") -> DataFrame:
    """Long table (keys, frame, bin, t, freq, db) of periodogram frames inside each array."""
    size = F.size(samples)
    frames = F.when(size >= segment, F.sequence(
        F.lit(0), F.floor((size - segment) / F.lit(hop)).cast("int")))
    # Cut inside the array, so that no row carries the whole window along.
    cut = windows.select(*keys, F.explode(F.transform(frames, lambda f: F.struct(
        f.alias("frame"), F.slice(samples, f * hop + 1, segment).alias("_f")))).alias("_c")
    ).select(*keys, F.col("_c.frame").alias("frame"), F.col("_c._f").alias("_f"))
    spec = periodogram(cut, fs, "_f", "_p")
    long = bins_long(spec, [*keys, "frame"], "_p", fs / segment, "power").where(
        F.col("freq") <= max_hz)
    t = (F.col("frame") * hop + segment / 2) / F.lit(float(fs)) + F.lit(start_s)
    return (long.withColumn("t", t)
            .withColumn("db", 10.0 * F.log10(F.greatest("power", F.lit(fv.DB_FLOOR))))
            .drop("power"))


def log_mel(windows: DataFrame, rate: float, need: int, n_fft: int = 1024, hop: int = 256,
            n_mels: int = 64, frames: int = 64, samples: str = "samples",
            out: str = "log_mel") -> DataFrame:
    """Standardised mel spectrogram in dB, flattened to n_mels x frames values."""
    df = windows.withColumn("_fit", A.fit_length(samples, need))
    df = df.withColumn("_mel", spectra.log_mel("_fit", rate, n_fft, hop, n_mels, frames))
    return df.withColumn(out, A.standardised("_mel")).drop("_fit", "_mel")


def log_psd(windows: DataFrame, rate: float, need: int, max_hz: float = 5000.0,
            points: int = 512, segment: int = 4096, samples: str = "samples",
            out: str = "log_psd") -> DataFrame:
    """Standardised Welch density in dB on an even grid from 0 to `max_hz`."""
    df = windows.withColumn("_fit", A.fit_length(samples, need))
    df = welch_psd(df, rate, "_fit", "_psd", segment, floor=0.0)
    df = df.withColumn("_db", F.transform(
        "_psd", lambda p: 10.0 * F.log10(p + F.lit(fv.DB_FLOOR))))
    step = rate / min(segment, need)
    df = df.withColumn("_grid", spectra.interpolate_grid("_db", step, max_hz, points))
    return df.withColumn(out, A.standardised("_grid")).drop("_fit", "_psd", "_db", "_grid")


def harmonic_amplitudes(df: DataFrame, keys: Sequence[str], amplitude: str, step_hz: Column,
                        markers: Sequence[float] = fv.HARMONIC_MARKERS_HZ) -> DataFrame:
    """Amplitude at the bin nearest to each marker (the lower bin when halfway)."""
    bin_of = F.least(F.ceil(F.col("marker_hz") / step_hz - 0.5), F.size(amplitude) - 1)
    return (df.select(*keys, amplitude, F.explode(F.array(*[F.lit(float(m)) for m in markers]))
                      .alias("marker_hz"))
            .withColumn("bin", bin_of.cast("int"))
            .withColumn("freq", F.col("bin") * step_hz)
            .withColumn("amplitude", F.get(F.col(amplitude), F.col("bin")))
            .select(*keys, "marker_hz", "bin", "freq", "amplitude"))


def resample(samples: DataFrame, keys: Sequence[str], source_hz: int, target_hz: int,
             block: int = 262_144) -> DataFrame:
    """Rational-rate conversion of the long sample table (keys, i, n, value).

    `block` counts inputs, whatever the ratio: a task holds that many and the filter's reach on
    both sides. An input goes to every block whose filter reaches it.
    """
    from math import gcd

    g = gcd(int(source_hz), int(target_hz))
    up, down = int(target_hz) // g, int(source_hz) // g
    half = 10 * max(up, down)
    block = max(1, block * up // down)  # in outputs from here on
    j = F.col("i") * up
    outputs = F.ceil(F.col("n") * F.lit(up) / F.lit(down))
    first = F.greatest(F.ceil((j - half) / F.lit(down)), F.lit(0))
    last = F.least(F.floor((j + half) / F.lit(down)), outputs - 1)
    blocks = F.sequence(F.floor(first / F.lit(block)), F.floor(last / F.lit(block)))
    spread = (samples.withColumn("_total", outputs)
              .withColumn("_block", F.explode(F.when(last >= first, blocks))))
    grouped = spread.groupBy(*keys, "_block").agg(
        F.max("_total").alias("_total"),
        F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_p"))
    begin = F.col("_block") * block
    out = grouped.select(
        *keys, begin.alias("_begin"),
        spectra.resample_block(
            F.transform("_p", lambda p: p["value"].cast("double")),
            F.get(F.col("_p"), F.lit(0))["i"], begin,
            F.least(F.lit(block), F.col("_total") - begin), up, down).alias("_y"))
    return (out.select(*keys, "_begin", F.posexplode("_y").alias("_k", "value"))
            .select(*keys, (F.col("_begin") + F.col("_k")).alias("i"), "value"))
