"""Fourier kernels: Arrow UDFs over one bounded window per row.

Each kernel stacks the windows of an Arrow batch into a matrix and runs one `rfft`.
Everything before (cutting windows) and after (bands, shapes, decibels) is plain
Spark.  The kernels are declared non-deterministic only to keep the optimiser from
copying a kernel call into the lambdas that read its result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from waveledger.functions.arrays import let
from waveledger.functions.scalars import col

DOUBLES = T.ArrayType(T.DoubleType())


def map_rows(windows: pa.Array, kernel: Callable[[np.ndarray], np.ndarray],
              centre: bool = False) -> pa.Array:
    """Apply a matrix kernel to all rows of equal length at once; bad rows become null."""
    lengths = pc.fill_null(pc.list_value_length(windows), 0).to_numpy(zero_copy_only=False)
    lengths = lengths.astype(np.int64)
    flat = windows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    results: list[np.ndarray | None] = [None] * len(lengths)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        block = flat[starts[rows][:, None] + np.arange(n)]
        if centre:
            block = block - block.mean(axis=1, keepdims=True)
        good = np.isfinite(block).all(axis=1)
        if good.any():
            for r, out in zip(rows[good], kernel(block[good])):
                results[r] = out
    return pa.array(results, type=pa.list_(pa.float64()))


def _opaque(kernel):
    return kernel.asNondeterministic()


def _periodic_hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(n)


def _density(frames: np.ndarray, window: np.ndarray) -> np.ndarray:
    """One-sided power density of the last axis, for a sampling rate of 1."""
    n = frames.shape[-1]
    power = np.abs(np.fft.rfft(frames * window, axis=-1)) ** 2 / np.sum(window * window)
    last = -1 if n % 2 == 0 else None
    power[..., 1:last] *= 2
    return power


def _frames(block: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(block, size, axis=-1)[:, ::hop, :]


def amplitude_rows(windows: pa.Array) -> pa.Array:
    """Amplitude spectrum of every row; null below three samples."""
    def one(block: np.ndarray):
        n = block.shape[1]
        w = np.hanning(n)
        if n < 3:
            return [None] * len(block)
        out = np.abs(np.fft.rfft(block * w, axis=1)) / w.sum()
        out[:, 1:(-1 if n % 2 == 0 else None)] *= 2
        return out
    return map_rows(windows, one)


def amplitude_spectrum(samples: Column | str) -> Column:
    """Single-sided peak amplitude with a symmetric Hann window and coherent gain 1."""

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array) -> pa.Array:
        return amplitude_rows(a)

    return _opaque(kernel)(col(samples))


def power_density(samples: Column | str, rate: float, segment: int | None = None,
                  overlap: float = 0.5, detrend: bool = True, floor: float = 0.0,
                  centre: bool = False) -> Column:
    """Power density averaged over segments (periodic Hann, one-sided, at least `floor`).

    `segment=None` takes the whole window as a single segment; otherwise segments hold
    min(segment, window) samples and advance by (1 - overlap) of that.  `centre` removes
    the mean of the whole window first, `detrend` that of each segment.
    """

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array) -> pa.Array:
        def averaged(block):
            n = block.shape[1]
            size = n if segment is None else min(segment, n)
            frames = _frames(block, size, max(1, size - int(size * overlap)))
            if detrend:
                frames = frames - frames.mean(axis=-1, keepdims=True)
            density = _density(frames, _periodic_hann(size)).mean(axis=1) / rate
            return np.maximum(density, floor)
        return map_rows(a, averaged, centre)

    return _opaque(kernel)(col(samples))


def raw_magnitude(samples: Column | str) -> Column:
    """Magnitude spectrum of the centred samples, without a window."""

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array) -> pa.Array:
        return map_rows(a, lambda block: np.abs(np.fft.rfft(block, axis=1)), centre=True)

    return _opaque(kernel)(col(samples))


def hann_magnitude(samples: Column | str) -> Column:
    """Magnitude spectrum of the centred samples under a symmetric Hann window."""

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array) -> pa.Array:
        return map_rows(
            a, lambda block: np.abs(np.fft.rfft(block * np.hanning(block.shape[1]), axis=1)),
            centre=True)

    return _opaque(kernel)(col(samples))


def mel_filters(rate: float, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters on the Slaney mel scale, area-normalised."""
    step, knee_hz = 200.0 / 3, 1000.0
    knee, growth = knee_hz / step, np.log(6.4) / 27.0

    def to_hz(m):
        return np.where(m < knee, m * step, knee_hz * np.exp(growth * (m - knee)))

    top = rate / 2
    top_mel = top / step if top < knee_hz else knee + np.log(top / knee_hz) / growth
    edges = to_hz(np.linspace(0.0, top_mel, n_mels + 2))
    bins = np.fft.rfftfreq(n_fft, 1.0 / rate)
    rise = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: Column | str, rate: float, n_fft: int, hop: int, n_mels: int,
            frames: int) -> Column:
    """Flattened (n_mels x frames) mel spectrogram in dB below its own peak.

    Frames are centred (zero-padded ends), 80 dB deep; missing frames repeat the last one.
    """

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array) -> pa.Array:
        bank, window = mel_filters(rate, n_fft, n_mels), _periodic_hann(n_fft)

        def mel(block):
            padded = np.pad(block, ((0, 0), (n_fft // 2, n_fft // 2)))
            spec = np.abs(np.fft.rfft(_frames(padded, n_fft, hop) * window, axis=-1)) ** 2
            power = np.einsum("mk,btk->bmt", bank, spec)
            top = np.maximum(power.max(axis=(1, 2), keepdims=True), 1e-10)
            db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(top)
            db = np.maximum(db, db.max(axis=(1, 2), keepdims=True) - 80.0)
            have = db.shape[2]
            take = np.minimum(np.arange(frames), have - 1)
            return db[:, :, take].reshape(len(block), -1)
        return map_rows(a, mel)

    return _opaque(kernel)(col(samples))


def interpolate_grid(values: Column | str, step: float, grid_max: float, points: int) -> Column:
    """Linear interpolation of equally spaced values (spacing `step` from 0) on a grid.

    Values above `grid_max` are dropped first; beyond the last kept one the curve is flat.
    """

    def on_grid(kept: Column) -> Column:
        def at(j: Column) -> Column:
            x = j.cast("double") * F.lit(grid_max / (points - 1) / step)
            x = F.least(x, (F.size(kept) - 1).cast("double"))
            lo = F.floor(x).cast("int")
            left, right = F.get(kept, lo), F.get(kept, F.least(lo + 1, F.size(kept) - 1))
            return left + (right - left) * (x - lo)

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    below = int(np.floor(grid_max / step + 1e-9)) + 1
    return let(F.slice(col(values), 1, below), on_grid)


#: Cells of the matrix of inputs that resampling multiplies at a time.
RESAMPLE_CELLS = 1 << 20


def resampling_filter(up: int, down: int) -> np.ndarray:
    """Kaiser (beta 5) low-pass for up/down conversion, unit gain at DC before scaling."""
    widest = max(up, down)
    half = 10 * widest
    taps = np.sinc(np.arange(-half, half + 1) / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    return taps / taps.sum() * up


def resample_block(samples: Column | str, first_input: Column, first_output: Column,
                   n_output: Column, up: int, down: int) -> Column:
    """Outputs [first_output, first_output + n_output) from a block that holds their inputs."""

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array, i0: pa.Array, m0: pa.Array, count: pa.Array) -> pa.Array:
        taps = resampling_filter(up, down)
        half = len(taps) // 2
        reach = half // up + 1
        out = []
        for x, i, m, n in zip(a, i0.to_pylist(), m0.to_pylist(), count.to_pylist()):
            x = np.asarray(x.values, dtype=np.float64)
            y = np.empty(n)
            # so many outputs at a time that the matrix of their inputs stays small
            some = max(1, RESAMPLE_CELLS // (2 * reach + 2))
            for at in range(0, n, some):
                outputs = np.arange(m + at, m + min(n, at + some))[:, None]
                inputs = outputs * down // up + np.arange(-reach, reach + 2)[None, :]
                tap = outputs * down - inputs * up + half
                used = (tap >= 0) & (tap < len(taps)) & (inputs >= i) & (inputs < i + len(x))
                y[at:at + some] = np.where(used, x[np.clip(inputs - i, 0, len(x) - 1)]
                                           * taps[np.clip(tap, 0, len(taps) - 1)], 0.0).sum(axis=1)
            out.append(y)
        return pa.array(out, type=pa.list_(pa.float64()))

    return _opaque(kernel)(col(samples), first_input, first_output, n_output)


#: Inputs that are transformed together when a chunk is resampled.
RESAMPLE_INPUTS = 1 << 16


def resample_chunk(samples: Column | str, first_input: Column, first_output: Column, n_output: Column, up: int,
                   down: int) -> Column:
    """The share of one chunk in outputs [first_output, first_output + n_output), by Fourier convolution.

    An output is at one of `up` phases, and each phase has taps of its own for the inputs, so
    inputs are convolved once per phase and no zeros are put between them.
    """

    @arrow_udf(DOUBLES)
    def kernel(a: pa.Array, i0: pa.Array, m0: pa.Array, count: pa.Array) -> pa.Array:
        taps = resampling_filter(up, down)
        half = len(taps) // 2
        # taps of a phase, from the farthest input behind to the farthest ahead
        branches = {p: taps[(p + half) % up::up] for p in range(up)}
        out = []
        for x, i, m, n in zip(a, i0.to_pylist(), m0.to_pylist(), count.to_pylist()):
            x = np.asarray(x.values, dtype=np.float64)
            y = np.zeros(n)
            outputs = np.arange(m, m + n)
            phase = outputs * down % up
            for p in np.unique(phase):
                which = np.flatnonzero(phase == p)
                h = branches[int(p)]
                # output = sum of taps[out * down - in * up + half] * x[in]; `at` is the input under the last tap of the branch
                at = (outputs[which] * down + half - (int(p) + half) % up) // up
                for lo in range(0, len(x), RESAMPLE_INPUTS):
                    some = x[lo:lo + RESAMPLE_INPUTS]
                    size = 1 << (len(some) + len(h) - 2).bit_length()
                    full = np.fft.irfft(np.fft.rfft(some, size) * np.fft.rfft(h, size), size)[:len(some) + len(h) - 1]
                    k = at - (i + lo)
                    inside = (k >= 0) & (k < len(full))
                    y[which[inside]] += full[k[inside]]
            out.append(y)
        return pa.array(out, type=pa.list_(pa.float64()))

    return _opaque(kernel)(col(samples), first_input, first_output, n_output)
