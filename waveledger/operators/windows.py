"""Cutting recordings into windows.

Input is the long sample table: key columns, `i` (0-based index), `value`, and `n`
(samples in the recording).  A window never holds more than its own length, so
collecting one into an array is bounded no matter how long the recording is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import arrays as A, ordered
from waveledger.functions.scalars import col


def window_lengths(window_s: float, overlap: float, fs: float) -> tuple[int, int]:
    """Window and hop in samples, rounding halves to even."""
    if window_s <= 0:
        raise ValueError("window length must be positive")
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    size = round(window_s * fs)
    return size, max(1, round(size * (1 - overlap)))


def window_count(n: Column | str, size: int, hop: int) -> Column:
    """Complete windows in n samples; a partial tail gives none."""
    n = col(n)
    return F.when(n >= size, F.floor((n - size) / F.lit(hop)) + 1).otherwise(0).cast("bigint")


def assign_windows(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """One row per (sample, window holding it); adds `segment_index`."""
    i = F.col("i")
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((i - size) / F.lit(hop)) + 1)
    last = F.least(F.floor(i / F.lit(hop)), window_count("n", size, hop) - 1)
    return samples.withColumn(
        "segment_index", F.explode(F.when(last >= first, F.sequence(first, last))))


def collect_windows(assigned: DataFrame, keys: Sequence[str], segment: str = "segment_index",
                    value: str = "value") -> DataFrame:
    """One row per window with its samples in order; a single shuffle on (key, window)."""
    pairs = F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    return (assigned.groupBy(*keys, segment).agg(pairs.alias("_p"))
            .withColumn("start_sample", F.get(F.col("_p"), F.lit(0))["i"])
            .withColumn("samples", F.transform("_p", lambda p: p["v"]))
            .drop("_p"))


def sliding_windows(samples: DataFrame, keys: Sequence[str], size: int, hop: int) -> DataFrame:
    """Fixed overlapping windows as arrays: keys, segment_index, start_sample, samples."""
    return collect_windows(assign_windows(samples, size, hop), keys)


def windows_from_chunks(chunks: DataFrame, keys: Sequence[str], size: int, hop: int,
                        n: str = "n") -> DataFrame:
    """Sliding windows straight from stored chunks, without a row per sample.

    `chunks` has keys, `start_sample`, `samples` and the recording's length `n`; chunks do
    not overlap.  Windows inside one chunk need no shuffle.  Of the others only the pieces
    next to chunk edges are shuffled, to be put together in order.
    """
    begin, length = F.col("start_sample"), F.size("samples")
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((begin - size) / F.lit(hop)) + 1)
    last = F.least(F.floor((begin + length - 1) / F.lit(hop)), window_count(n, size, hop) - 1)
    whole_first = F.greatest(F.lit(0).cast("bigint"), F.ceil(begin / F.lit(hop)))
    whole_last = F.least(F.floor((begin + length - size) / F.lit(hop)), window_count(n, size, hop) - 1)

    def span(a: Column, b: Column) -> Column:
        return F.when(b >= a, F.sequence(a, b))

    def pieces_of(segments: Column) -> DataFrame:
        """Parts of the given windows in each chunk, cut before rows are multiplied."""
        def piece(k: Column) -> Column:
            a = F.greatest(k * hop, begin)
            b = F.least(k * hop + size, begin + length)
            part = F.slice("samples", (a - begin).cast("int") + 1, (b - a).cast("int"))
            return F.struct(k.alias("k"), a.alias("a"), part.alias("x"))

        return chunks.select(*keys, F.explode(F.transform(segments, piece)).alias("_c")).select(
            *keys, F.col("_c.k").alias("segment_index"), F.col("_c.a").alias("_a"),
            F.col("_c.x").alias("_x"))

    whole = pieces_of(span(whole_first, whole_last)).select(
        *keys, "segment_index", F.col("_a").alias("start_sample"), F.col("_x").alias("samples"))
    pieces = pieces_of(F.filter(span(first, last), lambda k: (k < whole_first) | (k > whole_last)))
    merged = (pieces.groupBy(*keys, "segment_index")
              .agg(F.array_sort(F.collect_list(F.struct("_a", "_x"))).alias("_p"))
              .select(*keys, "segment_index",
                      (F.col("segment_index") * hop).alias("start_sample"),
                      F.flatten(F.transform("_p", lambda p: p["_x"])).alias("samples")))
    return whole.unionByName(merged.where(F.size("samples") == size))


def window_times(windows: DataFrame, fs: float, size: int, offset_s: float = 0.0) -> DataFrame:
    start = F.col("start_sample") / F.lit(float(fs))
    return (windows.withColumn("segment_start_s", F.lit(offset_s) + start)
            .withColumn("segment_end_s", F.lit(offset_s) + start + F.lit(size / fs)))


def common_window_count(span_s: Column | str, window_s: float, overlap: float) -> Column:
    """Windows that fit a span shared by several sensors, with a 1 ms allowance."""
    span = col(span_s)
    hop = window_s * (1.0 - overlap)
    fits = F.floor((span - F.lit(window_s) + F.lit(fv.DURATION_TOLERANCE_S)) / F.lit(hop)) + 1
    return F.when(span >= window_s, fits).otherwise(0).cast("bigint")


def keep_common_windows(windows: DataFrame, manifest: DataFrame, key: str = "group_id",
                        count: str = "common_windows") -> DataFrame:
    """Drop windows past the shared count of their operating point."""
    return (ordered.attach(windows, manifest.select(key, count), [key], ["segment_index"])
            .where(F.col("segment_index") < F.col(count)))


def window_shortages(windows: DataFrame, manifest: DataFrame, key: str = "group_id",
                     count: str = "common_windows") -> DataFrame:
    """Operating points with fewer windows than promised."""
    have = windows.groupBy(key).agg(F.count(F.lit(1)).alias("produced"))
    return (manifest.select(key, F.col(count).alias("expected")).join(have, key, "left")
            .withColumn("produced", F.coalesce("produced", F.lit(0)))
            .where(F.col("produced") < F.col("expected")))


def window_slots(fs: float, window_s: float, n_windows: int, usable_s: float, skip_s: float = 0.0
                 ) -> tuple[list[tuple[int, int, int]], int, int]:
    """((window, first sample, end), ...), full length and fewest samples of evenly spaced windows."""
    span = max(usable_s - window_s, window_s)
    size, skip, usable = int(window_s * fs), int(skip_s * fs), int(round(usable_s * fs))
    starts = [int(k * span / n_windows * fs) for k in range(n_windows)]
    return [(k, skip + s, skip + min(s + size, usable)) for k, s in enumerate(starts)], size, int(0.5 * window_s * fs)


def spaced_windows(samples: DataFrame, keys: Sequence[str], fs: float, window_s: float,
                   n_windows: int, usable_s: float, skip_s: float = 0.0) -> DataFrame:
    """Evenly spaced windows over a usable span after a skipped start.

    A window needs at least half its samples and is zero-padded to full length.
    """
    span = max(usable_s - window_s, window_s)
    size, least = int(window_s * fs), int(0.5 * window_s * fs)
    skip, usable = int(skip_s * fs), int(round(usable_s * fs))
    slots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(int(k * span / n_windows * fs)).alias("s"))
                      for k in range(n_windows)])
    j = F.col("i") - skip
    spread = (samples.where((j >= 0) & (j < usable))
              .withColumn("_slot", F.explode(F.filter(
                  slots, lambda x: (x["s"] <= j) & (j < x["s"] + size))))
              .withColumn("segment_index", F.col("_slot")["k"]))
    return (collect_windows(spread, keys)
            .where(F.size("samples") >= max(least, 1))
            .withColumn("n_present", F.size("samples"))
            .withColumn("samples", A.fit_length("samples", size)))


def tumbling_windows(samples: DataFrame, keys: Sequence[str], size: int, skip: int = 0) -> DataFrame:
    """Back-to-back windows after `skip` samples, as arrays; the tail is left out."""
    j = F.col("i") - skip
    used = F.floor((F.col("n") - skip) / F.lit(size)) * size
    kept = samples.where((j >= 0) & (j < used)).withColumn(
        "segment_index", F.floor(j / F.lit(size)))
    return collect_windows(kept, keys)


def tumbling_summary(samples: DataFrame, keys: Sequence[str], size: int, skip: int = 0) -> DataFrame:
    """Windows and discarded tail samples per recording."""
    left = F.greatest(F.col("n") - skip, F.lit(0))
    return (samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, "n", F.floor(left / F.lit(size)).alias("windows"),
                    (left % F.lit(size)).alias("discarded_tail_samples")))


def envelope(samples: DataFrame, keys: Sequence[str], fs: float, bins: int = 2000) -> DataFrame:
    """Min/max per display bin; at most `bins` bins and every sample in exactly one."""
    count = F.least(F.lit(bins), F.col("n"))
    b = F.floor(((F.col("i") + 1) * count - 1) / F.col("n"))
    return (samples.withColumn("bin", b).groupBy(*keys, "bin")
            .agg(F.min("value").alias("low"), F.max("value").alias("high"),
                 F.count(F.lit(1)).alias("n_samples"),
                 ((F.min("i") + F.max("i")) / F.lit(2.0 * fs)).alias("center_s")))


def time_axis(samples: DataFrame, dt: float, t0: float = 0.0) -> DataFrame:
    return samples.withColumn("t", F.lit(float(t0)) + F.col("i") * F.lit(float(dt)))
