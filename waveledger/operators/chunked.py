"""Checks of stored recordings straight from their chunks.

A chunk (`start_sample`, `samples`) is reduced to a few numbers where it lies: counts, sums,
squares and extremes of itself or of its blocks, and the runs of its flagged samples. These are
combined by sums, minima and maxima, which may happen in any order and on the map side; only
blocks and runs that touch the edge of a chunk meet their other half. So what is shuffled
follows the number of chunks, not of samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import arrays as A, ordered, spectra
from waveledger.functions.scalars import is_finite
from waveledger.operators import quality, timefeat, windows
from waveledger.sources.tables import staged

_PARTS = {"count": F.sum, "total": F.sum, "squares": F.sum, "least": F.min, "greatest": F.max, "low_hits": F.sum,
          "high_hits": F.sum, "first": F.min, "last": F.max}


def _present(chunks: DataFrame) -> DataFrame:
    """Chunks that hold samples; rows of errors and empty files have none."""
    return chunks.where(F.size("samples") > 0)


def measures(x: Column | str, low: Column | None = None, high: Column | None = None) -> dict[str, Column]:
    """Count, sums and extremes of an array of samples; rail hits if the rails are given. Nulls do not count."""
    there = F.filter(x, lambda v: v.isNotNull())
    hits = lambda test: F.size(F.filter(x, test)).cast("bigint")
    out = {"count": F.size(there).cast("bigint"), "total": A.total(there), "squares": A.total(there, lambda v: v * v),
           "least": F.array_min(x).cast("double"), "greatest": F.array_max(x).cast("double")}
    if low is not None and high is not None:
        out |= {"low_hits": hits(lambda v: v <= low), "high_hits": hits(lambda v: v >= high)}
    return out


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures of the same keys as one; the order of merging does not matter."""
    return parts.groupBy(*keys).agg(*[how(c).alias(c) for c, how in _PARTS.items() if c in parts.columns])


def recording_measures(chunks: DataFrame, keys: Sequence[str], low: Column | None = None,
                       high: Column | None = None) -> DataFrame:
    """Measures of all samples of a key."""
    return merged(_present(chunks).select(*keys, *[c.alias(n) for n, c in measures("samples", low, high).items()]), keys)


def block_measures(chunks: DataFrame, keys: Sequence[str], index_of: Callable[[Column], Column],
                   edge: Callable[[Column], Column], alone: bool = True) -> DataFrame:
    """keys, block and measures of blocks; `first` and `last` are the samples they begin and end with.

    Sample i belongs to block `index_of(i)`, which begins at sample `edge(block)`. Blocks that
    lie in one chunk are done there; the parts of the others are merged. `alone` says that the
    keys have one channel; else every block is merged over the channels.
    """
    begin, end = F.col("start_sample"), F.col("start_sample") + F.size("samples")

    def part(b: Column) -> Column:
        a, z = F.greatest(edge(b), begin), F.least(edge(b + 1), end)
        return F.struct(b.alias("block"), a.alias("first"), (z - 1).alias("last"),
                        ((a == edge(b)) & (z == edge(b + 1))).alias("whole"),
                        F.slice("samples", (a - begin).cast("int") + 1, (z - a).cast("int")).alias("x"))

    parts = (_present(chunks).select(*keys, F.explode(F.transform(F.sequence(index_of(begin), index_of(end - 1)), part)).alias("p"))
             .select(*keys, "p.*").withColumns(measures("x")).drop("x"))
    if not alone:
        return merged(parts.drop("whole"), [*keys, "block"])
    cut = merged(parts.where(~F.col("whole")).drop("whole"), [*keys, "block"])
    return parts.where("whole").drop("whole").unionByName(cut)


def complete_blocks(chunks: DataFrame, keys: Sequence[str], block: int, alone: bool = True) -> DataFrame:
    """Back-to-back blocks of `block` samples with rms and flat; the tail is left out."""
    found = block_measures(chunks, keys, lambda i: F.floor(i / F.lit(block)), lambda b: b * block, alone)
    whole = found.where(F.col("last") - F.col("first") + 1 == block)
    return whole.select(*keys, "block", F.sqrt(F.col("squares") / F.col("count")).alias("rms"),
                        (F.col("greatest") == F.col("least")).alias("flat"))


def channel_stats(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Min, max, peak-to-peak, mean, RMS and std over finite samples.

    The deviations are taken from each chunk's own mean first and the chunk means from the
    recording's, so a large offset does not eat the digits.
    """
    finite = F.filter("samples", is_finite)
    parts = _present(chunks).select(*keys, "start_sample", finite.alias("x")).where(F.size("x") > 0)
    parts = staged(parts.select(*keys, "start_sample", *[c.alias(n) for n, c in measures("x").items()], A.total(
        A.centred("x", A.mean("x")), lambda d: d * d).alias("_m2")), "chunk-measures")
    whole = merged(parts.drop("_m2"), keys)
    spread = (ordered.attach(parts.select(*keys, "start_sample", "count", "total", "_m2"),
                             whole.select(*keys, (F.col("total") / F.col("count")).alias("mean")), keys, ["start_sample"])
              .groupBy(*keys).agg(F.sum(F.col("_m2") + F.col("count") * F.pow(
                  F.col("total") / F.col("count") - F.col("mean"), F.lit(2.0))).alias("_m2")))
    return whole.join(spread, list(keys)).select(
        *keys, F.col("count").alias("n"), F.col("least").alias("vmin"), F.col("greatest").alias("vmax"),
        (F.col("greatest") - F.col("least")).alias("vpp"), (F.col("total") / F.col("count")).alias("mean"),
        F.sqrt(F.col("squares") / F.col("count")).alias("rms"), F.sqrt(F.col("_m2") / F.col("count")).alias("std"))


def clipping(chunks: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Samples at or beyond the rails."""
    per = recording_measures(chunks, keys, low, high).join(lengths(chunks, keys), list(keys))
    return timefeat.clip_verdict(per.select(*keys, "n", (F.col("low_hits") + F.col("high_hits")).alias("clip_count")))


def lengths(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _present(chunks).groupBy(*keys).agg(F.sum(F.size("samples")).alias("n"))


def worst_dc_offset(chunks: DataFrame, keys: Sequence[str], channel: str) -> DataFrame:
    """The offset largest in size over channels (ties: first channel) and the worst percent."""
    per = recording_measures(chunks, [*keys, channel]).select(
        *keys, channel, (F.col("total") / F.col("count")).alias("dc"), F.sqrt(F.col("squares") / F.col("count")).alias("_rms"))
    return timefeat.worst_of_offsets(timefeat.offset_percent(per), keys, channel)


def rms_variation(chunks: DataFrame, keys: Sequence[str], size: int, alone: bool = True) -> DataFrame:
    """(max - min) / median of the RMS of complete tumbling windows, in percent."""
    return timefeat.variation_of(staged(complete_blocks(chunks, keys, size, alone).drop("flat"), "block-rms"), keys)


def quiet_blocks(chunks: DataFrame, keys: Sequence[str], block: int, alone: bool = True) -> DataFrame:
    """Complete blocks with their `flat` and `silent` flags, as `quality.quiet_blocks` has them."""
    blocks = staged(complete_blocks(chunks, keys, block, alone), "blocks")
    peaks = recording_measures(chunks, keys).select(*keys, F.greatest(F.abs("least"), F.abs("greatest")).alias("_peak"))
    return quality.mark_quiet(blocks, peaks, keys)


def leading_quiet(chunks: DataFrame, blocks: DataFrame, keys: Sequence[str], block: int, fs: float) -> DataFrame:
    """Seconds before the first block that is neither flat nor silent."""
    return quality.leading_seconds(lengths(chunks, keys), blocks, keys, block, fs)


def envelope(chunks: DataFrame, keys: Sequence[str], fs: float, bins: int = 2000) -> DataFrame:
    """Min/max per display bin; `chunks` carries the recording's length `n`. Bins are blocks of uneven length."""
    count = F.least(F.lit(bins), F.col("n"))
    found = block_measures(chunks, [*keys, "n"], lambda i: F.floor(((i + 1) * count - 1) / F.col("n")),
                           lambda b: F.floor(b * F.col("n") / count))
    return found.select(*keys, F.col("block").alias("bin"), F.col("least").alias("low"), F.col("greatest").alias("high"),
                        (F.col("last") - F.col("first") + 1).alias("n_samples"),
                        ((F.col("first") + F.col("last")) / F.lit(2.0 * fs)).alias("center_s"))


def tumbling_windows(chunks: DataFrame, keys: Sequence[str], size: int, skip: int = 0) -> DataFrame:
    """Back-to-back windows after `skip` samples, as arrays; `chunks` carries the recording's length `n`."""
    begin = F.col("start_sample")
    gone = F.greatest(F.lit(skip) - begin, F.lit(0)).cast("int")
    rest = chunks.where(begin + F.size("samples") > skip).select(
        *keys, (F.col("n") - skip).alias("n"), (F.greatest(begin, F.lit(skip)) - skip).alias("start_sample"),
        F.slice("samples", gone + 1, F.size("samples") - gone).alias("samples"))
    return windows.windows_from_chunks(rest, keys, size, size)


def spaced_windows(chunks: DataFrame, keys: Sequence[str], fs: float, window_s: float, n_windows: int, usable_s: float,
                   skip_s: float = 0.0) -> DataFrame:
    """The windows of `windows.spaced_windows`: each chunk gives the part of a window that it holds."""
    slots, size, least = windows.window_slots(fs, window_s, n_windows, usable_s, skip_s)
    begin, end = F.col("start_sample"), F.col("start_sample") + F.size("samples")
    cut = F.filter(F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
                                         for k, a, b in slots]),
                               lambda s: F.struct(s["k"].alias("k"), F.greatest(s["a"], begin).alias("a"), F.least(s["b"], end).alias("b"))),
                   lambda s: s["b"] > s["a"])
    parts = _present(chunks).select(*keys, F.explode(F.transform(cut, lambda s: F.struct(
        s["k"].alias("segment_index"), s["a"].alias("_a"),
        F.slice("samples", (s["a"] - begin).cast("int") + 1, (s["b"] - s["a"]).cast("int")).alias("_x")))).alias("_p")).select(*keys, "_p.*")
    found = parts.groupBy(*keys, "segment_index").agg(F.array_sort(F.collect_list(F.struct("_a", "_x"))).alias("_p")).select(
        *keys, "segment_index", F.get("_p", F.lit(0))["_a"].alias("start_sample"),
        F.flatten(F.transform("_p", lambda p: p["_x"])).alias("samples"))
    return (found.where(F.size("samples") >= max(least, 1)).withColumn("n_present", F.size("samples"))
            .withColumn("samples", A.fit_length("samples", size)))


def resample(chunks: DataFrame, keys: Sequence[str], source_hz: int, target_hz: int) -> DataFrame:
    """Rational-rate conversion of chunks: keys, start_sample, samples of the new rate.

    `chunks` carries the recording's length `n`. A chunk is convolved alone, by Fourier blocks.
    Outputs whose filter lies inside it are done; the few around its edges are partial sums, of
    which those of neighbouring chunks add up to the output.
    """
    g = math.gcd(int(source_hz), int(target_hz))
    up, down = int(target_hz) // g, int(source_hz) // g
    half = 10 * max(up, down)
    begin, end = F.col("start_sample"), F.col("start_sample") + F.size("samples")
    outputs = F.ceil(F.col("n") * F.lit(up) / F.lit(down))
    first = F.greatest(F.ceil((begin * up - half) / F.lit(down)), F.lit(0))
    last = F.least(F.floor(((end - 1) * up + half) / F.lit(down)), outputs - 1)
    # the first and last output that needs no sample beyond the chunk
    inner = F.when(begin == 0, F.lit(0)).otherwise(F.floor(((begin - 1) * up + half) / F.lit(down)) + 1)
    outer = F.when(end == F.col("n"), outputs - 1).otherwise(F.ceil((end * up - half) / F.lit(down)) - 1)
    made = _present(chunks).select(*keys, first.alias("_m"), F.greatest(first, inner).alias("_a"), F.least(last, outer).alias("_b"),
                                   spectra.resample_chunk("samples", begin, first, last - first + 1, up, down).alias("_y"))
    whole = made.where("_b >= _a").select(*keys, F.col("_a").alias("start_sample"), F.slice(
        "_y", (F.col("_a") - F.col("_m")).cast("int") + 1, (F.col("_b") - F.col("_a") + 1).cast("int")).alias("samples"))
    at = F.col("_m") + F.col("_k")
    edges = made.select(*keys, "_m", "_a", "_b", F.posexplode("_y").alias("_k", "_v")).where(
        (F.col("_b") < F.col("_a")) | (at < F.col("_a")) | (at > F.col("_b")))
    summed = edges.groupBy(*keys, at.alias("m")).agg(F.sum("_v").alias("v"))
    return whole.unionByName(summed.select(*keys, F.col("m").alias("start_sample"), F.array("v").alias("samples")))


# Runs ------------------------------------------------------------------------------

def runs(chunks: DataFrame, keys: Sequence[str], flag: Callable[[Column], Column]) -> DataFrame:
    """Maximal runs of consecutive samples for which `flag` holds: keys, start, end (exclusive).

    A chunk is encoded as its runs; of these, only the first and the last can go on in another
    chunk and are put together there.
    """
    begin, size = F.col("start_sample"), F.size("samples")
    flags = _present(chunks).select(*keys, "start_sample", size.alias("_n"), F.transform(
        "samples", lambda v: F.coalesce(flag(v), F.lit(False))).alias("_f"))
    flags = flags.where(F.array_contains("_f", True))

    def edges(step: int) -> Column:
        """Places that hold while the neighbour in that direction does not."""
        return F.filter(F.transform("_f", lambda f, i: F.when(
            f & ~F.coalesce(F.get("_f", i + step), F.lit(False)), i)), lambda i: i.isNotNull())

    pairs = F.arrays_zip(edges(-1).alias("a"), edges(1).alias("b"))
    found = flags.select(*keys, "start_sample", "_n", F.explode(pairs).alias("_r")).select(
        *keys, (begin + F.col("_r.a")).alias("start"), (begin + F.col("_r.b") + 1).alias("end"),
        ((F.col("_r.a") == 0) | (F.col("_r.b") == F.col("_n") - 1)).alias("_edge"))
    inner = found.where(~F.col("_edge")).drop("_edge")
    return inner.unionByName(ordered.join_touching(found.where("_edge").drop("_edge"), keys))


def code_histogram(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, code, n: how often each code occurs. Counted in the task that reads a chunk."""
    return _present(chunks).select(*keys, F.explode("samples").alias("code")).where(
        F.col("code").isNotNull()).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))


def code_quantile(histogram: DataFrame, keys: Sequence[str], p: float, out: str) -> DataFrame:
    """Quantile with linear interpolation of counted codes (a few hundred to a key)."""
    upto = Window.partitionBy(*keys).orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = histogram.withColumns({"_cum": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    place = F.lit(float(p)) * (F.col("_all") - 1)
    at = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("code").cast("double")))
    found = seen.groupBy(*keys).agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"),
                                    F.max(place - F.floor(place)).alias("_step"))
    return found.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_step")).alias(out))


def zero_baseline(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tell an intentional zero baseline from clipping at the lower rail, as `quality.zero_baseline` does.

    The longest run holds zeros only, so the codes outside it are the histogram less its length.
    """
    longest = quality.longest_run(runs(chunks, keys, lambda v: v == 0), keys)
    codes = staged(code_histogram(chunks, keys), "codes")
    counts = lengths(chunks, keys).join(codes.where("code = 0").select(*keys, F.col("n").alias("clip_low")), list(keys), "left")
    counts = counts.withColumn("clip_low", F.coalesce("clip_low", F.lit(0)))
    run = F.when(F.col("code") == 0, F.coalesce(F.col("base_end") - F.col("base_start"), F.lit(0))).otherwise(F.lit(0))
    rest = codes.join(longest, list(keys), "left").withColumn("n", F.col("n") - run).where("n > 0").select(*keys, "code", "n")
    return quality.baseline_verdict(counts, longest, code_quantile(rest, keys, 0.01, "_p1"), keys)


# All checks ------------------------------------------------------------------------

def file_table(chunks: DataFrame, keys: Sequence[str], channel: str, fs: float, low: Column, high: Column,
               block: int | None = None, variation_samples: int | None = None, facts: Sequence[DataFrame] = (),
               rules: Mapping[str, tuple[str, str, float]] | None = None, by_channel: DataFrame | None = None,
               alone: bool = False) -> DataFrame:
    """The quality table of `filetable.file_table`, from chunks.

    `by_channel` are the chunks that offsets are taken from, if not the same; `alone` says that
    recordings have one channel, so that whole blocks need no merging.
    """
    keys = list(keys)
    block = block or quality.block_samples(fs)
    blocks = staged(quiet_blocks(chunks, keys, block, alone), "quiet-blocks")
    out = clipping(chunks, keys, low, high)
    for part in (worst_dc_offset(chunks if by_channel is None else by_channel, keys, channel),
                 leading_quiet(chunks, blocks, keys, block, fs),
                 quality.longest_quiet(quality.quiet_runs(blocks, keys, block, fs), keys),
                 rms_variation(chunks, keys, variation_samples or max(1, round(fs)), alone), *facts):
        out = out.join(part, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("flat_max_s", "silent_max_s")})
    out = out.withColumn("quiet_start", F.col("leading_quiet_s") >= fv.QC_MIN_RUN_S)
    return quality.metadata_checks(out, rules) if rules else out
