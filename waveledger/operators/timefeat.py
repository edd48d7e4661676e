"""Time-domain statistics: per window (arrays) and per recording (aggregates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import arrays as A, ordered
from waveledger.functions.scalars import finite_or_zero, is_finite


def _moments(df: DataFrame, samples: str) -> DataFrame:
    """Centre the window once, then add n and the 2nd-4th central moments."""
    centre = A.mean(samples)
    out = df.withColumn("_n", F.size(samples).cast("double")).withColumn("_mean", centre)
    out = out.withColumn("_ac", A.centred(samples, F.col("_mean")))
    return out.withColumns({
        "_m1": F.try_divide(A.total("_ac"), F.col("_n")),
        "_m2": F.try_divide(A.total("_ac", lambda x: x * x), F.col("_n")),
        "_m3": F.try_divide(A.total("_ac", lambda x: x * x * x), F.col("_n")),
        "_m4": F.try_divide(A.total("_ac", lambda x: x * x * x * x), F.col("_n")),
        "_peak": A.peak("_ac"),
    })


_SCRATCH = ["_n", "_mean", "_ac", "_m1", "_m2", "_m3", "_m4", "_peak"]


def window_time_features(windows: DataFrame, samples: str = "samples") -> DataFrame:
    """Mean, std, RMS, peak, crest, zero-crossing rate, skew and Pearson kurtosis.

    Statistics are of the window after removal of its mean; moments are population
    moments.  Windows under 32 samples get `feat_valid` 0 and null features.
    """
    out = _moments(windows, samples)
    rms = F.sqrt("_m2")
    features = {
        "mean": F.col("_m1"),
        "std": rms,
        "rms": rms,
        "peak": F.col("_peak"),
        "crest": F.col("_peak") / (rms + F.lit(1e-12)),
        "zcr": A.sign_changes("_ac") / (F.col("_n") - 1),
        "skew": F.try_divide(F.col("_m3"), F.pow("_m2", F.lit(1.5))),
        "kurtosis": F.try_divide(F.col("_m4"), F.col("_m2") * F.col("_m2")),
    }
    valid = F.col("_n") >= fv.MIN_VALID_SAMPLES
    out = out.withColumn("feat_valid", F.when(valid, 1.0).otherwise(0.0))
    return out.withColumns({
        name: F.when(valid, finite_or_zero(c)) for name, c in features.items()
    }).drop(*_SCRATCH)


def short_window_features(windows: DataFrame, samples: str = "samples") -> DataFrame:
    """RMS, peak-to-peak, crest factor, kurtosis and a `status` column.

    Windows that the strict rules reject (non-finite or zero energy) keep their row with
    a status other than `ok` and null features.
    """
    finite = F.forall(F.col(samples), is_finite)
    out = _moments(windows.withColumn("_finite", finite), samples)
    rms = F.sqrt("_m2")
    status = (F.when(F.col("_n") == 0, "empty").when(~F.col("_finite"), "non-finite")
              .when(F.array_max(samples) == F.array_min(samples), "zero energy").otherwise("ok"))
    out = out.withColumn("status", status)
    features = {
        "RMS": rms,
        "PTP": F.array_max("_ac") - F.array_min("_ac"),
        "CF": F.try_divide(F.col("_peak"), rms),
        "Kurtosis": F.try_divide(F.col("_m4"), F.col("_m2") * F.col("_m2")),
    }
    return out.withColumns({
        name: F.when(F.col("status") == "ok", c) for name, c in features.items()
    }).drop("_finite", *_SCRATCH)


def ac_metrics(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Removed mean, then RMS, peak-to-peak and crest of what remains (crest null if RMS 0)."""
    v = F.col(value)
    out = samples.groupBy(*keys).agg(
        F.avg(v).alias("removed_mean"), F.stddev_pop(v).alias("rms"),
        (F.max(v) - F.min(v)).alias("peak_to_peak"),
        F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    peak = F.greatest(F.col("_hi") - F.col("removed_mean"), F.col("removed_mean") - F.col("_lo"))
    return out.withColumn("crest", F.when(F.col("peak_to_peak") > 0,
                                          F.try_divide(peak, F.col("rms")))).drop("_lo", "_hi")


def channel_stats(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Min, max, peak-to-peak, mean, RMS and std over finite samples."""
    v = F.col(value)
    return samples.where(is_finite(v)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"),
        (F.max(v) - F.min(v)).alias("vpp"), F.avg(v).alias("mean"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_pop(v).alias("std"))


def quantisation(samples: DataFrame, keys: Sequence[str], value: str = "value",
                 max_levels: int = 5000) -> DataFrame:
    """Distinct levels, smallest step (LSB) and effective bits.

    Step and bits are null unless the channel has 2 to `max_levels` distinct levels; only
    such channels reach the ordered step, so its groups are bounded.
    """
    v = F.col(value)
    levels = samples.where(is_finite(v)).groupBy(*keys, v.alias("_v")).agg(F.lit(1).alias("_one"))
    counts = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"),
                                       (F.max("_v") - F.min("_v")).alias("vpp"))
    few = counts.where((F.col("levels") > 1) & (F.col("levels") <= max_levels)).select(*keys)
    step = F.col("_v") - F.lag("_v").over(Window.partitionBy(*keys).orderBy("_v"))
    steps = (levels.join(few, list(keys), "left_semi").withColumn("_step", step)
             .where(F.col("_step") > 1e-12).groupBy(*keys).agg(F.min("_step").alias("lsb")))
    return (counts.join(steps, list(keys), "left")
            .withColumn("effective_bits", F.log2(F.col("vpp") / F.col("lsb"))))


def dc_offsets(samples: DataFrame, keys: Sequence[str], channel: str,
               value: str = "value") -> DataFrame:
    """Per channel: mean and |mean| as percent of RMS."""
    v = F.col(value)
    return offset_percent(samples.groupBy(*keys, channel).agg(
        F.avg(v).alias("dc"), F.sqrt(F.avg(v * v)).alias("_rms")))


def offset_percent(offsets: DataFrame) -> DataFrame:
    return offsets.withColumn("dc_pct_rms", F.when(
        F.col("_rms") > 0, F.lit(100.0) * F.abs("dc") / F.col("_rms")).otherwise(0.0)).drop("_rms")


def worst_dc_offset(samples: DataFrame, keys: Sequence[str], channel: str,
                    value: str = "value") -> DataFrame:
    """The offset largest in size over channels (ties: first channel) and the worst percent."""
    return worst_of_offsets(dc_offsets(samples, keys, channel, value), keys, channel)


def worst_of_offsets(per: DataFrame, keys: Sequence[str], channel: str) -> DataFrame:
    first_worst = F.min_by("dc", F.struct(-F.abs("dc"), F.col(channel)))
    return per.groupBy(*keys).agg(first_worst.alias("dc_offset"),
                                  F.max("dc_pct_rms").alias("dc_offset_pct_rms"),
                                  F.count(F.lit(1)).alias("channels"))


def clipping(samples: DataFrame, keys: Sequence[str], low: Column | None, high: Column | None,
             value: str = "value") -> DataFrame:
    """Samples at or beyond the rails; null counts when the rails are unknown."""
    v = F.col(value)
    if low is None or high is None:
        return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
            *keys, "n", F.lit(None).cast("bigint").alias("clip_count"),
            F.lit(None).cast("double").alias("clip_fraction"), F.lit(False).alias("clipped"),
            F.lit(fv.CLIPPING_UNKNOWN).alias("clipping_status"))
    hits = (v <= low).cast("bigint") + (v >= high).cast("bigint")
    return clip_verdict(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(hits).alias("clip_count")))


def clip_verdict(counts: DataFrame) -> DataFrame:
    return (counts.withColumn("clip_fraction", F.col("clip_count") / F.col("n"))
            .withColumn("clipped", F.col("clip_count") > 0)
            .withColumn("clipping_status", F.when(F.col("clipped"), fv.CLIPPING_FOUND)
                        .otherwise(fv.CLIPPING_NONE)))


def rms_variation(samples: DataFrame, keys: Sequence[str], size: int,
                  value: str = "value") -> DataFrame:
    """(max - min) / median of the RMS of complete tumbling windows, in percent.

    Null when a recording has fewer than two windows or a median of zero.
    """
    v = F.col(value)
    complete = samples.where(F.col("i") < F.floor(F.col("n") / F.lit(size)) * size)
    per = (complete.groupBy(*keys, F.floor(F.col("i") / F.lit(size)).alias("_w"))
           .agg(F.sqrt(F.avg(v * v)).alias("rms")))
    return variation_of(per, keys)


def variation_of(per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The variation of windows whose RMS is known (keys, rms)."""
    spread = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"),
                                    F.max("rms").alias("_hi"), F.min("rms").alias("_lo"))
    mid = ordered.quantiles(per, keys, "rms", {"median_rms": 0.5})
    pct = F.when((F.col("n_windows") >= 2) & (F.col("median_rms") > 0),
                 (F.col("_hi") - F.col("_lo")) / F.col("median_rms") * 100.0)
    return (spread.join(mid, list(keys)).withColumn("rms_variation_pct", pct)
            .select(*keys, "n_windows", "median_rms", "rms_variation_pct"))


def stereo_quality(samples: DataFrame, keys: Sequence[str], left: str, right: str,
                   rail: Column) -> DataFrame:
    """Per file: channel correlation, share of clipped samples, RMS kept by the mono mix."""
    l, r = F.col(left), F.col(right)
    clipped = (F.abs(l) >= rail).cast("double") + (F.abs(r) >= rail).cast("double")
    mix = (l + r) / 2.0
    out = samples.groupBy(*keys).agg(
        F.corr(l, r).alias("correlation"), F.avg(clipped / 2.0).alias("clipped_fraction"),
        F.sqrt(F.avg(mix * mix)).alias("_mix"), F.sqrt(F.avg(l * l)).alias("_l"),
        F.sqrt(F.avg(r * r)).alias("_r"))
    return out.withColumn("mix_rms_retention", F.try_divide(
        F.col("_mix"), F.greatest("_l", "_r"))).drop("_mix", "_l", "_r")


def stereo_summary(per_file: DataFrame) -> DataFrame:
    """One row: medians and extremes over all files."""
    one = per_file.withColumn("_all", F.lit(0))
    medians = [
        ordered.quantiles(one, ["_all"], c, {name: 0.5})
        for c, name in (("correlation", "median_channel_correlation"),
                        ("mix_rms_retention", "median_mix_rms_retention"),
                        ("clipped_fraction", "median_clipped_fraction"))]
    out = one.groupBy("_all").agg(
        F.min("correlation").alias("minimum_channel_correlation"),
        F.max("clipped_fraction").alias("maximum_clipped_fraction"))
    for m in medians:
        out = out.join(m, "_all")
    return out.drop("_all")


def recording_means(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), *[F.avg(c).alias(c) for c in names])
