"""Time-domain, window and run-length queries over events read as samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveledger.functions import arrays as A, ordered
from waveledger.functions.scalars import rounded
from waveledger.operators import chunked, filetable, quality, readings, timefeat, windows
from waveledger.plans import standins as S
from waveledger.plans.registry import ORACLES, query

REC = ["recording_id"]


def _rounded(df, keep, cols, digits=6):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in cols])


# Indexing and time axis -----------------------------------------------------------

@query("time_axis", f"""
WITH {S.SIG}, steps AS (
  SELECT recording_id, ts, i,
         date_diff('microsecond', lag(ts) OVER (PARTITION BY recording_id ORDER BY i), ts) AS step
  FROM sig)
SELECT recording_id, count(*) AS n_samples, count(DISTINCT ts) AS n_distinct_times,
       round(date_diff('microsecond', min(ts), max(ts)) / (count(*) - 1), 0) + 0.0 AS true_interval_us,
       median(step) FILTER (WHERE step > 0) AS median_step_us
FROM steps GROUP BY recording_id""")
def time_axis(spark, sf):
    s = S.samples(spark, sf).withColumn("t_us", ordered.epoch_micros("ts"))
    nxt = ordered.with_next(s.select("recording_id", "i", "t_us"), REC, "i", ["t_us"])
    steps = nxt.withColumn("step", F.col("next_t_us") - F.col("t_us"))
    mid = ordered.quantiles(steps.where("step > 0"), REC, "step", {"median_step_us": 0.5})
    distinct = steps.groupBy("recording_id", "t_us").agg(F.count(F.lit(1)).alias("c"))
    base = distinct.groupBy("recording_id").agg(
        F.sum("c").alias("n_samples"), F.count(F.lit(1)).alias("n_distinct_times"),
        (F.max("t_us") - F.min("t_us")).alias("_dur"))
    out = base.join(mid, REC, "left").withColumn(
        "true_interval_us", F.try_divide(F.col("_dur"), F.col("n_samples") - 1))
    return out.select("recording_id", "n_samples", "n_distinct_times",
                      rounded("true_interval_us", 0).alias("true_interval_us"), "median_step_us")


@query("sliding_windows", f"""
WITH {S.SIG}, w AS (
  SELECT recording_id, n, value, i, unnest(range(CASE WHEN i < 8 THEN 0 ELSE (i - 8) // 4 + 1 END, i // 4 + 1)) AS segment_index
  FROM sig)
SELECT recording_id, segment_index, min(i) AS start_sample, count(*) AS n_samples,
       round(min(i) / 8.0, 6) + 0.0 AS segment_start_s, round(min(i) / 8.0 + 1.0, 6) + 0.0 AS segment_end_s,
       round(sqrt(avg(value * value)), 6) + 0.0 AS rms
FROM w WHERE segment_index * 4 + 8 <= n GROUP BY recording_id, segment_index""")
def sliding_windows(spark, sf):
    size, hop = windows.window_lengths(1.0, 0.5, 8.0)
    assigned = windows.assign_windows(S.samples(spark, sf), size, hop)
    out = assigned.groupBy("recording_id", "segment_index").agg(
        F.min("i").alias("start_sample"), F.count(F.lit(1)).alias("n_samples"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    out = windows.window_times(out, 8.0, size)
    return _rounded(out, ["recording_id", "segment_index", "start_sample", "n_samples"],
                    ["segment_start_s", "segment_end_s", "rms"])


@query("chunk_windows", f"""
WITH {S.SIG}, w AS (
  SELECT recording_id, n, value, i, unnest(range(CASE WHEN i < 12 THEN 0 ELSE (i - 12) // 5 + 1 END, i // 5 + 1)) AS segment_index
  FROM sig)
SELECT recording_id, segment_index, min(i) AS start_sample, count(*) AS n_samples,
       round(sqrt(avg(value * value)), 6) + 0.0 AS rms, round(arg_min(value, i), 6) + 0.0 AS first_value
FROM w WHERE segment_index * 5 + 12 <= n GROUP BY recording_id, segment_index""")
def chunk_windows(spark, sf):
    """Windows put together from stored chunks of 16 samples."""
    from waveledger.functions import arrays as A

    pairs = F.array_sort(F.collect_list(F.struct("i", "value")))
    chunks = (S.samples(spark, sf).groupBy("recording_id", "n", F.floor(F.col("i") / 16).alias("c"))
              .agg(pairs.alias("_p"))
              .select("recording_id", "n", (F.col("c") * 16).alias("start_sample"),
                      F.transform("_p", lambda p: p["value"]).alias("samples")))
    w = windows.windows_from_chunks(chunks, REC, 12, 5)
    return w.select("recording_id", "segment_index", "start_sample",
                    F.size("samples").cast("bigint").alias("n_samples"),
                    rounded(F.sqrt(A.total("samples", lambda x: x * x) / F.size("samples"))).alias("rms"),
                    rounded(F.get(F.col("samples"), F.lit(0))).alias("first_value"))


@query("spaced_windows", f"""
WITH {S.SIG}, slots AS (SELECT k, CAST(floor(k * 6.0 / 4 * 8) AS BIGINT) AS s FROM range(4) t(k)),
placed AS (
  SELECT recording_id, k AS segment_index, value, i - 4 AS j, s FROM sig, slots
  WHERE i >= 4 AND i - 4 < 64 AND i - 4 >= s AND i - 4 < s + 16)
SELECT recording_id, CAST(segment_index AS BIGINT) AS segment_index, count(*) AS n_present,
       round(sum(value) / 16, 6) + 0.0 AS padded_mean
FROM placed GROUP BY recording_id, segment_index HAVING count(*) >= 8""")
def spaced_windows(spark, sf):
    from waveledger.functions import arrays as A

    w = windows.spaced_windows(S.samples(spark, sf), REC, fs=8.0, window_s=2.0, n_windows=4,
                               usable_s=8.0, skip_s=0.5)
    return w.select("recording_id", F.col("segment_index").cast("bigint").alias("segment_index"),
                    F.col("n_present").cast("bigint").alias("n_present"),
                    rounded(A.mean("samples")).alias("padded_mean"))


@query("tumbling_windows", f"""
WITH {S.SIG}, c AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY recording_id)
SELECT recording_id, n, greatest(n - 5, 0) // 10 AS windows, greatest(n - 5, 0) % 10 AS discarded_tail_samples
FROM c""")
def tumbling_windows(spark, sf):
    return windows.tumbling_summary(S.raw_samples(spark, sf), REC, size=10, skip=5)


@query("envelope", f"""
WITH {S.SIG}, b AS (
  SELECT *, ((i + 1) * least(16, n) - 1) // n AS bin FROM sig)
SELECT recording_id, bin, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high,
       count(*) AS n_samples, round((min(i) + max(i)) / 16.0, 6) + 0.0 AS center_s
FROM b GROUP BY recording_id, bin""")
def envelope(spark, sf):
    out = windows.envelope(S.samples(spark, sf), REC, fs=8.0, bins=16)
    return _rounded(out, ["recording_id", "bin", "n_samples"], ["low", "high", "center_s"])


# Statistics -----------------------------------------------------------------------

_MOMENT_SQL = """
  count(*) AS n, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4,
  max(abs(x)) AS peak"""


@query("time_features", f"""
WITH {S.SIG}, placed AS (
  SELECT recording_id, i, value, n, unnest(range(CASE WHEN i < 32 THEN 0 ELSE (i - 32) // 16 + 1 END, i // 16 + 1)) AS segment_index
  FROM sig),
ac AS (
  SELECT recording_id, segment_index, i, value - avg(value) OVER w AS x
  FROM placed WHERE segment_index * 16 + 32 <= n
  WINDOW w AS (PARTITION BY recording_id, segment_index)),
pairs AS (
  SELECT *, x * lag(x) OVER (PARTITION BY recording_id, segment_index ORDER BY i) AS prod FROM ac),
m AS (
  SELECT recording_id, segment_index, {_MOMENT_SQL}, count(*) FILTER (WHERE prod < 0) AS crossings
  FROM pairs GROUP BY recording_id, segment_index)
SELECT recording_id, segment_index, 1.0::DOUBLE AS feat_valid,
  round(m1, 7) + 0.0 AS mean, round(sqrt(m2), 7) + 0.0 AS std, round(sqrt(m2), 7) + 0.0 AS rms,
  round(peak, 7) + 0.0 AS peak, round(peak / (sqrt(m2) + 1e-12), 7) + 0.0 AS crest,
  round(crossings / (n - 1), 7) + 0.0 AS zcr, round(m3 / pow(m2, 1.5), 7) + 0.0 AS skew,
  round(m4 / (m2 * m2), 7) + 0.0 AS kurtosis
FROM m""")
def time_features(spark, sf):
    w = windows.sliding_windows(S.samples(spark, sf), REC, 32, 16)
    out = timefeat.window_time_features(w)
    return _rounded(out, ["recording_id", "segment_index"],
                    ["feat_valid", "mean", "std", "rms", "peak", "crest", "zcr", "skew", "kurtosis"], 7)


@query("time_features_short", f"""
WITH {S.WIN}, ac AS (
  SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM win),
m AS (SELECT vec_id, max(x) - min(x) AS ptp, {_MOMENT_SQL} FROM ac GROUP BY vec_id)
SELECT vec_id, 'ok' AS status, round(sqrt(m2), 6) + 0.0 AS "RMS", round(ptp, 6) + 0.0 AS "PTP",
  round(peak / sqrt(m2), 6) + 0.0 AS "CF", round(m4 / (m2 * m2), 6) + 0.0 AS "Kurtosis"
FROM m""")
def time_features_short(spark, sf):
    out = timefeat.short_window_features(S.windows(spark, sf))
    return _rounded(out, ["vec_id", "status"], ["RMS", "PTP", "CF", "Kurtosis"])


@query("ac_metrics", """
WITH s AS (
  SELECT user_id AS recording_id, avg(value) AS m, stddev_pop(value) AS rms, max(value) - min(value) AS p2p,
         max(value) AS hi, min(value) AS lo FROM events GROUP BY user_id)
SELECT recording_id, round(m, 6) + 0.0 AS removed_mean, round(rms, 6) + 0.0 AS rms,
       round(p2p, 6) + 0.0 AS peak_to_peak,
       round(CASE WHEN rms > 0 THEN greatest(hi - m, m - lo) / rms END, 6) + 0.0 AS crest
FROM s""")
def ac_metrics(spark, sf):
    out = timefeat.ac_metrics(S.raw_samples(spark, sf), REC)
    return _rounded(out, REC, ["removed_mean", "rms", "peak_to_peak", "crest"])


@query("channel_stats", """
SELECT user_id AS recording_id, event_type AS channel, count(*) AS n, round(min(value), 6) + 0.0 AS vmin,
  round(max(value), 6) + 0.0 AS vmax, round(max(value) - min(value), 6) + 0.0 AS vpp,
  round(avg(value), 6) + 0.0 AS mean, round(sqrt(avg(value * value)), 6) + 0.0 AS rms,
  round(stddev_pop(value), 6) + 0.0 AS std
FROM events GROUP BY user_id, event_type""")
def channel_stats(spark, sf):
    out = timefeat.channel_stats(S.raw_samples(spark, sf), ["recording_id", "channel"])
    return _rounded(out, ["recording_id", "channel", "n"],
                    ["vmin", "vmax", "vpp", "mean", "rms", "std"])


@query("quantisation", """
WITH levels AS (SELECT DISTINCT l_returnflag AS quantity, l_quantity AS v FROM lineitem),
steps AS (SELECT *, v - lag(v) OVER (PARTITION BY quantity ORDER BY v) AS step FROM levels),
s AS (SELECT quantity, count(*) AS levels, max(v) - min(v) AS vpp,
             min(step) FILTER (WHERE step > 1e-12) AS lsb FROM steps GROUP BY quantity)
SELECT quantity, levels, round(vpp, 6) + 0.0 AS vpp, round(lsb, 6) + 0.0 AS lsb,
       round(log2(vpp / lsb), 6) + 0.0 AS effective_bits FROM s""")
def quantisation(spark, sf):
    out = timefeat.quantisation(S.readings(spark, sf), ["quantity"])
    return _rounded(out, ["quantity", "levels"], ["vpp", "lsb", "effective_bits"])


@query("clipping", """
WITH c AS (
  SELECT user_id AS recording_id, count(*) AS n,
         sum((value <= 1.0)::INT + (value >= 200.0)::INT)::BIGINT AS clip_count
  FROM events GROUP BY user_id)
SELECT recording_id, n, clip_count, round(clip_count / n, 6) + 0.0 AS clip_fraction, clip_count > 0 AS clipped,
       CASE WHEN clip_count > 0 THEN 'limit samples detected' ELSE 'not detected' END AS clipping_status
FROM c""")
def clipping(spark, sf):
    out = timefeat.clipping(S.raw_samples(spark, sf), REC, F.lit(1.0), F.lit(200.0))
    return out.withColumn("clip_fraction", rounded("clip_fraction"))


@query("dc_offset", """
WITH c AS (
  SELECT user_id AS recording_id, event_type AS channel, avg(value - 45) AS dc,
         sqrt(avg((value - 45) * (value - 45))) AS rms
  FROM events GROUP BY user_id, event_type),
p AS (SELECT *, CASE WHEN rms > 0 THEN 100 * abs(dc) / rms ELSE 0 END AS pct,
             row_number() OVER (PARTITION BY recording_id ORDER BY abs(dc) DESC, channel) AS rn FROM c)
SELECT recording_id, round(max(dc) FILTER (WHERE rn = 1), 6) + 0.0 AS dc_offset,
       round(max(pct), 6) + 0.0 AS dc_offset_pct_rms, count(*) AS channels
FROM p GROUP BY recording_id""")
def dc_offset(spark, sf):
    shifted = S.raw_samples(spark, sf).withColumn("value", F.col("value") - 45)
    out = timefeat.worst_dc_offset(shifted, REC, "channel")
    return _rounded(out, ["recording_id", "channels"], ["dc_offset", "dc_offset_pct_rms"])


@query("rms_variation", f"""
WITH {S.SIG}, w AS (
  SELECT recording_id, i // 8 AS w, sqrt(avg(value * value)) AS rms
  FROM sig WHERE i < n // 8 * 8 GROUP BY recording_id, i // 8)
SELECT recording_id, count(*) AS n_windows, round(median(rms), 6) + 0.0 AS median_rms,
       round(CASE WHEN count(*) >= 2 AND median(rms) > 0
                  THEN (max(rms) - min(rms)) / median(rms) * 100 END, 6) + 0.0 AS rms_variation_pct
FROM w GROUP BY recording_id""")
def rms_variation(spark, sf):
    out = timefeat.rms_variation(S.staged_samples(spark, sf), REC, size=8)
    return _rounded(out, ["recording_id", "n_windows"], ["median_rms", "rms_variation_pct"])


_STEREO_SQL = """
per AS (
  SELECT l_suppkey AS recording_id, corr(l, r) AS correlation,
    avg(((abs(l) >= 0.9)::INT + (abs(r) >= 0.9)::INT) / 2.0) AS clipped_fraction,
    sqrt(avg(((l + r) / 2) * ((l + r) / 2))) / greatest(sqrt(avg(l * l)), sqrt(avg(r * r))) AS mix_rms_retention
  FROM (SELECT l_suppkey, l_extendedprice / 100000 AS l, l_quantity / 50 AS r FROM lineitem)
  GROUP BY l_suppkey)"""


def _stereo(spark, sf):
    two = S.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"), (F.col("l_extendedprice") / 100000).alias("l"),
        (F.col("l_quantity") / 50).alias("r"))
    return timefeat.stereo_quality(two, REC, "l", "r", F.lit(0.9))


@query("stereo_quality", f"""
WITH {_STEREO_SQL}
SELECT recording_id, round(correlation, 6) + 0.0 AS correlation,
  round(clipped_fraction, 6) + 0.0 AS clipped_fraction, round(mix_rms_retention, 6) + 0.0 AS mix_rms_retention
FROM per""")
def stereo_quality(spark, sf):
    return _rounded(_stereo(spark, sf), REC,
                    ["correlation", "clipped_fraction", "mix_rms_retention"])


@query("stereo_summary", f"""
WITH {_STEREO_SQL}
SELECT round(median(correlation), 6) + 0.0 AS median_channel_correlation,
  round(min(correlation), 6) + 0.0 AS minimum_channel_correlation,
  round(median(mix_rms_retention), 6) + 0.0 AS median_mix_rms_retention,
  round(max(clipped_fraction), 6) + 0.0 AS maximum_clipped_fraction,
  round(median(clipped_fraction), 6) + 0.0 AS median_clipped_fraction
FROM per""")
def stereo_summary(spark, sf):
    out = timefeat.stereo_summary(_stereo(spark, sf))
    return _rounded(out, [], ["median_channel_correlation", "minimum_channel_correlation",
                              "median_mix_rms_retention", "maximum_clipped_fraction",
                              "median_clipped_fraction"])


# Quiet parts ----------------------------------------------------------------------

_FS, _BLOCK = 64.0, 2

_BLOCKS_SQL = S.GATED + """, blocks AS (
  SELECT recording_id, i // 2 AS block, sqrt(avg(value * value)) AS rms, max(value) = min(value) AS flat
  FROM gated WHERE i < n // 2 * 2 GROUP BY recording_id, i // 2),
lim AS (
  SELECT b.recording_id, greatest(0.01 * median(rms), 1e-6 * any_value(p.peak)) AS limit_rms
  FROM blocks b JOIN (SELECT recording_id, max(abs(value)) AS peak FROM gated GROUP BY 1) p USING (recording_id)
  GROUP BY b.recording_id),
marked AS (
  SELECT b.recording_id, b.block, b.flat, b.rms <= l.limit_rms AS silent
  FROM blocks b JOIN lim l USING (recording_id))"""


def _blocks(spark, sf):
    s = S.gated_samples(spark, sf)
    return s, quality.quiet_blocks(s, REC, _BLOCK)


@query("quiet_runs", f"""
WITH {_BLOCKS_SQL}, kinds AS (
  SELECT recording_id, 'flat' AS kind, block FROM marked WHERE flat
  UNION ALL SELECT recording_id, 'silent', block FROM marked WHERE silent),
isl AS (
  SELECT *, block - row_number() OVER (PARTITION BY recording_id, kind ORDER BY block) AS g FROM kinds),
r AS (SELECT recording_id, kind, min(block) AS a, max(block) + 1 AS b FROM isl GROUP BY recording_id, kind, g)
SELECT recording_id, kind, round(a * 2 / 64.0, 6) + 0.0 AS start_s, round(b * 2 / 64.0, 6) + 0.0 AS end_s,
       b - a AS blocks
FROM r WHERE (b - a) * 2 / 64.0 >= 0.0625""")
def quiet_runs(spark, sf):
    _, blocks = _blocks(spark, sf)
    found = quality.quiet_runs(blocks, REC, _BLOCK, _FS)
    out = quality.long_quiet_runs(found, _BLOCK, _FS, min_run_s=0.0625)
    return _rounded(out, ["recording_id", "kind", "blocks"], ["start_s", "end_s"])


@query("leading_quiet", f"""
WITH {_BLOCKS_SQL}, f AS (
  SELECT recording_id, min(block) FILTER (WHERE NOT (flat OR silent)) AS first_active FROM marked GROUP BY 1),
c AS (SELECT recording_id, count(*) AS n FROM gated GROUP BY 1)
SELECT c.recording_id, round(CASE WHEN f.recording_id IS NULL THEN 0.0
         WHEN first_active IS NULL THEN n / 64.0 ELSE first_active * 2 / 64.0 END, 6) + 0.0 AS leading_quiet_s
FROM c LEFT JOIN f USING (recording_id)""")
def leading_quiet(spark, sf):
    s, blocks = _blocks(spark, sf)
    return _rounded(quality.leading_quiet(s, blocks, REC, _BLOCK, _FS), REC, ["leading_quiet_s"])


@query("zero_baseline", f"""
WITH {S.GATED}, z AS (
  SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS g
  FROM gated WHERE value = 0),
r AS (SELECT recording_id, min(i) AS a, max(i) + 1 AS b FROM z GROUP BY recording_id, g),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY b - a DESC, a) = 1),
c AS (SELECT recording_id, count(*) AS n, count(*) FILTER (WHERE value = 0) AS clip_low FROM gated GROUP BY 1),
rest AS (
  SELECT g.recording_id, quantile_cont(value, 0.01) AS p1
  FROM gated g LEFT JOIN best USING (recording_id) WHERE a IS NULL OR i < a OR i >= b GROUP BY 1)
SELECT c.recording_id, n, clip_low, coalesce(b - a, 0) AS base_run, coalesce(a, 0) AS base_start,
  round(coalesce((b - a) / clip_low, 0), 6) + 0.0 AS run_share,
  CASE WHEN clip_low > 0 THEN CAST(floor(p1) AS BIGINT) END AS headroom_code,
  clip_low > 0 AND coalesce((b - a) / clip_low, 0) > 0.98 AND (p1 IS NULL OR floor(p1) >= 4) AS zero_is_baseline
FROM c LEFT JOIN best USING (recording_id) LEFT JOIN rest USING (recording_id)""")
def zero_baseline(spark, sf):
    out = quality.zero_baseline(S.gated_samples(spark, sf), REC)
    return out.withColumn("run_share", rounded("run_share"))


@query("waveform_violations", """
WITH ch AS (
  SELECT user_id AS recording_id, event_type, count(*) AS len,
         count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) AS bad
  FROM events GROUP BY 1, 2),
g AS (SELECT recording_id, sum(bad) AS bad, max(len) AS longest, min(len) AS shortest FROM ch GROUP BY 1),
h AS (SELECT c_custkey AS recording_id, c_acctbal AS fs, 15 + c_nationkey AS frames, c_custkey * 30 AS coded
      FROM customer)
SELECT h.recording_id, coalesce(longest, 0) AS n_frames,
  list_aggregate(list_filter([
    CASE WHEN coalesce(longest, 0) = 0 THEN 'empty' END, CASE WHEN bad > 0 THEN 'non-finite' END,
    CASE WHEN NOT (fs IS NOT NULL AND isfinite(fs) AND fs > 0) THEN 'invalid rate' END,
    CASE WHEN longest <> shortest THEN 'unequal channels' END,
    CASE WHEN frames IS NOT NULL AND longest <> frames THEN 'frame count' END,
    CASE WHEN abs(longest - coded) > 2048 THEN 'coded duration' END],
    lambda v: v IS NOT NULL), 'string_agg', ', ') AS violations
FROM h LEFT JOIN g USING (recording_id)""")
def waveform_violations(spark, sf):
    headers = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("recording_id"), F.col("c_acctbal").alias("fs"),
        (F.lit(15) + F.col("c_nationkey")).alias("frames"),
        (F.col("c_custkey") * 30).alias("coded_frames"))
    out = quality.waveform_violations(S.raw_samples(spark, sf), headers, "recording_id", "channel")
    return out.withColumn("violations", F.nullif(F.array_join("violations", ", "), F.lit("")))


@query("recording_means", """
WITH w AS (
  SELECT user_id AS recording_id, event_type, sqrt(avg(value * value)) AS rms, max(value) AS peak
  FROM events GROUP BY 1, 2)
SELECT recording_id, count(*) AS n_windows, round(avg(rms), 6) + 0.0 AS rms, round(avg(peak), 6) + 0.0 AS vmax
FROM w GROUP BY 1""")
def recording_means(spark, sf):
    per = timefeat.channel_stats(S.raw_samples(spark, sf), ["recording_id", "channel"])
    return _rounded(timefeat.recording_means(per, REC, ["rms", "vmax"]),
                    ["recording_id", "n_windows"], ["rms", "vmax"])


_TABLE_NUM = ["clip_fraction", "dc_offset", "dc_offset_pct_rms", "leading_quiet_s", "flat_max_s", "silent_max_s",
              "median_rms", "rms_variation_pct", "spot_cv_pct"]


@query("file_table", f"""
WITH {_BLOCKS_SQL}, {S.READ}, kinds AS (
  SELECT recording_id, 'flat' AS kind, block FROM marked WHERE flat
  UNION ALL SELECT recording_id, 'silent', block FROM marked WHERE silent),
isl AS (SELECT *, block - row_number() OVER (PARTITION BY recording_id, kind ORDER BY block) AS g FROM kinds),
r AS (SELECT recording_id, kind, count(*) * 2 / 64.0 AS s FROM isl GROUP BY recording_id, kind, g),
quiet AS (SELECT recording_id, max(s) FILTER (WHERE kind = 'flat') AS flat_max_s, max(s) FILTER (WHERE kind = 'silent') AS silent_max_s
  FROM r GROUP BY recording_id),
first AS (SELECT recording_id, min(block) FILTER (WHERE NOT (flat OR silent)) AS f FROM marked GROUP BY 1),
clip AS (SELECT recording_id, count(*) AS n, sum((value <= -1.0)::INT + (value >= 150.0)::INT)::BIGINT AS clip_count FROM gated GROUP BY 1),
dc AS (SELECT recording_id, channel, avg(value) AS dc, sqrt(avg(value * value)) AS rms FROM gated GROUP BY ALL),
worst AS (SELECT recording_id, arg_min(dc, (-abs(dc), channel)) AS dc_offset, count(*) AS channels,
  max(CASE WHEN rms > 0 THEN 100 * abs(dc) / rms ELSE 0 END) AS dc_offset_pct_rms FROM dc GROUP BY 1),
w AS (SELECT recording_id, i // 8 AS w, sqrt(avg(value * value)) AS rms FROM gated WHERE i < n // 8 * 8 GROUP BY recording_id, i // 8),
rv AS (SELECT recording_id, count(*) AS n_windows, median(rms) AS median_rms,
  CASE WHEN count(*) >= 2 AND median(rms) > 0 THEN (max(rms) - min(rms)) / median(rms) * 100 END AS rms_variation_pct FROM w GROUP BY 1),
cv AS (SELECT recording_id, max(c) AS spot_cv_pct FROM (
  SELECT recording_id, quantity, CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) * 100 END AS c
  FROM readings GROUP BY ALL) GROUP BY 1),
dup AS (SELECT recording_id, count(*) OVER (PARTITION BY n) - 1 AS peers FROM clip),
t AS (
  SELECT clip.recording_id, n, clip_count, clip_count / n AS clip_fraction, clip_count > 0 AS clipped,
    dc_offset, dc_offset_pct_rms, channels,
    CASE WHEN first.recording_id IS NULL THEN 0.0 WHEN f IS NULL THEN n / 64.0 ELSE f * 2 / 64.0 END AS leading_quiet_s,
    coalesce(flat_max_s, 0) AS flat_max_s, coalesce(silent_max_s, 0) AS silent_max_s, n_windows, median_rms, rms_variation_pct,
    spot_cv_pct, CASE WHEN peers > 0 THEN peers END AS n_peers, 5 AS expected_channels
  FROM clip LEFT JOIN worst USING (recording_id) LEFT JOIN first USING (recording_id) LEFT JOIN quiet USING (recording_id)
  LEFT JOIN rv USING (recording_id) LEFT JOIN cv USING (recording_id) LEFT JOIN dup USING (recording_id))
SELECT recording_id, n, clip_count, clipped, channels, n_windows, n_peers, leading_quiet_s >= 0.1 AS quiet_start,
  channels = expected_channels AS channels_ok, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _TABLE_NUM)} FROM t""")
def file_table(spark, sf):
    """All checks of a recording in one row; recordings of one length stand for equal contents."""
    s = S.gated_samples(spark, sf)
    digests = s.groupBy("recording_id").agg(F.count(F.lit(1)).cast("string").alias("sha256"))
    peers = quality.duplicate_peers(digests, path="recording_id").select("recording_id", "n_peers")
    spread = readings.variation(S.readings(spark, sf), REC).select("recording_id", "spot_cv_pct")
    expected = digests.select("recording_id", F.lit(5).alias("expected_channels"))
    out = filetable.file_table(s, REC, "channel", _FS, F.lit(-1.0), F.lit(150.0), block=_BLOCK, variation_samples=8,
                               facts=[peers, spread, expected],
                               rules={"channels_ok": ("channels", "expected_channels", 0)})
    return _rounded(out, ["recording_id", "n", "clip_count", "clipped", "channels", "n_windows", "n_peers", "quiet_start",
                          "channels_ok"], _TABLE_NUM)


# The same checks from stored chunks, against the same SQL ---------------------------

def _chunked(name: str, long_form: str):
    """Register a chunk form of a query: its rows are those of the long form."""
    return query(name, ORACLES[long_form])


@_chunked("chunk_channel_stats", "channel_stats")
def chunk_channel_stats(spark, sf):
    out = chunked.channel_stats(S.chunks(S.samples(spark, sf), ["recording_id", "channel"]), ["recording_id", "channel"])
    return _rounded(out, ["recording_id", "channel", "n"], ["vmin", "vmax", "vpp", "mean", "rms", "std"])


@_chunked("chunk_clipping", "clipping")
def chunk_clipping(spark, sf):
    out = chunked.clipping(S.chunks(S.samples(spark, sf), REC), REC, F.lit(1.0), F.lit(200.0))
    return out.withColumn("clip_fraction", rounded("clip_fraction"))


@_chunked("chunk_dc_offset", "dc_offset")
def chunk_dc_offset(spark, sf):
    shifted = S.samples(spark, sf).withColumn("value", F.col("value") - 45)
    out = chunked.worst_dc_offset(S.chunks(shifted, ["recording_id", "channel"]), REC, "channel")
    return _rounded(out, ["recording_id", "channels"], ["dc_offset", "dc_offset_pct_rms"])


@_chunked("chunk_rms_variation", "rms_variation")
def chunk_rms_variation(spark, sf):
    """Windows of 8 from chunks of 13, so that most windows lie in two chunks."""
    out = chunked.rms_variation(S.chunks(S.samples(spark, sf), REC, 13), REC, size=8)
    return _rounded(out, ["recording_id", "n_windows"], ["median_rms", "rms_variation_pct"])


@_chunked("chunk_quiet_runs", "quiet_runs")
def chunk_quiet_runs(spark, sf):
    blocks = chunked.quiet_blocks(S.chunks(S.gated_samples(spark, sf), REC, 7), REC, _BLOCK)
    out = quality.long_quiet_runs(quality.quiet_runs(blocks, REC, _BLOCK, _FS), _BLOCK, _FS, min_run_s=0.0625)
    return _rounded(out, ["recording_id", "kind", "blocks"], ["start_s", "end_s"])


@_chunked("chunk_leading_quiet", "leading_quiet")
def chunk_leading_quiet(spark, sf):
    c = S.chunks(S.gated_samples(spark, sf), REC, 7)
    return _rounded(chunked.leading_quiet(c, chunked.quiet_blocks(c, REC, _BLOCK), REC, _BLOCK, _FS), REC, ["leading_quiet_s"])


@_chunked("chunk_zero_baseline", "zero_baseline")
def chunk_zero_baseline(spark, sf):
    out = chunked.zero_baseline(S.chunks(S.gated_samples(spark, sf), REC, 5), REC)
    return out.withColumn("run_share", rounded("run_share"))


@query("chunk_zero_runs", f"""
WITH {S.GATED}, z AS (
  SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS g FROM gated WHERE value = 0)
SELECT recording_id, min(i) AS start, max(i) + 1 AS "end" FROM z GROUP BY recording_id, g""")
def chunk_zero_runs(spark, sf):
    """Every run of zero samples, encoded inside chunks and joined at their edges."""
    return chunked.runs(S.chunks(S.gated_samples(spark, sf), REC, 5), REC, lambda v: v == 0)


@_chunked("chunk_envelope", "envelope")
def chunk_envelope(spark, sf):
    out = chunked.envelope(S.chunks(S.samples(spark, sf), REC, 11), REC, fs=8.0, bins=16)
    return _rounded(out, ["recording_id", "bin", "n_samples"], ["low", "high", "center_s"])


@query("tumbling_arrays", f"""
WITH {S.SIG}
SELECT recording_id, (i - 5) // 10 AS segment_index, min(i) - 5 AS start_sample, count(*) AS n_samples,
  round(sqrt(avg(value * value)), 6) + 0.0 AS rms, round(arg_min(value, i), 6) + 0.0 AS first_value
FROM sig WHERE i >= 5 AND i - 5 < (n - 5) // 10 * 10 GROUP BY recording_id, (i - 5) // 10""")
def tumbling_arrays(spark, sf):
    """Back-to-back windows of 10 samples after the first 5, as arrays from chunks."""
    w = chunked.tumbling_windows(S.chunks(S.samples(spark, sf), REC), REC, size=10, skip=5)
    return w.select("recording_id", "segment_index", "start_sample", F.size("samples").cast("bigint").alias("n_samples"),
                    rounded(F.sqrt(A.total("samples", lambda x: x * x) / F.size("samples"))).alias("rms"),
                    rounded(F.get(F.col("samples"), F.lit(0))).alias("first_value"))


@_chunked("chunk_file_table", "file_table")
def chunk_file_table(spark, sf):
    """All checks of a recording in one row, without a row per sample."""
    s = S.gated_samples(spark, sf)
    c = S.chunks(s, REC, 12)
    digests = chunked.lengths(c, REC).select("recording_id", F.col("n").cast("string").alias("sha256"))
    peers = quality.duplicate_peers(digests, path="recording_id").select("recording_id", "n_peers")
    spread = readings.variation(S.readings(spark, sf), REC).select("recording_id", "spot_cv_pct")
    expected = digests.select("recording_id", F.lit(5).alias("expected_channels"))
    out = chunked.file_table(c, REC, "channel", _FS, F.lit(-1.0), F.lit(150.0), block=_BLOCK, variation_samples=8,
                             facts=[peers, spread, expected], rules={"channels_ok": ("channels", "expected_channels", 0)},
                             by_channel=S.chunks(s, ["recording_id", "channel"]), alone=True)
    return _rounded(out, ["recording_id", "n", "clip_count", "clipped", "channels", "n_windows", "n_peers", "quiet_start",
                          "channels_ok"], _TABLE_NUM)


@_chunked("chunk_spaced_windows", "spaced_windows")
def chunk_spaced_windows(spark, sf):
    w = chunked.spaced_windows(S.chunks(S.samples(spark, sf), REC, 9), REC, fs=8.0, window_s=2.0, n_windows=4, usable_s=8.0, skip_s=0.5)
    return w.select("recording_id", F.col("segment_index").cast("bigint").alias("segment_index"),
                    F.col("n_present").cast("bigint").alias("n_present"), rounded(A.mean("samples")).alias("padded_mean"))
