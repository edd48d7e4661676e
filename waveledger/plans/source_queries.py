"""Readers, sinks and reuse of written tables; captures are derived from events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waveledger.functions.register import register
from waveledger.functions.scalars import rounded
from waveledger.operators import quality, timefeat
from waveledger.plans import captures, spectral_queries, standins as S
from waveledger.plans.registry import ORACLES, query
from waveledger.sources import capture, deep_memory, dispatch, files, scope_bin, scope_csv, tables, wav

_PARTS = S.SIG + """, parts AS (
  SELECT recording_id, i // 4096 AS part, i - i // 4096 * 4096 AS k, value,
    count(*) OVER (PARTITION BY recording_id, i // 4096) AS points FROM sig)"""


def _path(ext: str) -> str:
    return f"printf('rec%06d/part%04d.{ext}', recording_id, part)"


@query("bin_headers", f"""
WITH {_PARTS}
SELECT DISTINCT {_path('bin')} AS path, 'CH1(V)' AS channel, 8.0::DOUBLE AS rate_hz, points, 4 AS width, 164 AS payload_offset,
  CASE WHEN recording_id % 5 = 1 THEN points - 3 ELSE points END AS available_points,
  points * 0.125::DOUBLE AS declared_s, '2024-01-01 12:00:00' AS captured
FROM parts WHERE recording_id % 5 <> 2""")
def bin_headers(spark, sf):
    """Headers of all captures that have one (the faulty magics do not)."""
    out = scope_bin.headers(captures.scope_files(spark, sf, faulty=True)).where("error IS NULL")
    return out.select("path", "channel", "rate_hz", "points", "width",
                      F.col("payload_offset").cast("int").alias("payload_offset"),
                      "available_points", "declared_s", "captured")


@query("bin_durations", f"""
WITH {_PARTS}
SELECT DISTINCT {_path('bin')} AS path, CASE WHEN recording_id % 5 = 1 THEN points - 3 ELSE points END * 0.125::DOUBLE AS probed_s
FROM parts WHERE recording_id % 5 <> 2""")
def bin_durations(spark, sf):
    return scope_bin.durations(scope_bin.headers(captures.scope_files(spark, sf, faulty=True)))


@query("bin_validate", f"""
WITH {_PARTS}, f AS (SELECT DISTINCT recording_id, part, points FROM parts)
SELECT {_path('bin')} AS path, recording_id % 5 = 0 AS ok,
  CASE WHEN recording_id % 5 <> 2 THEN points END AS points,
  CASE recording_id % 5 WHEN 1 THEN points - 3 WHEN 2 THEN NULL ELSE points END AS available_points,
  CASE recording_id % 5 WHEN 1 THEN 'payload cut off'
    WHEN 2 THEN 'not a scope capture'
    WHEN 3 THEN printf('declared %d bytes, actual %d', 171 + 4 * points, 164 + 4 * points)
    WHEN 4 THEN printf('declared %d bytes, actual %d', 164 + 4 * points, 168 + 4 * points) END AS error
FROM f""")
def bin_validate(spark, sf):
    return scope_bin.validate(captures.scope_files(spark, sf, faulty=True))


@query("bin_chunks", f"""
WITH {_PARTS} SELECT {_path('bin')} AS path, 'CH1(V)' AS channel, k AS i, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM parts""")
def bin_chunks(spark, sf):
    chunks = scope_bin.decode(captures.scope_files(spark, sf), chunk=16)
    return files.samples_long(chunks).select("path", "channel", "i", "value")


@query("bin_centred", f"""
WITH {_PARTS} SELECT {_path('bin')} AS path, k AS i,
  round(CAST(CAST(value AS FLOAT) AS DOUBLE) - avg(CAST(CAST(value AS FLOAT) AS DOUBLE)) OVER (PARTITION BY recording_id, part), 6) + 0.0 AS value
FROM parts""")
def bin_centred(spark, sf):
    """Decoded chunks with the mean of the whole capture removed."""
    chunks = files.centred_chunks(scope_bin.decode(captures.scope_files(spark, sf), chunk=16))
    return files.samples_long(chunks).select("path", "i", rounded("value").alias("value"))


@query("bin_time", f"""
WITH {_PARTS} SELECT {_path('bin')} AS path, 'CH1(V)' AS channel, k AS i, -1.5 + k * 0.125::DOUBLE AS t,
  CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM parts""")
def bin_time(spark, sf):
    """Samples on the capture's own time axis."""
    made = captures.scope_files(spark, sf, origin=-1.5)
    long = files.samples_long(scope_bin.decode(made, chunk=64))
    return scope_bin.with_time(long, scope_bin.headers(made)).select("path", "channel", "i", "t", "value")


@query("wav_rails", f"""
WITH {_PARTS}, x AS (SELECT recording_id, part, 'ch0' AS channel, floor(value) AS v FROM parts
  UNION ALL SELECT recording_id, part, 'ch1', -floor(value) FROM parts)
SELECT {_path('wav')} AS path, count(*) AS n, count(*) FILTER (WHERE v / 32768 <= -1 OR v / 32768 >= 1 - pow(2, -15)) AS clip_count,
  count(*) FILTER (WHERE v / 32768 <= -1 OR v / 32768 >= 1 - pow(2, -15)) > 0 AS clipped FROM x GROUP BY recording_id, part""")
def wav_rails(spark, sf):
    """Clipping of audio files at the rails that their bit depth gives."""
    made = captures.wav_files(spark, sf)
    long = files.samples_long(wav.decode(made, chunk=64)).join(wav.info(made).select("path", "bit_depth"), "path")
    low, high = wav.rails(F.col("bit_depth"))
    return timefeat.clipping(long, ["path"], low, high).select("path", "n", "clip_count", "clipped")


@query("sniffed_readers", f"""
WITH {_PARTS}, f AS (SELECT DISTINCT recording_id, part FROM parts)
SELECT {_path('raw')} AS path, CASE WHEN recording_id % 2 = 0 THEN 'wav' WHEN recording_id % 5 <> 2 THEN 'scope_bin' END AS reader FROM f""")
def sniffed_readers(spark, sf):
    """Files whose names say nothing, told by their first bytes; broken ones by none."""
    number = F.substring("path", 4, 6).cast("int")
    root = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/raw-{uuid.uuid4().hex}"
    made = captures.wav_files(spark, sf).where(number % 2 == 0).unionByName(
        captures.scope_files(spark, sf, faulty=True).where(number % 2 == 1))
    files.write_contents(made.select(F.regexp_replace("path", r"[a-z]+$", "raw").alias("path"), F.col("content").cast("binary").alias("content")), root)
    found = dispatch.sniffed(files.listing(spark, root), "reader")
    return found.select(F.substring_index("path", "/", -2).alias("path"), "reader")


@query("wav_info", f"""
WITH {_PARTS}, f AS (SELECT DISTINCT recording_id, part, points FROM parts)
SELECT {_path('wav')} AS path, 8.0::DOUBLE AS sample_rate_hz, 2 AS channels, 16 AS bit_depth, points AS frames,
  round(points / 8.0, 4) + 0.0 AS duration_s FROM f""")
def wav_info(spark, sf):
    return wav.info(captures.wav_files(spark, sf)).drop("error")


@query("wav_chunks", f"""
WITH {_PARTS}, c AS (SELECT 'ch0' AS channel, 1 AS sign UNION ALL SELECT 'ch1', -1)
SELECT {_path('wav')} AS path, channel, k AS i, round(sign * floor(value) / 32768, 9) + 0.0 AS value
FROM parts, c WHERE k >= 8""")
def wav_chunks(spark, sf):
    chunks = wav.decode(captures.wav_files(spark, sf), offset_s=1.0, chunk=16)
    return files.samples_long(chunks).select("path", "channel", "i", rounded("value", 9).alias("value"))


@query("scope_csv", f"""
WITH {_PARTS}
SELECT {_path('csv')} AS path, 'CH1(V)' AS channel, k AS i,
  round(CASE WHEN recording_id % 2 = 0 THEN -2 + k * 0.5 ELSE k * 0.25 END, 6) + 0.0 AS t, value FROM parts""")
def scope_csv_samples(spark, sf):
    out = scope_csv.samples(captures.csv_files(spark, sf))
    return out.withColumn("t", rounded("t"))


@query("scope_csv_time_base", f"""
WITH {_PARTS}
SELECT {_path('csv')} AS path, 'CH1(V)' AS channel, count(*) AS n,
  round((count(*) - 1) * CASE WHEN recording_id % 2 = 0 THEN 0.5 ELSE 0.25 END, 6) + 0.0 AS duration_s,
  CASE WHEN count(*) > 1 THEN CASE WHEN recording_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25 END END AS interval_s
FROM parts GROUP BY recording_id, part""")
def scope_csv_time_base(spark, sf):
    out = scope_csv.time_base(scope_csv.samples(captures.csv_files(spark, sf)))
    return out.withColumn("duration_s", rounded("duration_s"))


@query("wfm_chunks", f"""
WITH {_PARTS}, c AS (SELECT recording_id, part, k, points, CAST(least(floor(value), 255) AS DOUBLE) AS code FROM parts)
SELECT {_path('wfm')} AS path, count(*) AS n, count(*) FILTER (WHERE code = 0) AS clip_low,
  count(*) FILTER (WHERE code = 255) AS clip_high, round(max(code * 0.02) - min(code * 0.02), 6) + 0.0 AS vpp
FROM c GROUP BY recording_id, part""")
def wfm_chunks(spark, sf):
    codes = deep_memory.codes_long(deep_memory.decode(captures.deep_memory_files(spark, sf), chunk=16))
    return codes.groupBy("path").agg(
        F.max("n").alias("n"), F.count_if(F.col("value") == 0).alias("clip_low"),
        F.count_if(F.col("value") == 255).alias("clip_high"),
        rounded(F.max("volts") - F.min("volts")).alias("vpp"))


_STORED = _PARTS + f""", v AS (
  SELECT {_path('bin')} AS path, 'CH1(V)' AS channel, recording_id % 5 = 2 AS bad, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x
  FROM parts WHERE recording_id % 5 <> 1 OR k < points - 3
  UNION ALL SELECT {_path('wav')}, c.channel, recording_id % 5 IN (2, 3), c.sign * floor(value) / 32768
  FROM parts, (SELECT 'ch0' AS channel, 1 AS sign UNION ALL SELECT 'ch1', -1) c
  UNION ALL SELECT {_path('wfm')}, 'CH1(V)', recording_id % 5 IN (2, 3), CAST(CAST(least(floor(value), 255) * 0.02 AS FLOAT) AS DOUBLE)
  FROM parts
  UNION ALL SELECT {_path('csv')}, 'CH1(V)', recording_id % 5 IN (2, 3), CAST(CAST(value AS FLOAT) AS DOUBLE) FROM parts)"""


def _written_captures(spark, sf) -> str:
    """Folder with captures of all four formats, some cut, short, empty or broken."""
    kinds = [captures.scope_files(spark, sf, faulty=True), captures.wav_files(spark, sf),
             captures.deep_memory_files(spark, sf), captures.csv_files(spark, sf)]
    root = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/captures-{uuid.uuid4().hex}"
    fault = F.substring("path", 4, 6).cast("int") % 5
    for k, kind in enumerate(kinds):
        content = F.col("content").cast("binary")
        if k:
            content = F.when(fault == 2, F.substring(content, 1, 10)).when(
                fault == 3, F.substring(content, 1, 0)).otherwise(content)
        files.write_contents(kind.select("path", content.alias("content")), root)
    return root


@query("stored_captures", f"""
WITH {_STORED}
SELECT path, CASE WHEN bad THEN NULL ELSE channel END AS channel, CASE WHEN bad THEN 0 ELSE count(*) END AS n_samples,
  CASE WHEN bad THEN NULL ELSE round(sum(x), 3) + 0.0 END AS total, bad AS failed
FROM v GROUP BY path, CASE WHEN bad THEN NULL ELSE channel END, bad""")
def stored_captures(spark, sf):
    """Captures of all four formats, some cut, short, empty or broken, written, listed and read back.

    Every listed file shows: with its samples per channel, or as failed.
    """
    root = _written_captures(spark, sf)
    chunks = tables.staged(dispatch.read_waveforms(files.listing(spark, root), chunk=1024), "stored")
    path = F.substring_index("path", "/", -2).alias("path")
    good = chunks.where("samples IS NOT NULL").select(
        path, "channel", F.size("samples").alias("_n"),
        F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("_t"))
    read = good.groupBy("path", "channel").agg(F.sum("_n").alias("n_samples"), rounded(F.sum("_t"), 3).alias("total"))
    lost = chunks.where("samples IS NULL").select(path, F.lit(None).cast("string").alias("channel"),
                                                 F.lit(0).cast("bigint").alias("n_samples"),
                                                 F.lit(None).cast("double").alias("total"))
    return read.withColumn("failed", F.lit(False)).unionByName(lost.withColumn("failed", F.lit(True)))


@query("capture_source", ORACLES["stored_captures"])
def capture_source(spark, sf):
    """The same files through the data source, in SQL alone."""
    capture.register(spark)
    view = f"captures_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TEMPORARY VIEW {view} USING capture OPTIONS (path '{_written_captures(spark, sf)}', chunk '1024')")
    return spark.sql(f"""
SELECT substring_index(path, '/', -2) AS path, channel, CAST(coalesce(sum(size(samples)), 0) AS BIGINT) AS n_samples,
  round(sum(aggregate(samples, 0D, (a, x) -> a + x)), 3) + 0D AS total, samples IS NULL AS failed
FROM {view} GROUP BY path, channel, samples IS NULL""")


@query("capture_span", f"""
WITH {_STORED}, w AS (
  SELECT {_path('wav')} AS path, k, -floor(value) / 32768 AS x FROM parts WHERE recording_id % 5 NOT IN (2, 3))
SELECT path, min(k) AS first_sample, count(*) AS n_samples, round(sum(x), 6) + 0.0 AS total
FROM w WHERE k >= 16 AND k < 40 GROUP BY path""")
def capture_span(spark, sf):
    """Seconds 2 to 5 of one channel of the audio files: path, channel and span reach the reader."""
    capture.register(spark)
    df = spark.read.format("capture").options(offset_s=2, duration_s=3, chunk=5).load(_written_captures(spark, sf))
    kept = df.where("path LIKE '%.wav' AND channel = 'ch1' AND samples IS NOT NULL")
    return kept.groupBy(F.substring_index("path", "/", -2).alias("path")).agg(
        F.min("start_sample").alias("first_sample"), F.sum(F.size("samples")).alias("n_samples"),
        rounded(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")))).alias("total"))


@query("lateral_features", f"""
WITH {S.WIN}, placed AS (
  SELECT vec_id, j, x, unnest(range(CASE WHEN j < 16 THEN 0 ELSE (j - 16) // 8 + 1 END, j // 8 + 1)) AS segment_index FROM win),
ac AS (SELECT vec_id, segment_index, x, x - avg(x) OVER (PARTITION BY vec_id, segment_index) AS d
  FROM placed WHERE segment_index * 8 + 16 <= 64),
f AS (SELECT vec_id, segment_index, avg(x) AS mean, avg(d * d) AS m2, avg(d * d * d * d) AS m4, max(d) AS hi, min(d) AS lo
  FROM ac GROUP BY ALL),
v AS (SELECT vec_id, segment_index, CASE WHEN sqrt(m2) > 0.12 THEN 1.0 ELSE 0.0 END AS vote FROM f),
m AS (SELECT vec_id, vote, count(*) AS n FROM v GROUP BY ALL),
best AS (SELECT vec_id, vote FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, vote) = 1)
SELECT f.vec_id, segment_index, segment_index * 8 AS start_sample, round(mean, 6) + 0.0 AS mean, round(sqrt(m2), 6) + 0.0 AS rms,
  round(hi - lo, 6) + 0.0 AS peak_to_peak, round(greatest(hi, -lo) / sqrt(m2), 6) + 0.0 AS crest,
  round(m4 / (m2 * m2), 6) + 0.0 AS kurtosis, CAST(vote AS DOUBLE) AS loud
FROM f JOIN best ON best.vec_id = f.vec_id""")
def lateral_features(spark, sf):
    """Windows of an array, features of a window and a vote over them, in SQL alone."""
    register(spark)
    view = f"windows_{uuid.uuid4().hex}"
    S.table(spark, sf, "embeddings").createOrReplaceTempView(view)
    return spark.sql(f"""
WITH found AS (
  SELECT vec_id, segment_index, start_sample, f.* FROM {view},
    LATERAL windows_of(CAST(embedding AS ARRAY<DOUBLE>), 16, 8) w, LATERAL window_features(w.segment) f),
loud AS (SELECT vec_id, majority(collect_list(CASE WHEN rms > 0.12 THEN 1D ELSE 0D END)) AS loud FROM found GROUP BY vec_id)
SELECT found.vec_id, segment_index, start_sample, round(mean, 6) + 0D AS mean, round(rms, 6) + 0D AS rms,
  round(peak_to_peak, 6) + 0D AS peak_to_peak, round(crest, 6) + 0D AS crest, round(kurtosis, 6) + 0D AS kurtosis, loud
FROM found JOIN loud ON loud.vec_id = found.vec_id""")


@query("decode_failures", f"""
WITH {_PARTS}, f AS (SELECT DISTINCT recording_id, part FROM parts)
SELECT {_path('bin')} AS path, 'not a scope capture' AS error FROM f WHERE recording_id % 5 = 2""")
def decode_failures(spark, sf):
    decoded = scope_bin.decode(captures.scope_files(spark, sf, faulty=True))
    _, failed = quality.split_failures(decoded)
    return failed


_SINK_COLS = "recording_id, condition, speed_percent, sensor, path, duration_s"


@query("sink_roundtrip", f"""
WITH {S.META}, f AS (SELECT unnest(['csv', 'json', 'parquet']) AS format) SELECT format, {_SINK_COLS} FROM meta, f""")
def sink_roundtrip(spark, sf):
    """The recordings table written and read back in three formats."""
    rows = S.recordings(spark, sf)
    root = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/sink-{uuid.uuid4().hex}"
    out = None
    for fmt in ("csv", "json", "parquet"):
        tables.write_tables({"recordings": rows}, f"{root}/{fmt}", fmt)
        back = tables.read_table(spark, f"{root}/{fmt}", "recordings", rows, fmt).withColumn(
            "format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("feature_cache", spectral_queries._FLAGSHIP_SQL + """
SELECT label, count(*) AS n_windows, round(avg("RMS"), 6) + 0.0 AS "RMS", round(avg(band_2_5), 6) + 0.0 AS band_2_5
FROM feat GROUP BY label""")
def feature_cache(spark, sf):
    """Window features written once and aggregated from the written table."""
    kept = tables.staged(spectral_queries.short_window_table(spark, sf).drop("samples"), "features")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n_windows"),
                                     rounded(F.avg("RMS")).alias("RMS"),
                                     rounded(F.avg("band_2_5")).alias("band_2_5"))


@query("incremental_cache", """
SELECT doc_id, CAST(length(text) + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_chars,
  CASE WHEN doc_id % 50 = 0 OR doc_id % 97 = 1 THEN 2 ELSE 1 END AS built_by
FROM documents WHERE doc_id % 97 <> 0""")
def incremental_cache(spark, sf):
    """A table of documents built, then followed through changed, new and removed ones.

    `built_by` tells which run made a row: the second one makes those of changed and new documents.
    """
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    root = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/follow-{uuid.uuid4().hex}"
    first = docs.where("doc_id % 97 <> 1")
    second = docs.where("doc_id % 97 <> 0").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    out = None
    for run, state in enumerate((first, second), 1):
        inputs = state.select("doc_id", F.octet_length("text").alias("length"), F.sha2("text", 256).alias("digest"))

        def build(keys, state=state, run=run):
            return state.join(keys, "doc_id").select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.lit(run).alias("built_by"))

        out = tables.incremental_table(spark, root, inputs, build, key="doc_id", buckets=16)
    return out
