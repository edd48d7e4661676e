"""Streams over the events, written and read back: what arrives in the end equals the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from waveledger.functions import ordered
from waveledger.functions.scalars import rounded
from waveledger.plans import standins as S
from waveledger.plans.registry import query
from waveledger.sources import tables
from waveledger.streaming import quiet, rolling

#: A key and times behind all others, which let the watermark pass the last sample.
_END = -1


def _arriving(spark: SparkSession, rows: DataFrame, days: int = 8) -> DataFrame:
    """The rows (recording_id, ts, ...) as a stream that arrives file by file, `days` after `days`, and then the end.

    The files of one span arrive in any order, so samples are late by up to `days`.
    """
    root = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/stream-{uuid.uuid4().hex}"
    # clock times as instants of UTC, so that no time zone of the session moves them
    rows = rows.withColumn("ts", F.timestamp_micros(ordered.epoch_micros("ts")))
    rows = tables.staged(rows, "arriving")
    span = F.floor(F.unix_seconds("ts") / F.lit(days * 86_400))
    first, end = rows.agg(F.min(span), F.max(span)).first()
    for part in range(first, end + 1):
        rows.where(span == part).repartition(2).write.mode("append").parquet(root)
    last = rows.agg(F.max("ts").alias("ts"))
    for ahead in (100, 200):
        ended = last.select(*[F.lit(_END).cast(f.dataType).alias(f.name) if f.name == "recording_id" else
                              (F.col("ts") + F.make_interval(days=F.lit(ahead))).alias("ts") if f.name == "ts" else
                              F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        ended.write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)


def _result(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and read what it has written."""
    spark = stream.sparkSession
    root = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/sink-{uuid.uuid4().hex}"
    run = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows")
           .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows").where(F.col("recording_id") != _END)


@query("stream_quiet_runs", f"""
WITH {S.GATED}, z AS (
  SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS g FROM gated WHERE value = 0)
SELECT recording_id, min(i) AS start, max(i) + 1 AS "end" FROM z GROUP BY recording_id, g HAVING count(*) >= 2""")
def stream_quiet_runs(spark, sf):
    """Runs of two or more zero samples, found while the samples arrive."""
    rows = S.gated_samples(spark, sf).select("recording_id", "ts", "i", "value")
    return _result(quiet.quiet_runs(_arriving(spark, rows), ["recording_id"], 0.0, "10 days", 60 * 86_400, least=2))


@query("stream_rolling_rms", """
WITH d AS (SELECT user_id AS recording_id, value, epoch_us(ts) // 86400000000 AS day FROM events),
w AS (SELECT recording_id, value, unnest([day - 1, day]) AS day FROM d)
SELECT recording_id, make_timestamp(day * 86400000000) AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean,
  round(sqrt(avg(value * value)), 6) + 0.0 AS rms FROM w GROUP BY recording_id, day""")
def stream_rolling_rms(spark, sf):
    """RMS of two-day windows every day."""
    rows = S.raw_samples(spark, sf).select("recording_id", "ts", "value")
    found = rolling.rolling_rms(_arriving(spark, rows), "2 days", "1 day", "10 days")
    out = _result(found)
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_micros(start) / 1000000)")
    return out.select("recording_id", start.alias("start"), "n", rounded("mean").alias("mean"), rounded("rms").alias("rms"))
