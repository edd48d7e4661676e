"""Window statistics over an event-time stream of samples.

The batch windows count samples; on a live stream the same statistics are taken over
time windows, with a watermark that bounds how long late samples are waited for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rolling_rms(samples: DataFrame, window: str, hop: str, watermark: str,
                keys: tuple[str, ...] = ("recording_id",), ts: str = "ts",
                value: str = "value") -> DataFrame:
    """RMS, mean and count per key and (sliding) time window; works on streams and tables."""
    v = F.col(value)
    timed = samples.withWatermark(ts, watermark) if samples.isStreaming else samples
    out = timed.groupBy(*keys, F.window(ts, window, hop)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"))
    return out.select(*keys, F.col("window.start").alias("start"),
                      F.col("window.end").alias("end"), "n", "mean", "rms")
