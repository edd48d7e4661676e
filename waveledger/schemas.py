"""Schemas of the base tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per recording file; blanks in the CSV are nulls.
METADATA = T.StructType([
    T.StructField("condition", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("reversal", T.StringType()),
    T.StructField("speed_percent", T.IntegerType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("sample_rate_hz", T.DoubleType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("bit_depth", T.IntegerType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("new_path", T.StringType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("original_path", T.StringType()),
])

# Decoded waveform, a bounded slice per row.
SIGNAL_CHUNKS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("start_sample", T.LongType()),
    T.StructField("fs", T.DoubleType()),
    T.StructField("samples", T.ArrayType(T.FloatType(), False)),
])

READINGS = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("read_no", T.IntegerType()),
])
