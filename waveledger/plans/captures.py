"""Events written as capture contents, so that readers have the driver tables to read.

Each recording is cut into parts of bounded length; one part is one capture.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from waveledger import fixed_values as fv
from waveledger.plans import standins as S

PART = 4096
STEP_S = 0.125


def scope_bytes(samples, step: float = STEP_S, fault: int = 0, waveforms: int = 1, origin: float = 0.0) -> bytes:
    """A scope capture with float payload; fault 1 cuts it, 2 breaks the magic, 3 the size."""
    payload = np.asarray(samples, dtype="<f4").tobytes()
    body = b""
    for w in range(waveforms):
        head = bytearray(fv.SCOPE_MIN_WAVEFORM_HEADER)
        struct.pack_into("<5i", head, 0, len(head), 1, 1, len(samples), 0)
        struct.pack_into("<2d", head, 32, step, origin)
        struct.pack_into("<2i", head, 48, 2, 1)
        head[56:66], head[72:80] = b"2024-01-01", b"12:00:00"
        label = f"CH{w + 1}".encode()
        head[112:112 + len(label)] = label
        body += bytes(head) + struct.pack("<ihhi", 12, 1, 4, len(payload)) + payload
    size = fv.SCOPE_FILE_HEADER + len(body) + (7 if fault == 3 else 0)
    out = (b"XX01" if fault == 2 else b"RG01") + struct.pack("<2i", size, waveforms) + body
    if fault == 1:
        out = out[:-10]
    return out + (b"tail" if fault == 4 else b"")


def wav_bytes(channels, rate: int = 8, width: int = 2, cut: int = 0) -> bytes:
    """16-bit PCM of integer codes, one array per channel; `cut` drops payload bytes."""
    x = np.stack([np.asarray(c) for c in channels], axis=1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x.astype(f"<i{width}").tobytes())
    data = out.getvalue()
    return data[:-cut] if cut else data


def deep_memory_bytes(codes, lsb: float = 0.02) -> bytes:
    head = bytearray(fv.DEEP_MEMORY_HEADER)
    for o in fv.DEEP_MEMORY_STEP_OFFSETS:
        struct.pack_into("<d", head, o, lsb)
    return bytes(head) + np.asarray(codes, dtype="u1").tobytes()


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """recording_id, part, first sample, and the part's samples in order."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "value")))
    return (S.samples(spark, sf).withColumn("part", F.floor(F.col("i") / F.lit(PART)))
            .groupBy("recording_id", "part").agg(pairs.alias("_p"))
            .select("recording_id", "part", F.transform("_p", lambda p: p["value"]).alias("samples")))


def _path(extension: str):
    return F.format_string(f"rec%06d/part%04d.{extension}", "recording_id", "part")


def scope_files(spark: SparkSession, sf: str, faulty: bool = False, origin: float = 0.0) -> DataFrame:
    """(path, content); with `faulty`, recordings 1-4 modulo 5 carry faults 1-4. `origin` is the time of the first sample."""
    @pandas_udf(T.BinaryType())
    def encode(samples: pd.Series, fault: pd.Series) -> pd.Series:
        return pd.Series([scope_bytes(s, fault=int(f), origin=origin) for s, f in zip(samples, fault)])

    fault = (F.col("recording_id") % 5).cast("int") if faulty else F.lit(0)
    return parts(spark, sf).select(_path("bin").alias("path"), encode("samples", fault).alias("content"))


def wav_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stereo: rounded values and their negatives."""
    @pandas_udf(T.BinaryType())
    def encode(samples: pd.Series) -> pd.Series:
        codes = [np.floor(np.asarray(s)).astype(np.int64) for s in samples]
        return pd.Series([wav_bytes([c, -c]) for c in codes])

    return parts(spark, sf).select(_path("wav").alias("path"), encode("samples").alias("content"))


def deep_memory_files(spark: SparkSession, sf: str) -> DataFrame:
    @pandas_udf(T.BinaryType())
    def encode(samples: pd.Series) -> pd.Series:
        return pd.Series([deep_memory_bytes(np.minimum(np.floor(np.asarray(s)), 255))
                          for s in samples])

    return parts(spark, sf).select(_path("wfm").alias("path"), encode("samples").alias("content"))


def csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Even recordings in the memory layout, odd ones with a time column."""
    memory = F.concat(F.lit("CH1(V),t0 = -2s, tInc = 500ms,\n"), F.array_join(
        F.transform("samples", lambda x: F.concat(x.cast("string"), F.lit(","))), "\n"))
    screen = F.concat(F.lit("Time(s),CH1(V)\r\n"), F.array_join(
        F.transform("samples", lambda x, k: F.concat(
            (k * 0.25).cast("string"), F.lit(", "), x.cast("string"))), "\r\n"))
    content = F.when(F.col("recording_id") % 2 == 0, memory).otherwise(screen)
    return parts(spark, sf).select(_path("csv").alias("path"), content.alias("content"))
