"""Deep-memory captures: a fixed header followed by 8-bit codes."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import ordered
from waveledger.sources.files import frames, open_input, spread

CHUNK_SCHEMA = ("path string, channel string, start_sample bigint, fs double, lsb double, "
                "codes array<smallint>, error string")
_COLUMNS = ["path", "channel", "start_sample", "fs", "lsb", "codes", "error"]


def _lsb(head: bytes) -> float:
    """Volts per code: median of the plausible header slots, 1 if there are none."""
    slots = [struct.unpack_from("<d", head, o)[0] for o in fv.DEEP_MEMORY_STEP_OFFSETS
             if o + 8 <= len(head)]
    good = [v for v in slots if 1e-9 < abs(v) < 1.0]
    return float(np.median(good)) if good else 1.0


def decode(files: DataFrame, rate_hz: float = fv.DEEP_MEMORY_RATE_HZ,
           chunk: int = 65_536) -> DataFrame:
    """Codes of (path, content) captures in chunks; the rate is an assumption."""
    def rows(batches):
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                if len(c) <= fv.DEEP_MEMORY_HEADER:
                    yield (p, None, None, None, None, None, "no payload")
                    continue
                lsb = _lsb(c[:fv.DEEP_MEMORY_HEADER])
                codes = np.frombuffer(c, "u1", offset=fv.DEEP_MEMORY_HEADER)
                for s in range(0, len(codes), chunk):
                    yield (p, "CH1(V)", s, rate_hz, lsb, codes[s:s + chunk].astype(np.int16), None)

    def run(batches):
        return frames(rows(batches), _COLUMNS, 5)

    return files.select("path", "content").mapInPandas(run, CHUNK_SCHEMA)


def read_chunks(listing: DataFrame, rate_hz: float = fv.DEEP_MEMORY_RATE_HZ, chunk: int = 65_536,
                offset_s: float = 0.0, duration_s: float | None = None,
                partitions: int | None = None) -> DataFrame:
    """Codes of files on storage for [offset, offset + duration) seconds at the assumed rate.

    Ranges follow from the file length and are read apart. A file without payload, or without
    codes in the span, gives an error row.
    """
    size = F.col("length") - fv.DEEP_MEMORY_HEADER
    first = math.floor(max(0.0, offset_s) * rate_hz)
    stop = size if duration_s is None else F.least(size, F.lit(first + round(duration_s * rate_hz)))
    spans = listing.select("path", size.alias("_n"), F.lit(first).cast("bigint").alias("_a"),
                           stop.cast("bigint").alias("_b"))
    ranges = (spans.where("_n > 0 AND _b > _a")
              .withColumn("_start", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1,
                                                         F.lit(chunk).cast("bigint"))))
              .select("path", "_start", F.least(F.lit(chunk), F.col("_b") - F.col("_start")).alias("_len")))
    empty = spans.where("NOT (_n > 0 AND _b > _a) OR _n IS NULL").select("path", F.when(
        F.col("_n") > 0, "no samples in range").otherwise("no payload").alias("error"))

    def rows(batches):
        for batch in batches:
            for path, start, n in batch.itertuples(index=False):
                try:
                    with open_input(path) as f:
                        lsb = _lsb(f.read(fv.DEEP_MEMORY_HEADER))
                        f.seek(int(fv.DEEP_MEMORY_HEADER + start))
                        codes = np.frombuffer(f.read(int(n)), "u1").astype(np.int16)
                    yield (path, "CH1(V)", start, rate_hz, lsb, codes, None)
                except OSError as exc:
                    yield (path, None, None, None, None, None, f"cannot read: {exc}")

    def run(batches):
        return frames(rows(batches), _COLUMNS, 5)

    read = spread(ranges, F.col("_len"), "path", "_start", partitions=partitions).mapInPandas(run, CHUNK_SCHEMA)
    return read.unionByName(empty, allowMissingColumns=True)


def codes_long(chunks: DataFrame) -> DataFrame:
    """One row per code: path, channel, i, n (codes in the file), value, volts."""
    good = chunks.where(F.col("codes").isNotNull())
    sizes = good.groupBy("path").agg(F.sum(F.size("codes")).cast("bigint").alias("n"))
    return (ordered.attach(good, sizes, ["path"], ["start_sample"])
            .select("path", "channel", "start_sample", "lsb", "n",
                    F.posexplode("codes").alias("_k", "_v"))
            .select("path", "channel", (F.col("start_sample") + F.col("_k")).alias("i"), "n",
                    F.col("_v").cast("double").alias("value"),
                    (F.col("_v") * F.col("lsb")).alias("volts")))
