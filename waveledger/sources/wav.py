"""PCM WAV recordings: header facts, validation and samples."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waveledger.sources.files import frames, open_input, spread, spread_files
from waveledger.sources.tables import staged

INFO_SCHEMA = ("path string, sample_rate_hz double, channels int, bit_depth int, frames bigint, "
               "duration_s double, error string")
CHUNK_SCHEMA = ("path string, channel string, start_sample bigint, fs double, "
                "samples array<float>, error string")

_COLUMNS = ["path", "channel", "start_sample", "fs", "samples", "error"]


def _pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """(frames, channels) scaled to [-1, 1)."""
    usable = len(raw) // (width * channels) * width * channels
    raw = raw[:usable]
    if width == 1:
        x = (np.frombuffer(raw, "u1").astype(np.float64) - 128.0) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels)


def _info(path: str, handle) -> tuple:
    try:
        with wave.open(handle, "rb") as w:
            rate, frames = w.getframerate(), w.getnframes()
            return (path, float(rate), w.getnchannels(), w.getsampwidth() * 8, frames,
                    round(frames / rate, 4), None)
    except (wave.Error, EOFError, OSError) as exc:
        return (path, None, None, None, None, None, f"not a PCM WAV: {exc}")


def info(files: DataFrame) -> DataFrame:
    """Header facts of (path, content) recordings."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame([_info(p, io.BytesIO(c))
                                for p, c in zip(batch["path"], batch["content"])],
                               columns=[f.split()[0] for f in INFO_SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, INFO_SCHEMA)


def probe(listing: DataFrame) -> DataFrame:
    """Header facts of files on storage."""
    def run(batches):
        for batch in batches:
            rows = []
            for p in batch["path"]:
                try:
                    with open_input(p) as f:
                        rows.append(_info(p, f))
                except OSError as exc:
                    rows.append((p, None, None, None, None, None, f"cannot open: {exc}"))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in INFO_SCHEMA.split(", ")])

    return spread_files(listing).mapInPandas(run, INFO_SCHEMA)


def _channel_chunks(path, handle, start: int, frames: int, chunk: int, mode: str):
    with wave.open(handle, "rb") as w:
        rate, total = float(w.getframerate()), w.getnframes()
        w.setpos(min(start, total))
        left = min(frames, max(0, total - start))
        at = start
        while left > 0:
            want = min(chunk, left)
            x = _pcm(w.readframes(want), w.getsampwidth(), w.getnchannels())
            if mode == "mono":
                x = x.mean(axis=1, keepdims=True)
            elif mode == "first":
                x = x[:, :1]
            for c in range(x.shape[1]):
                name = "mono" if mode == "mono" else f"ch{c}"
                if len(x):
                    yield (path, name, at, rate, x[:, c].astype(np.float32), None)
            if len(x) < want:
                yield (path, None, at + len(x), rate, None, f"payload ends at frame {at + len(x)} of {total}")
                return
            at, left = at + want, left - want


def decode(files: DataFrame, mode: str = "all", offset_s: float = 0.0,
           duration_s: float | None = None, chunk: int = 65_536) -> DataFrame:
    """Samples of (path, content) recordings; `mode` is all, first or mono."""
    def rows(batches):
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                facts = _info(p, io.BytesIO(c))
                if facts[-1]:
                    yield (p, None, None, None, None, facts[-1])
                else:
                    start = int(max(0.0, offset_s) * facts[1])
                    count = facts[4] if duration_s is None else round(duration_s * facts[1])
                    yield from _channel_chunks(p, io.BytesIO(c), start, count, chunk, mode)

    def run(batches):
        return frames(rows(batches), _COLUMNS, 4)

    return files.select("path", "content").mapInPandas(run, CHUNK_SCHEMA)


def read_chunks(listing: DataFrame, mode: str = "all", offset_s: float = 0.0,
                duration_s: float | None = None, chunk: int = 65_536,
                partitions: int | None = None) -> DataFrame:
    """Samples of files on storage; each range of a file is its own row of work.

    A recording without frames in the span gives an error row; one that is cut off gives the
    frames it has and an error row.
    """
    heads = staged(probe(listing), "wav-heads")
    rate = F.col("sample_rate_hz")
    first = F.floor(F.lit(max(0.0, float(offset_s))) * rate)
    stop = F.col("frames")
    if duration_s is not None:
        stop = F.least(stop, first + F.bround(F.lit(float(duration_s)) * rate))
    spans = heads.where("error IS NULL").select(
        "path", first.cast("bigint").alias("_a"), stop.cast("bigint").alias("_b"),
        (F.col("channels") * F.col("bit_depth") / 8).alias("_frame_bytes"))
    ranges = (spans.where("_b > _a")
              .withColumn("_start", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1, F.lit(chunk))))
              .select("path", "_start", F.least(F.lit(chunk), F.col("_b") - F.col("_start")).alias("_n"),
                      "_frame_bytes"))

    def rows(batches):
        for batch in batches:
            for path, start, n, _ in batch.itertuples(index=False):
                try:
                    with open_input(path) as f:
                        yield from _channel_chunks(path, f, int(start), int(n), chunk, mode)
                except (OSError, wave.Error, EOFError) as exc:
                    yield (path, None, None, None, None, f"cannot read: {exc}")

    def run(batches):
        return frames(rows(batches), _COLUMNS, 4)

    errors = heads.where("error IS NOT NULL").select("path", "error").unionByName(
        spans.where("NOT _b > _a").select("path", F.lit("no samples in range").alias("error")))
    dealt = spread(ranges, F.col("_n") * F.col("_frame_bytes"), "path", "_start", partitions=partitions)
    return dealt.mapInPandas(run, CHUNK_SCHEMA).unionByName(errors, allowMissingColumns=True)


def rails(bit_depth):
    """(low, high) full-scale values of a PCM depth column."""
    return F.lit(-1.0), F.lit(1.0) - F.pow(F.lit(2.0), F.lit(1) - bit_depth)
