"""Binary scope captures: headers, validation and samples.

A capture is `file header, then per waveform: header, then per buffer: header + payload`.
Two ways in:

* `read_chunks` starts from a listing (path, length).  Headers are probed with small
  reads, the payload is cut into ranges, and each range is one row of work, so a large
  capture is read by many tasks and only where needed.
* `headers` / `validate` / `decode` take contents already in a column.

Broken files become rows with an `error`; they never stop a job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.sources.files import frames, open_input, spread, spread_files
from waveledger.sources.tables import staged

HEADER_SCHEMA = (
    "path string, waveform int, buffer int, channel string, unit string, rate_hz double, "
    "points bigint, width int, payload_offset bigint, available_points bigint, "
    "declared_s double, available_s double, captured string, declared_size bigint, "
    "file_size bigint, error string, origin_s double")
CHUNK_SCHEMA = ("path string, channel string, start_sample bigint, fs double, "
                "samples array<float>, error string")
_CHUNK_COLUMNS = ["path", "channel", "start_sample", "fs", "samples", "error"]

Read = Callable[[int, int], bytes]


def _text(raw: bytes) -> str:
    return raw.split(b"\x00", 1)[0].decode("latin-1").strip()


def _buffers(read: Read, size: int) -> Iterator[dict]:
    """One dict per buffer; raises ValueError where the structure cannot be followed."""
    head = read(0, fv.SCOPE_FILE_HEADER)
    if len(head) < fv.SCOPE_FILE_HEADER or head[:4] not in fv.SCOPE_MAGICS:
        raise ValueError("not a scope capture")
    declared, waveforms = struct.unpack("<ii", head[4:12])
    if waveforms < 1:
        raise ValueError("no waveform")
    at = fv.SCOPE_FILE_HEADER
    for w in range(waveforms):
        h = read(at, fv.SCOPE_MIN_WAVEFORM_HEADER)
        if len(h) < 60:
            raise ValueError("waveform header cut off")
        length, _, n_buffers, points = struct.unpack_from("<4i", h)
        step, origin = struct.unpack_from("<2d", h, 32)
        unit, = struct.unpack_from("<i", h, 52)
        if length < 60 or points < 1 or n_buffers < 1 or not step > 0:
            raise ValueError("invalid waveform header")
        label = _text(h[112:128]) or "CH1"
        stamp = " ".join(x for x in (_text(h[56:72]), _text(h[72:88])) if x)
        at += length
        for b in range(n_buffers):
            bh = read(at, fv.SCOPE_BUFFER_HEADER)
            if len(bh) < fv.SCOPE_BUFFER_HEADER:
                raise ValueError("buffer header cut off")
            b_length, _, width, n_bytes = struct.unpack("<ihhi", bh)
            if b_length < fv.SCOPE_BUFFER_HEADER or width not in fv.SCOPE_WIDTHS:
                raise ValueError("invalid buffer header")
            start = at + b_length
            have = max(0, min(n_bytes, size - start)) // width
            name = label if n_buffers == 1 else f"{label}_buf{b}"
            unit_name = fv.SCOPE_UNITS.get(unit, str(unit))
            yield {"waveform": w, "buffer": b, "unit": unit_name,
                   "channel": name if name.endswith(")") else f"{name}({unit_name})",
                   "rate_hz": 1.0 / step, "points": points, "width": width,
                   "payload_offset": start, "available_points": have,
                   "declared_s": points * step, "available_s": have * step, "captured": stamp, "origin_s": origin,
                   "declared_size": declared, "file_size": size, "_header": length,
                   "_bytes": n_bytes, "_end": start + n_bytes}
            at = start + n_bytes


def _header_rows(path: str, read: Read, size: int) -> list[dict]:
    rows: list[dict] = []
    try:
        seen = set()
        for b in _buffers(read, size):
            if b["channel"] in seen:
                raise ValueError(f"repeated channel {b['channel']}")
            seen.add(b["channel"])
            rows.append({"path": path, **b})
    except ValueError as exc:
        rows.append({"path": path, "file_size": size, "error": str(exc)})
    return rows


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows).reindex(columns=columns).astype(object)
    return out.where(out.notna(), None)


_HEADER_COLUMNS = [f.split()[0] for f in HEADER_SCHEMA.split(", ")]


def _from_bytes(content: bytes) -> Read:
    return lambda at, n: content[at:at + n]


def headers(files: DataFrame) -> DataFrame:
    """One row per buffer of (path, content) captures."""
    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"])
                    for r in _header_rows(p, _from_bytes(c), len(c))]
            yield _frame(rows, _HEADER_COLUMNS)

    return files.select("path", "content").mapInPandas(run, HEADER_SCHEMA)


def probe(listing: DataFrame) -> DataFrame:
    """Like `headers` for files on storage: reads headers only, a few hundred bytes each."""
    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for p in batch["path"]:
                try:
                    with open_input(p) as f:
                        size = f.size()

                        def read(at: int, n: int, f=f) -> bytes:
                            f.seek(at)
                            return f.read(n)

                        rows += _header_rows(p, read, size)
                except OSError as exc:
                    rows.append({"path": p, "error": f"cannot open: {exc}"})
            yield _frame(rows, _HEADER_COLUMNS)

    return spread_files(listing).mapInPandas(run, HEADER_SCHEMA)


def with_time(samples: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Add `t`, seconds on the capture's own axis, to samples (path, channel, i, fs, ...).

    The origin is the header's; the header rows of a file are few and are joined by path.
    """
    origins = header_rows.where("error IS NULL").select("path", "channel", "origin_s")
    return samples.join(origins, ["path", "channel"]).withColumn(
        "t", F.col("origin_s") + F.col("i") / F.col("fs")).drop("origin_s")


def durations(header_rows: DataFrame) -> DataFrame:
    """(path, probed_s): what the payload really holds, from the first buffer."""
    first = (F.col("waveform") == 0) & (F.col("buffer") == 0)
    return header_rows.where(first & F.col("error").isNull()).select(
        "path", F.col("available_s").alias("probed_s"))


def _problem(rows: list[dict], size: int) -> str | None:
    """The first broken structural rule, or None."""
    for r in rows:
        if r.get("error"):
            return r["error"]
        if r["_header"] < fv.SCOPE_MIN_WAVEFORM_HEADER:
            return "invalid waveform header"
        if r["_bytes"] != r["points"] * r["width"]:
            return "buffer size differs from points"
        if r["_end"] > size:
            return "payload cut off"
        if r["declared_size"] != size:
            return f"declared {r['declared_size']} bytes, actual {size}"
    if rows[-1]["_end"] != size:
        return "trailing bytes"
    return None


def validate(files: DataFrame) -> DataFrame:
    """(path, ok, error, points, available_points) for (path, content) captures.

    The last two are the samples that the headers promise and that are there, over all buffers;
    null where the headers cannot be followed.
    """
    columns = ["path", "ok", "error", "points", "available_points"]

    def run(batches):
        for batch in batches:
            out = []
            for p, c in zip(batch["path"], batch["content"]):
                rows = _header_rows(p, _from_bytes(c), len(c))
                problem = _problem(rows, len(c))
                known = not any(r.get("error") for r in rows)
                out.append((p, problem is None, problem, *(sum(r[k] for r in rows) if known else None for k in columns[3:])))
            yield pd.DataFrame(out, columns=columns).astype({k: "Int64" for k in columns[3:]})

    return files.select("path", "content").mapInPandas(
        run, "path string, ok boolean, error string, points bigint, available_points bigint")


def _samples(raw: bytes, width: int) -> np.ndarray:
    usable = len(raw) // width * width
    return np.frombuffer(raw[:usable], dtype=fv.SCOPE_WIDTHS[width]).astype(np.float32)


def decode(files: DataFrame, chunk: int = 65_536) -> DataFrame:
    """Samples of (path, content) captures in chunks; unreadable captures give an error row."""
    def rows(batches):
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                for h in _header_rows(p, _from_bytes(c), len(c)):
                    if h.get("error"):
                        yield (p, None, None, None, None, h["error"])
                        continue
                    for start in range(0, h["available_points"], chunk):
                        n = min(chunk, h["available_points"] - start)
                        at = h["payload_offset"] + start * h["width"]
                        yield (p, h["channel"], start, h["rate_hz"],
                               _samples(c[at:at + n * h["width"]], h["width"]), None)

    def run(batches):
        return frames(rows(batches), _CHUNK_COLUMNS, 4)

    return files.select("path", "content").mapInPandas(run, CHUNK_SCHEMA)


def read_chunks(listing: DataFrame, chunk: int = 65_536, offset_s: float = 0.0,
                duration_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Samples of files on storage for [offset, offset + duration) seconds.

    The ranges to read are rows, spread over the cluster by the bytes they stand for before
    anything is read. A buffer without samples in the span gives an error row.
    """
    heads = staged(probe(listing), "scope-heads")
    first = F.floor(F.lit(float(offset_s)) * F.col("rate_hz"))
    stop = F.col("available_points")
    if duration_s is not None:
        stop = F.least(stop, first + F.bround(F.lit(float(duration_s)) * F.col("rate_hz")))
    good = heads.where("error IS NULL").select("*", first.cast("bigint").alias("_a"),
                                              stop.cast("bigint").alias("_b"))
    ranges = (good.where("_b > _a")
              .withColumn("_start", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1, F.lit(chunk))))
              .select("path", "channel", "rate_hz", "width", "payload_offset", "_start",
                      F.least(F.lit(chunk), F.col("_b") - F.col("_start")).alias("_n")))
    dealt = spread(ranges, F.col("_n") * F.col("width"), "path", "_start", partitions=partitions)

    def rows(batches):
        for batch in batches:
            for path, channel, rate, width, offset, start, n in batch.itertuples(index=False):
                try:
                    with open_input(path) as f:
                        f.seek(int(offset + start * width))
                        data, error = _samples(f.read(int(n * width)), int(width)), None
                except OSError as exc:
                    data, error = None, f"cannot read: {exc}"
                yield (path, channel, start, rate, data, error)

    def run(batches):
        return frames(rows(batches), _CHUNK_COLUMNS, 4)

    errors = heads.where("error IS NOT NULL").select("path", "error")
    missed = good.where("NOT _b > _a").select("path", "channel", F.lit("no samples in range").alias("error"))
    return (dealt.mapInPandas(run, CHUNK_SCHEMA).unionByName(errors, allowMissingColumns=True)
            .unionByName(missed, allowMissingColumns=True))
