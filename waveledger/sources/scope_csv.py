"""Scope CSV exports.

Two layouts: a first column of times, or a header that gives start and increment.
`samples` parses (path, content) in plain Spark expressions, `read_chunks` files on storage by
byte ranges. Every sample keeps its line position.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from waveledger.functions.scalars import si_parse_seconds
from waveledger.sources.files import frames, open_input, spread
from waveledger.sources.tables import staged

CHUNK_SCHEMA = ("path string, channel string, start_sample bigint, fs double, "
                "samples array<float>, error string")


def layout(files: DataFrame) -> DataFrame:
    """Add header, fields, mode (screen or memory), channels, t0 and t_inc."""
    text = F.col("content").cast("string")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    fields = F.transform(F.split(header, ","), lambda f: F.trim(f))

    def number(*patterns: str):
        found = [F.nullif(F.regexp_extract(header, p, 1), F.lit("")) for p in patterns]
        return si_parse_seconds(F.coalesce(*found))

    screen = F.lower(F.get(fields, F.lit(0))).startswith("time")
    named = F.filter(fields, lambda f: f.rlike(r"^.+\(.+\)") & ~F.lower(f).contains("t0")
                     & ~F.lower(f).contains("tinc"))
    memory_channels = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("CH1(V)")))
    return files.withColumn("_text", text).withColumns({
        "header": header,
        "mode": F.when(screen, "screen").otherwise("memory"),
        "channels": F.when(screen, F.filter(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))),
                                            lambda f: f != "")).otherwise(memory_channels),
        "t0": F.when(~screen, F.coalesce(number(
            r"(?i)t0\s*=\s*([^\s,]+)", r"(?i)start\s*=\s*([^\s,]+)"), F.lit(0.0))),
        "t_inc": F.when(~screen, F.coalesce(number(
            r"(?i)tinc\s*=\s*([^\s,]+)", r"(?i)increment\s*=\s*([^\s,]+)"), F.lit(1.0))),
    })


def _range_lines(f, start: int, end: int):
    """Complete non-blank lines that begin in [start, end), with their bytes, read piece by piece."""
    at = start
    if start:
        f.seek(start - 1)
        before = f.read(1)
        skip = before != b"\n"
    else:
        skip = False
    f.seek(start)
    held = b""
    while True:
        data = f.read(1 << 20)
        held += data
        lines = held.split(b"\n")
        held = lines.pop() if data else b""
        for line in lines:
            here, at = at, at + len(line) + 1
            if here >= end:
                return
            if skip:
                skip = False
            elif line.strip():
                yield line
        if not data:
            return


def read_chunks(listing: DataFrame, chunk: int = 65_536, offset_s: float = 0.0,
                duration_s: float | None = None, block: int = 8 << 20) -> DataFrame:
    """Chunks (path, channel, start_sample, fs, samples, error) of CSV exports on storage.

    Files are cut into byte ranges. A first pass counts the lines that begin in each range, so
    that the second knows the number of each range's first line; no task holds a file. Memory
    exports are cut by [offset, offset + duration); the rate of screen exports is not in the
    header, so it is the reciprocal of the first step of the time column. Numbers that cannot be
    read are null samples; a file without samples in the span gives an error row.
    """
    ranges = listing.select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block).cast("bigint"))).alias("_a"))
    ranges = ranges.select("path", "_a", F.least(F.lit(block), F.col("length") - F.col("_a")).alias("_size"))
    ranges = spread(ranges, F.col("_size"), "path", "_a")

    def count(batches):
        for batch in batches:
            rows = []
            for path, a, size in batch.itertuples(index=False):
                try:
                    with open_input(path) as f:
                        n = sum(1 for _ in _range_lines(f, int(a), int(a) + block))
                        head = b""
                        if a == 0:
                            f.seek(0)
                            lines = f.read(1 << 16).split(b"\n")
                            head = b"\n".join([x for x in lines if x.strip()][:3])
                    rows.append((path, a, size, n, head if a == 0 else None, None))
                except OSError as exc:
                    rows.append((path, a, size, 0, None, f"cannot read: {exc}"))
            yield pd.DataFrame(rows, columns=["path", "_a", "_size", "_lines", "content", "error"])

    counted = staged(ranges.mapInPandas(count, "path string, _a bigint, _size bigint, _lines bigint, content binary, error string"),
                     "csv-lines")
    before = Window.partitionBy("path").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    heads = layout(counted.where("content IS NOT NULL").select("path", "content"))
    # step of the time column, from the first two lines of numbers
    values = F.transform(F.slice(F.split("_text", r"\r?\n"), 2, 2),
                         lambda x: F.trim(F.get(F.split(x, ","), F.lit(0))).try_cast("double"))
    heads = heads.withColumn("_v", values).select(
        "path", "mode", "channels", F.when(F.col("mode") == "memory", F.col("t_inc")).otherwise(
            F.get("_v", F.lit(1)) - F.get("_v", F.lit(0))).alias("_step"))
    work = numbered.where("_lines > 0").join(heads, "path").select("path", "_a", "_size", "_first", "mode", "channels", "_step")

    def rows(batches):
        for batch in batches:
            for path, a, _, first, mode, channels, step in batch.itertuples(index=False):
                rate = 1.0 / step if step and step == step and step > 0 else None
                low, high = 0, None
                if rate is not None:
                    low = math.floor(max(0.0, offset_s) * rate + 1e-9)
                    high = None if duration_s is None else low + round(duration_s * rate)
                shift = 1 if mode == "screen" else 0
                try:
                    with open_input(path) as f:
                        held, start = [], None
                        for k, line in enumerate(_range_lines(f, int(a), int(a) + block)):
                            i = int(first) + k - 1  # line 0 is the header
                            if i < low or (high is not None and i >= high):
                                continue
                            start = i if start is None else start
                            held.append(_numbers(line, shift, len(channels)))
                            if len(held) >= chunk:
                                yield from _channels(path, channels, start, rate, held)
                                held, start = [], None
                        if held:
                            yield from _channels(path, channels, start, rate, held)
                except OSError as exc:
                    yield (path, None, None, None, None, f"cannot read: {exc}")

    def run(batches):
        return frames(rows(batches), ["path", "channel", "start_sample", "fs", "samples", "error"], 4)

    read = staged(spread(work, F.col("_size"), "path", "_a").mapInPandas(run, CHUNK_SCHEMA), "csv-chunks")
    failed = counted.where("error IS NOT NULL").select("path", "error")
    silent = listing.select("path").join(read.select("path").union(failed.select("path")).distinct(), "path", "left_anti")
    return read.unionByName(failed, allowMissingColumns=True).unionByName(
        silent.withColumn("error", F.lit("no samples in range")), allowMissingColumns=True)


def _numbers(line: bytes, shift: int, n: int) -> list[float | None]:
    cells = line.split(b",")[shift:shift + n]
    out = []
    for c in cells:
        try:
            out.append(float(c))
        except ValueError:
            out.append(None)
    return out + [None] * (n - len(out))


def _channels(path, channels, start, rate, held):
    for c, name in enumerate(channels):
        yield (path, name, start, rate, [row[c] for row in held], None)


def samples(files: DataFrame) -> DataFrame:
    """One row per sample: path, channel, i, t, value; unreadable numbers are null."""
    laid = layout(files)
    lines = F.filter(F.split(F.col("_text"), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = (laid.select("path", "mode", "channels", "t0", "t_inc", F.posexplode(lines)
                        .alias("_line", "_row")).where("_line > 0")
            .withColumn("i", (F.col("_line") - 1).cast("bigint"))
            .withColumn("_v", F.transform(F.split("_row", ","), lambda x: F.trim(x).try_cast("double"))))
    shift = F.when(F.col("mode") == "screen", 1).otherwise(0)
    t = F.when(F.col("mode") == "screen", F.get(F.col("_v"), F.lit(0))).otherwise(
        F.col("t0") + F.col("i") * F.col("t_inc"))
    return (rows.withColumn("t", t).withColumn("_shift", shift)
            .select("path", "i", "t", "_v", "_shift", F.posexplode("channels").alias("_c", "channel"))
            .select("path", "channel", "i", "t",
                    F.get(F.col("_v"), F.col("_c") + F.col("_shift")).alias("value")))


def time_base(rows: DataFrame) -> DataFrame:
    """Per file: rows, span and true interval (span over rows - 1)."""
    one = rows.groupBy("path", "channel").agg(
        F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("duration_s"))
    return one.withColumn("interval_s", F.try_divide(F.col("duration_s"), F.col("n") - 1))
