"""Captures as a Spark data source: `spark.read.format("capture").load(folder)`, also from SQL.

One row per chunk of a channel, and one with an `error` for every file or channel that gives
none. Planning lists names and lengths only; small files share a partition, large ones are cut
into parts of equal sample ranges, and a part reads the header and its own range. Filters on
`path` leave files unlisted for reading, filters on `channel` leave their samples unread.

Options: `offset_s`, `duration_s`, `chunk` (samples of a row), `mode` (of WAV files: all, first,
mono), `extension`, `part_bytes`.
"""

from __future__ import annotations

import math
import re
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith)

from waveledger import fixed_values as fv
from waveledger.sources import deep_memory, scope_bin, scope_csv, wav
from waveledger.sources.files import TASK_BYTES, TASK_FILES, _children, open_input

SCHEMA = "path string, channel string, start_sample bigint, fs double, samples array<float>, error string"
_ARROW = pa.schema([("path", pa.string()), ("channel", pa.string()), ("start_sample", pa.int64()), ("fs", pa.float64()),
                    ("samples", pa.list_(pa.float32())), ("error", pa.string())])
#: Samples of a record batch at most, but for one row.
BATCH_SAMPLES = 4_000_000

Row = tuple


@dataclass
class Span:
    """What is read of a file: seconds, samples of a row, which of its parts, and which channels."""

    offset_s: float
    duration_s: float | None
    chunk: int
    mode: str
    part: int
    parts: int
    wants: Callable[[str], bool]

    def range(self, rate: float, there: int) -> tuple[int, int]:
        first = math.floor(max(0.0, self.offset_s) * rate)
        return first, there if self.duration_s is None else min(there, first + round(self.duration_s * rate))

    def starts(self, a: int, b: int) -> list[int]:
        """First samples of this part's rows; the parts of a file share its rows evenly."""
        n = max(0, math.ceil((b - a) / self.chunk))
        return [a + k * self.chunk for k in range(n * self.part // self.parts, n * (self.part + 1) // self.parts)]

    def says_empty(self, a: int, b: int) -> bool:
        return b <= a and self.part == 0


def _scope(path: str, f, size: int, span: Span) -> Iterator[Row]:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    for h in scope_bin._header_rows(path, read, size):
        if h.get("error"):
            if span.part == 0:
                yield path, None, None, None, None, h["error"]
            continue
        if not span.wants(h["channel"]):
            continue
        a, b = span.range(h["rate_hz"], h["available_points"])
        if span.says_empty(a, b):
            yield path, h["channel"], None, None, None, "no samples in range"
        for start in span.starts(a, b):
            raw = read(h["payload_offset"] + start * h["width"], min(span.chunk, b - start) * h["width"])
            yield path, h["channel"], start, h["rate_hz"], scope_bin._samples(raw, h["width"]), None


def _wav(path: str, f, size: int, span: Span) -> Iterator[Row]:
    _, rate, channels, _, frames, _, error = wav._info(path, f)
    if error:
        if span.part == 0:
            yield path, None, None, None, None, error
        return
    names = ["mono"] if span.mode == "mono" else ["ch0"] if span.mode == "first" else [f"ch{c}" for c in range(channels)]
    if not any(span.wants(n) for n in names):
        return
    a, b = span.range(rate, frames)
    if span.says_empty(a, b):
        yield path, None, None, None, None, "no samples in range"
    for start in span.starts(a, b):
        with open_input(path) as own:  # the wave module closes what it reads
            for row in wav._channel_chunks(path, own, start, min(span.chunk, b - start), span.chunk, span.mode):
                if row[1] is None or span.wants(row[1]):
                    yield row


def _deep(path: str, f, size: int, span: Span) -> Iterator[Row]:
    name, there = "CH1(V)", size - fv.DEEP_MEMORY_HEADER
    if not span.wants(name):
        return
    a, b = span.range(fv.DEEP_MEMORY_RATE_HZ, there)
    if there <= 0 or span.says_empty(a, b):
        if span.part == 0:
            yield path, None, None, None, None, "no payload" if there <= 0 else "no samples in range"
        return
    lsb = deep_memory._lsb(f.read(fv.DEEP_MEMORY_HEADER))
    for start in span.starts(a, b):
        f.seek(fv.DEEP_MEMORY_HEADER + start)
        codes = f.read(min(span.chunk, b - start))
        yield path, name, start, fv.DEEP_MEMORY_RATE_HZ, [c * lsb for c in codes], None


def _increment(header: str) -> float:
    """Seconds between the lines of a memory export; 1 where the header does not say."""
    told = re.search(r"(?:tinc|increment)\s*=\s*([+-]?[\d.]+(?:[eE][+-]?\d+)?)\s*([afpnumkM]?)s?", header, re.I)
    try:
        return float(told[1]) * fv.SECONDS_FACTORS.get(told[2], 1.0) if told else 1.0
    except ValueError:
        return 1.0


def _csv(path: str, f, size: int, span: Span) -> Iterator[Row]:
    """A file is one part: the number of a line is known only after the lines before it."""
    lines = scope_csv._range_lines(f, 0, size)
    fields = [x.strip() for x in next(lines, b"").decode("utf-8", "replace").split(",")]
    screen = fields[0].lower().startswith("time")
    named = [x for x in fields if re.match(r".+\(.+\)", x) and not re.search("t0|tinc", x, re.I)]
    names = [x for x in fields[1:] if x] if screen else named or ["CH1(V)"]
    ahead = [x for _, x in zip(range(2), lines)]
    step = _increment(",".join(fields))
    rate = 1.0 / step if step > 0 else None
    if screen:
        times = [scope_csv._numbers(x, 0, 1)[0] for x in ahead]
        rate = 1.0 / (times[1] - times[0]) if len(times) == 2 and None not in times and times[1] > times[0] else None
    a, b = (0, None) if rate is None else span.range(rate, 1 << 62)
    some, start, held, i = False, a, [], -1

    def rows() -> Iterator[Row]:
        for c, name in enumerate(names):
            if span.wants(name):
                yield path, name, start, rate, [row[c] for row in held], None

    def every() -> Iterator[bytes]:
        yield from ahead
        yield from lines

    for i, line in enumerate(every()):
        if i < a or (b is not None and i >= b):
            continue
        held.append(scope_csv._numbers(line, 1 if screen else 0, len(names)))
        if len(held) == span.chunk:
            yield from rows()
            some, start, held = True, i + 1, []
    if held:
        yield from rows()
    elif not some:
        yield path, None, None, None, None, "no samples in range"


_READERS = {"scope_bin": _scope, "wav": _wav, "deep_memory": _deep, "scope_csv": _csv}
_EXTENSIONS = {"bin": "scope_bin", "wav": "wav", "wfm": "deep_memory", "csv": "scope_csv"}


def _reader(path: str, f) -> str | None:
    """By extension; where that names none, by the first bytes."""
    name = _EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")
    if name is None:
        head = f.read(12)
        f.seek(0)
        name = ("scope_bin" if head[:4] in fv.SCOPE_MAGICS else
                "wav" if head[:4] == b"RIFF" and head[8:] == b"WAVE" else None)
    return name


def file_rows(path: str, size: int, span: Span) -> Iterator[Row]:
    try:
        with open_input(path) as f:
            reader = _reader(path, f)
            if reader is None:
                yield path, None, None, None, None, "no reader"
            else:
                yield from _READERS[reader](path, f, size, span)
    except (OSError, wave.Error, EOFError) as exc:
        yield path, None, None, None, None, f"cannot read: {exc}"


@dataclass
class Part(InputPartition):
    """Parts of files: (path, length, part, parts)."""

    files: list[tuple[str, int, int, int]]

    def __init__(self, files):
        super().__init__(files)
        self.files = files


def _tests(filters: list[Filter], column: str) -> list[Callable[[str], bool]]:
    """The filters on a column that can be told without reading, as tests."""
    found: list[Callable[[str], bool]] = []
    for f in filters:
        if getattr(f, "attribute", None) != (column,):
            continue
        if isinstance(f, EqualTo):
            found.append(lambda x, v=f.value: x == v)
        elif isinstance(f, In):
            found.append(lambda x, v=frozenset(f.value): x in v)
        elif isinstance(f, StringStartsWith):
            found.append(lambda x, v=f.value: x.startswith(v))
        elif isinstance(f, StringEndsWith):
            found.append(lambda x, v=f.value: x.endswith(v))
        elif isinstance(f, StringContains):
            found.append(lambda x, v=f.value: v in x)
    return found


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """What is pushed only saves reading; Spark tests all filters again."""
        self.filters = list(filters)
        return self.filters

    def partitions(self) -> list[Part]:
        o = self.options
        if "path" not in o:
            raise ValueError("load() needs a folder")
        tests, limit = _tests(self.filters, "path"), int(o.get("part_bytes", TASK_BYTES))
        files = sorted((p, n) for p, n, folder in _children(o["path"].rstrip("/"), True) if not folder
                       and p.endswith(o.get("extension", "")) and all(t(p) for t in tests))
        out: list[Part] = []
        held, size = [], 0
        for path, n in files:
            parts = 1 if path.lower().endswith(".csv") else max(1, math.ceil(n / limit))
            if parts > 1:
                out += [Part([(path, n, k, parts)]) for k in range(parts)]
                continue
            if held and (size + n > limit or len(held) >= TASK_FILES):
                out.append(Part(held))
                held, size = [], 0
            held.append((path, n, 0, 1))
            size += n
        return [*out, Part(held)] if held else out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        o, tests = self.options, _tests(self.filters, "channel")
        duration = o.get("duration_s")
        rows: list[Row] = []
        size = 0
        for path, length, part, parts in partition.files:
            span = Span(float(o.get("offset_s", 0.0)), None if duration is None else float(duration), int(o.get("chunk", 65_536)),
                        o.get("mode", "all"), part, parts, lambda name: all(t(name) for t in tests))
            for row in file_rows(path, length, span):
                rows.append(row)
                size += len(row[4]) if row[4] is not None else 1
                if size >= BATCH_SAMPLES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
