"""Runs of words that repeat with a period, found by tiles that grow with the period.

Periods are parted into octaves [2^k, 2^(k+1)). For octave k a document is exploded into tiles of
16 * 2^k words, each overlapping half of the next, and a tile is solved alone: at multiples of
2^k, two Z-functions (of the words from there on and, reversed, of those before) tell how far
every period of the octave holds in both directions, inside the tile. The intervals are fragments
of runs. Spark shuffles them by document and period and stitches what overlaps by a period.

A tile's Z-functions are run only where hashes of 2^k words, computed for all places at once by
doubling, do not rule a run out. Short documents are solved together in one task; of longer ones
the tiles are dealt to tasks in chunks that overlap by half as well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waveledger.llm.shared import checked, id_or_least, real_id, text_or_empty
from waveledger.sources.tables import staged

#: Words of a tile, in units of the octave's least period; tiles begin every half.
TILE = 16
#: Repeats for which tiles and chunks are laid out; more are asked for when runs are whole.
REPEATS = 4
#: Words of a chunk that a task takes whole; longer documents are dealt out.
CHUNK = 1 << 15
#: Words of short documents that are solved together.
TOGETHER = 1 << 19
#: Multipliers of the doubling hash (odd, no meaning).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def z_function(s: list) -> list[int]:
    """For each place after the first, how many elements from there on equal the beginning."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class _Boundary:
    """How far periods hold around a place of a tile, by one Z-function in each direction."""

    def __init__(self, words: np.ndarray, at: int, lo: int, hi: int, longest: int):
        self.at, self.end = at, min(at + longest, hi)
        self.ahead = z_function(words[at:hi].tolist())
        before = words[lo:at][::-1].tolist()
        self.before = len(before)
        self.behind = z_function([*before, None, *words[lo:self.end][::-1].tolist()])

    def interval(self, period: int) -> tuple[int, int]:
        """The words around the place, inside the tile, that keep the period."""
        if self.at + period > self.end:
            return self.at, self.at
        after = self.ahead[period] if period < len(self.ahead) else 0
        place = self.before + 1 + self.end - self.at - period
        return self.at - (self.behind[place] if place < len(self.behind) else 0), self.at + period + after


def stitch(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) that overlap by a period or more, as one."""
    out: list[tuple[int, int, int]] = []
    for q, x, y in sorted(found):
        if out and out[-1][0] == q and x <= out[-1][2] - q:
            out[-1] = (q, out[-1][1], max(out[-1][2], y))
        else:
            out.append((q, x, y))
    return out


def _candidates(named: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): multiples of 2^k from where three repeats of a period of the octave may follow.

    `named` holds a hash of the 2^k words from each place on. The rows of its table of 2^k columns
    are the places, and the next row is what lies one least period further.
    """
    step = 1 << k
    table = named[:len(named) // step * step].reshape(-1, step)
    row, more = np.nonzero(table[1:] == table[:-1, :1])
    b, q = row << k, step + more
    fits = b + 3 * q <= len(named)
    b, q = b[fits], q[fits]
    for shift in (lambda q: q, lambda q: q - step, lambda q: 2 * q - step):
        same = named[b + shift(q)] == named[b + shift(q) + q]
        b, q = b[same], q[same]
    return b, q


def _unsettled(b: np.ndarray, q: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Candidates that are no multiple of the period of a run they lie in; `b` is in order."""
    free = np.ones(len(b), bool)
    if len(b):
        least = int(q.min())
        for p, x, y in runs:
            if y - x >= least + p:
                lo, hi = np.searchsorted(b, [x, y - p - least + 1])
                some = slice(lo, hi)
                free[some] &= (q[some] % p != 0) | (b[some] + q[some] + p > y)
    return free


def solve(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of all stretches of REPEATS smallest periods or more, up to `longest` words.

    Documents may follow each other, parted by values that occur once.
    """
    n = len(words)
    # values that occur once, so that no repeat reaches the end
    pad = 2 * max(longest // REPEATS, 1) + 2
    words = np.concatenate([words, -(np.arange(pad, dtype=np.int64) + 1) - (n + 2)])
    named = words.astype(np.uint64) * MIX[0]
    found: list[tuple[int, int, int]] = []
    k = 0
    while REPEATS << k <= longest:
        step = 1 << k
        b, q = _candidates(named, k)
        free = _unsettled(b, q, found)
        fresh, done = [], {}
        tile, around = -1, None
        for at, period in zip(b[free].tolist(), q[free].tolist(), strict=True):
            here = at // (TILE // 2 * step)
            if here != tile:
                tile, done, around = here, {}, None
            x, y = done.get(period, (0, 0))
            if x <= at and at + 3 * period <= y:
                continue
            if around is None or around.at != at:
                start = tile * (TILE // 2) * step
                around = _Boundary(words, at, max(start - 2 * step, 0), min(start + TILE * step, len(words)), 2 * step)
            x, y = done[period] = around.interval(period)
            if y - x >= 3 * period:
                fresh.append((period, x, y))
        found += [(p, x, y) for p, x, y in stitch(fresh) if y - x >= REPEATS * p]
        named = named * MIX[0] + np.roll(named, -step) * MIX[1]
        named ^= named >> np.uint64(31)
        k += 1
    return found


def _numbers(words: list[bytes], names: defaultdict) -> np.ndarray:
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def _solve_together(docs: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """(period, start, end) for each document."""
    names: defaultdict = defaultdict(count().__next__)
    parts, starts, at = [], [], 0
    for k, words in enumerate(docs):
        starts.append(at)
        parts += [_numbers(words, names), np.array([-(k + 1)])]
        at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    found = solve(np.concatenate(parts), max(map(len, docs)))
    places = np.searchsorted(starts, [x for _, x, _ in found], side="right") - 1
    for (p, x, y), d in zip(found, places.tolist(), strict=True):
        if y - x >= least:
            out[d].append((p, x - starts[d], y - starts[d]))
    return out


KEY = "id long, h1 long, h2 long"
FOUND = "array<struct<period:int,start:int,end:int>>"


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _first_pass(docs: DataFrame, plain: bool, least: int) -> DataFrame:
    """key, n_words, words (joined by a space), found: documents without a run if `plain`, else all others.

    `found` is null for documents that are too long for one task.
    """
    schema = _schema(f"{KEY}, n_words long, words binary, found {FOUND}")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            """`rows`: key, words; documents of up to CHUNK words, or a single longer one."""
            short = [r for r in rows if len(r[1]) <= CHUNK]
            found = dict(zip([id(r) for r in short], _solve_together([r[1] for r in short], least) if short else [],
                             strict=True))
            kept = [(*r[0], len(r[1]), b" ".join(r[1]), f) for r in rows
                    if (f := found.get(id(r))) is None and not plain or f is not None and (not f) == plain]
            columns = zip(*kept, strict=True) if kept else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            rows, total = [], 0
            keys = list(zip(*[batch[c].to_pylist() for c in ("id", "h1", "h2")], strict=True))
            for key, text in zip(keys, batch["text"], strict=True):
                words = text.as_py().split()  # of bytes: ASCII white space only
                if rows and total + len(words) > TOGETHER:
                    yield emit(rows)
                    rows, total = [], 0
                rows.append((key, words))
                total += len(words)
            if rows:
                yield emit(rows)

    return docs.mapInArrow(work, schema)


def _chunks(long: DataFrame) -> DataFrame:
    """key, octave (-1: all that fit CHUNK), offset, words: tiles of long documents, dealt out."""
    schema = _schema(f"{KEY}, octave int, offset long, data binary")
    arrow = to_arrow_schema(schema)
    first = (CHUNK // TILE).bit_length() - 1  # octaves before it have tiles within a chunk's overlap

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(zip(*[batch[c].to_pylist() for c in ("id", "h1", "h2")], strict=True), batch["words"], strict=True):
                words = text.as_py().split()
                data = _numbers(words, defaultdict(count().__next__)).astype("<i4")
                octave, size = -1, CHUNK
                while octave < 0 or REPEATS << octave <= len(data):
                    # the last tile begins at most one half before the end
                    for at in range(0, max(len(data) - size // 2, 1), size // 2):
                        row = (*key, octave, at, data[at:at + size].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(row, arrow, strict=True)], schema=arrow)
                    octave = first if octave < 0 else octave + 1
                    size = TILE << octave

    return long.mapInArrow(work, schema).repartition("id", "h1", "h2", "octave", "offset")


def _solve_chunks(chunks: DataFrame) -> DataFrame:
    """key, period, start, end: fragments in each chunk, of its octaves."""
    schema = _schema(f"{KEY}, period int, start int, end int")
    arrow = to_arrow_schema(schema)
    first = (CHUNK // TILE).bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key = [batch[c][r].as_py() for c in ("id", "h1", "h2")]
                octave, at = batch["octave"][r].as_py(), batch["offset"][r].as_py()
                data = np.frombuffer(batch["data"][r].as_py(), "<i4").astype(np.int64)
                top = first - 1 if octave < 0 else octave
                found = solve(data, min(len(data), (REPEATS << top + 1) - 1))
                found = [f for f in found if octave < 0 or f[0] >> octave == 1]
                columns = [[k] * len(found) for k in key] + [[f[0] for f in found], [f[1] + at for f in found], [f[2] + at for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return chunks.mapInArrow(work, schema)


def _stitched(fragments: DataFrame, copies: int, least: int) -> DataFrame:
    """key, runs: the runs of each document by start, then period."""
    key = ["id", "h1", "h2"]
    order = Window.partitionBy(*key, "period").orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > ahead - F.col("period"), F.lit(True)).cast("int")
    islands = (fragments.distinct().withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
               .groupBy(*key, "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
               .filter(F.col("end") - F.col("start") >= F.greatest(F.lit(least), copies * F.col("period"))))
    # one interval keeps multiples of its period as well: the smallest counts
    runs = islands.groupBy(*key, "start", "end").agg(F.min("period").alias("period"))
    run = F.struct(F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"),
                   F.col("period").cast("long").alias("period"))
    # (start, period) is unique, so length does not decide the order; struct order is start, length, period
    return runs.groupBy(*key).agg(F.array_sort(F.collect_list(run), lambda a, b: F.when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
        F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))).alias("runs"))


def _collapsed(held: DataFrame) -> DataFrame:
    """Drop all words of a run but its first period's."""
    schema = T.StructType([f for f in held.schema.fields if f.name != "words"] + [T.StructField("collapsed", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for words, runs in zip(batch["words"], batch["runs"], strict=True):
                words, runs = words.as_py(), runs.as_py()
                if runs:
                    words = words.split()
                    gone = np.zeros(len(words), bool)
                    for r in runs:
                        gone[r["start"] + r["period"]:r["start"] + r["length"]] = True
                    words = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                texts.append(words)
            kept = [batch[c] for c in schema.names if c != "collapsed"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], schema.names)

    return held.mapInArrow(work, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = 4,
                  least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed: one row per row of `docs`.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch of consecutive
    words with smallest period `period`, of at least `copies` periods (four or more) and `least`
    words, that no neighbouring word extends; `runs` is in the order of start, then period.
    `collapsed` is the text without the words of a run behind its first period, joined by one
    space.

    A null or empty text has no words and no runs. A missing id stays null; rows that repeat id
    and text have equal results. An empty table gives an empty result; other columns are not read.
    """
    checked(docs, id_col, text_col)
    if copies < REPEATS:
        raise ValueError(f"copies must be {REPEATS} or more, not {copies}")
    text = text_or_empty(text_col)
    docs = docs.select(id_or_least(id_col).alias("id"), F.xxhash64(text).alias("h1"),
                       F.xxhash64(F.lit(1), text).alias("h2"), text.cast("binary").alias("text"))
    # most documents have no run: they go straight to the result, only the others are written and shuffled
    held = staged(_first_pass(docs, False, least), "held")
    short = held.filter("found is not null").select("id", "h1", "h2", F.explode("found").alias("f")).select("id", "h1", "h2", "f.*")
    long = _solve_chunks(_chunks(held.filter("found is null").select("id", "h1", "h2", "words")))
    runs = staged(_stitched(short.union(long), copies, least), "runs")
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint,period:bigint>>)")
    joined = held.drop("found").join(runs, ["id", "h1", "h2"], "left").withColumn("runs", F.coalesce("runs", none))
    some = _collapsed(joined.select("id", "n_words", "words", "runs")).select("id", "n_words", "runs", "collapsed")
    rest = _first_pass(docs, True, least).select("id", "n_words", none.alias("runs"), F.col("words").alias("collapsed"))
    return rest.union(some).select(real_id(F.col("id")).alias("doc_id"), "n_words", "runs",
                                   F.col("collapsed").cast("string").alias("collapsed"))
