"""Hard negatives from Hilbert-ordered blocks whose zone maps tell which blocks an anchor has to read.

Vectors are written as Parquet, sorted by label and by their place on a Hilbert curve, one row
per block of neighbours with the least and greatest value of every dimension. For an anchor,
interval arithmetic on those values bounds all inner products of a block; a block is read only
if its bounds meet one of the anchor's score windows. Anchors travel in chunks and blocks in
groups, so a task meets a bounded number of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waveledger.llm.shared import checked, id_or_least, real_id
from waveledger.sources.tables import staged

#: Rows of a block, and components a block may hold.
BLOCK_ROWS, BLOCK_VALUES = 256, 1 << 16
#: Bits of a dimension on the curve.
CURVE_BITS = 4
#: Rows that one task sorts into blocks.
SORT_ROWS = 1 << 16
#: Anchors of a chunk; chunks, zone maps and blocks that one task meets at a time.
CHUNK = 256
CHUNKS, ZONES, BLOCKS = 16, 4096, 128
#: Scores that are looked at together.
SCORES = 1 << 20
#: Components saturate here, scores at the range of a long.
GREATEST = 2**31 - 1
UNBOUNDED = 2**63 - 1


def curve_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve, as bytes that sort in curve order, of rows of `bits`-bit cells.

    The cells are turned into the transposed index in place, all rows at once: from the coarsest
    bit down, a set bit inverts the finer bits of the first axis and a clear one exchanges them
    with the axis at hand; a Gray code of the axes follows.
    """
    x = cells.astype(np.int64)
    n, dims = x.shape
    if not dims:
        return [b""] * n
    for bit in range(bits - 1, 0, -1):
        finer = (1 << bit) - 1
        for d in range(dims):
            up = (x[:, d] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[:, 0] ^ x[:, d]) & finer)
            x[:, 0] ^= np.where(up, finer, swap)
            x[:, d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    planes = np.stack([x >> bit & 1 for bit in range(bits - 1, -1, -1)], 1).reshape(n, bits * dims)
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8), axis=1)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs; beyond their range they saturate."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each anchor can have with a vector of each zone.

    A positive component takes its least from the zone's low end, a negative one from its high
    end. Sums of doubles; a slack far above their rounding keeps the bounds safe.
    """
    plus, minus = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    lo, hi = lo.T.astype(np.float64), hi.T.astype(np.float64)
    low, high = plus @ lo + minus @ hi, plus @ hi + minus @ lo
    slack = 1 + 1e-9 * (plus - minus) @ np.maximum(np.abs(lo), np.abs(hi))
    return low - slack, high + slack


def wanted(scores_low: np.ndarray, scores_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Anchor x zone: whether the zone's interval meets one of the anchor's windows (anchor x window)."""
    meets = np.zeros(scores_low.shape, bool)
    for w in range(low.shape[1]):
        meets |= (scores_high >= low[:, w, None]) & (scores_low <= high[:, w, None])
    return meets


def best(anchor: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each anchor by decreasing score, then increasing identifier."""
    order = np.lexsort((ident, -score, anchor))
    a = anchor[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[place < k]


def _ints(cells: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i4").reshape(-1, dim) if dim else np.zeros((len(cells), 0), np.int32)


def _block_ints(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(n, -1)


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


BLOCK_FIELDS = ("block long, label string, dim int, n int, ids array<long>, anchors array<boolean>, q binary, "
                "lo binary, hi binary")


def _blocks(rows: DataFrame, n: int, top: int) -> DataFrame:
    """One row per block of neighbours on the curve, of one label and length."""
    keyed_schema = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch["dim"].to_numpy(), np.empty(batch.num_rows, object)
            q = batch["q"]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = q.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1) if d else np.zeros((len(at), 0))
                cells = (x.astype(np.int64) + top) * (1 << CURVE_BITS) // (2 * top + 1)
                keys[at] = curve_keys(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())],
                                             schema=to_arrow_schema(keyed_schema))

    order = ["label", "dim", "key", "id", "_tie"]
    sorted_rows = (rows.mapInArrow(keyed, keyed_schema).withColumn("_tie", F.xxhash64("q"))
                   .repartitionByRange(max(1, math.ceil(n / SORT_ROWS)), *order).sortWithinPartitions(*order)
                   .select("label", "dim", "id", "anchor", "q"))
    schema = _fields(BLOCK_FIELDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seq, held
            table = pa.Table.from_batches(held).combine_chunks()
            label, dim = table["label"].to_pylist(), table["dim"].to_numpy()
            flat = table["q"].combine_chunks().flatten().to_numpy()
            ends, at, out = np.cumsum(dim), 0, []
            ids, anchors = table["id"].to_pylist(), table["anchor"].to_pylist()
            while at < len(label):
                room = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(int(dim[at]), 1)))
                end = at
                while end < len(label) and end - at < room and label[end] == label[at] and dim[end] == dim[at]:
                    end += 1
                if end == len(label) and end - at < room and not last:
                    break
                x = flat[ends[at] - dim[at]:ends[end - 1]].reshape(end - at, int(dim[at])).astype("<i4")
                out.append((part << 24 | seq, label[at], int(dim[at]), end - at, ids[at:end], anchors[at:end], x.tobytes(),
                            x.min(0).tobytes() if x.size else b"", x.max(0).tobytes() if x.size else b""))
                seq, at = seq + 1, end
            held = table.slice(at).to_batches()
            if out:
                yield _batch(schema, out)

        for batch in batches:
            held.append(batch)
            yield from blocks(False)
        if held:
            yield from blocks(True)

    return staged(sorted_rows.mapInArrow(cut, schema), "blocks")


ANCHOR_FIELDS = "name long, id long, label string, dim int, q binary, low array<long>, high array<long>"
CHUNK_FIELDS = ("cgroup long, label string, dim int, names array<long>, ids array<long>, q binary, "
                "low array<array<long>>, high array<array<long>>")


def _anchors(blocks: DataFrame, k: int) -> DataFrame:
    """The anchors, each with the window above the k-th best score inside its own block."""
    schema = _fields(ANCHOR_FIELDS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = np.flatnonzero(r["anchors"])
                x = _block_ints(r["q"], r["n"])
                scores = products(x[at], x)
                scores[np.arange(len(at)), at] = np.iinfo(np.int64).min
                low = np.partition(scores, -k, axis=1)[:, -k] if r["n"] > k else np.full(len(at), -UNBOUNDED)
                out += [((r["block"] << 16) + int(i), r["ids"][i], r["label"], r["dim"], x[i].tobytes(), [int(t)], [UNBOUNDED])
                        for i, t in zip(at, low, strict=True)]
            yield _batch(schema, out)

    some = blocks.filter(F.exists("anchors", lambda x: x)).select("block", "label", "dim", "n", "ids", "anchors", "q")
    return staged(some.mapInArrow(pick, schema), "anchors")


def _chunks(anchors: DataFrame) -> DataFrame:
    """Anchors of a label and length, neighbours on the curve, packed into rows; chunks that follow each other are a group."""
    order = ["label", "dim", "name"]
    schema = _fields(CHUNK_FIELDS)
    dealt = (anchors.repartitionByRange(max(1, math.ceil(anchors.count() / SORT_ROWS)), *order).sortWithinPartitions(*order)
             .select("name", "id", "label", "dim", "q", "low", "high"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            row = (part << 24 | seq // CHUNKS, held[0]["label"], held[0]["dim"], [r["name"] for r in held], [r["id"] for r in held],
                   b"".join(r["q"] for r in held), [r["low"] for r in held], [r["high"] for r in held])
            seq += 1
            held.clear()
            return _batch(schema, [row])

        for batch in batches:
            for r in batch.to_pylist():
                room = max(1, min(CHUNK, BLOCK_VALUES // max(r["dim"], 1)))
                if held and (len(held) >= room or held[0]["label"] != r["label"] or held[0]["dim"] != r["dim"]):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    return staged(dealt.mapInArrow(pack, schema), "chunks")


class _Chunk:
    """A row of `_chunks` as arrays."""

    def __init__(self, r: dict):
        self.label, self.dim = r["label"], r["dim"]
        self.names, self.n = np.array(r["names"], np.int64), len(r["names"])
        self.q = _block_ints(r["q"], self.n)
        self.low, self.high = np.array(r["low"], np.int64), np.array(r["high"], np.int64)


def _needed(chunks: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """(cgroup, block): the blocks whose bounds meet a window of an anchor of the chunk group."""
    parts = max(1, math.ceil(zones.count() / ZONES))
    keys = ["label", "dim", "zgroup"] if same else ["dim", "zgroup"]
    left = chunks.withColumn("zgroup", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # the maps of a group of zones go to every chunk group that may need one
    right = (zones.withColumn("zgroup", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
             .join(left.select(*keys, "cgroup").distinct(), keys))
    keys = [*keys, "cgroup"]
    schema = _fields("cgroup long, block long")

    def test(mine: pa.Table, maps: pa.Table) -> pa.Table:
        found: set[int] = set()
        if mine.num_rows and maps.num_rows:
            names, labels = maps["block"].to_numpy(), np.array(maps["label"].to_pylist(), object)
            dim = maps["dim"][0].as_py()
            lo, hi = _ints(maps["lo"].to_pylist(), dim), _ints(maps["hi"].to_pylist(), dim)
            for r in mine.to_pylist():
                c = _Chunk(r)
                at = np.flatnonzero((labels == c.label) == same)
                meets = wanted(*bounds(c.q, lo[at], hi[at]), c.low, c.high)
                found.update(names[at[meets.any(0)]].tolist())
            group = mine["cgroup"][0].as_py()
            return pa.Table.from_batches([_batch(schema, [(group, b) for b in sorted(found)])])
        return pa.Table.from_batches([_batch(schema, [])])

    right = right.toDF(*right.columns)  # columns of its own, as it was joined with the left side
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(test, schema)


def _meet(c: _Chunk, blocks: list[dict], k: int, same: bool) -> list[tuple]:
    """(name, window, id, score) of the first k of each anchor and window among the blocks."""
    blocks = [b for b in blocks if b["dim"] == c.dim and (b["label"] == c.label) == same]
    if not blocks:
        return []
    lo, hi = (_ints([b[e] for b in blocks], c.dim) for e in ("lo", "hi"))
    meets = wanted(*bounds(c.q, lo, hi), c.low, c.high).any(0)
    blocks = [b for b, m in zip(blocks, meets, strict=True) if m]
    low, high = c.low.min(1), c.high.max(1)
    windows = c.low.shape[1]
    kept = np.zeros((4, 0), np.int64)  # anchor and window, identifier, score, anchor
    at = 0
    while at < len(blocks):
        rows, end = 0, at
        while end < len(blocks) and (end == at or (rows + blocks[end]["n"]) * c.n <= SCORES):
            rows += blocks[end]["n"]
            end += 1
        some = blocks[at:end]
        at = end
        x = np.concatenate([_block_ints(b["q"], b["n"]) for b in some])
        ident = np.concatenate([np.array(b["ids"], np.int64) for b in some])
        names = np.concatenate([(b["block"] << 16) + np.arange(b["n"]) for b in some])
        scores = products(c.q, x)
        i, j = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]))
        s = scores[i, j]
        keep = names[j] != c.names[i]
        i, j, s = i[keep], j[keep], s[keep]
        parts = [kept]
        for w in range(windows):
            inside = (s >= c.low[i, w]) & (s <= c.high[i, w])
            parts.append(np.stack([i[inside] * windows + w, ident[j[inside]], s[inside], i[inside]]))
        kept = np.concatenate(parts, 1)
        kept = kept[:, best(kept[0], kept[2], kept[1], k)]
    return [(int(c.names[a]), int(key % windows), int(ident), int(score)) for key, ident, score, a in kept.T]


def _first(anchors: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(name, window, other, score, place): the first k rows in each window of each anchor, place from 1."""
    chunks = _chunks(anchors)
    need = _needed(chunks, blocks.select("block", "label", "dim", "lo", "hi"), same).distinct()
    parts = max(1, math.ceil(blocks.count() / BLOCKS))
    sent = (need.join(blocks.drop("anchors"), "block")
            .withColumn("bgroup", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")))
    left = chunks.withColumn("bgroup", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = _fields("name long, window int, other long, score long")

    def score(mine: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if mine.num_rows and others.num_rows:
            read = others.to_pylist()
            for r in mine.to_pylist():
                found += _meet(_Chunk(r), read, k, same)
        return pa.Table.from_batches([_batch(schema, found)])

    keys = ["cgroup", "bgroup"]
    sent = sent.toDF(*sent.columns)
    found = left.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(score, schema)
    order = Window.partitionBy("name", "window").orderBy(F.desc("score"), "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5,
                   low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x) and a score is their inner product. The rows for which
    `anchor` holds are compared with all others of their length. Positives of an anchor are its
    first `positives` rows of the same label by decreasing score, then increasing id. For each,
    the first `negatives` rows of other labels whose score lies between `low_percent` and
    `high_percent` of the positive's are returned, ranked from 1.

    Rows with a null label, a null vector, or a null or non-finite component take no part;
    vectors of different lengths do not meet. Components saturate at the range of an int and
    scores at that of a long. A missing id is the smallest and stays null. Rows that repeat an
    id are rows of their own, and are positives of each other. A null `anchor` is none.
    """
    checked(vectors, id_col, vector_col, label_col)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(id_or_least(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad))
    q = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(GREATEST))),
                                                      F.lit(-float(GREATEST)))).cast("int"))
    rows = staged(rows.select("id", "label", F.size("v").alias("dim"), "anchor", q.alias("q")), "vectors")
    n, top = rows.agg(F.count(F.lit(1)), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))))).first()
    blocks = _blocks(rows, n, max(top or 0, 1))
    anchors = _anchors(blocks, positives)
    near = staged(_first(anchors, blocks, True, positives), "positives")
    low = F.expr(f"(cast(score as decimal(20,0)) * {low_percent} + 99) div 100")
    high = F.expr(f"(cast(score as decimal(20,0)) * {high_percent}) div 100")
    # windows in the order of the positives; below zero none can be met
    asked = (near.filter("score >= 0").groupBy("name")
             .agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))).alias("w"))
             .select("name", F.col("w.low").alias("low"), F.col("w.high").alias("high")))
    asking = staged(anchors.drop("low", "high").join(asked, "name").select("name", "id", "label", "dim", "q", "low", "high"), "asking")
    # anchors with fewer positives get windows that nothing meets
    pad = lambda c, x: F.concat(c, F.array_repeat(F.lit(x).cast("long"), F.lit(positives) - F.size(c)))
    asking = asking.withColumns({"low": pad(F.col("low"), UNBOUNDED), "high": pad(F.col("high"), -UNBOUNDED)})
    hard = _first(asking, blocks, False, negatives)
    pairs = near.select("name", (F.col("place") - 1).alias("window"), F.col("other").alias("positive"),
                        F.col("score").alias("positive_score"))
    named = hard.join(pairs, ["name", "window"]).join(anchors.select("name", "id"), "name")
    return named.select(real_id(F.col("id")).alias("anchor_id"), real_id(F.col("positive")).alias("positive_id"),
                        F.col("place").alias("rank"), real_id(F.col("other")).alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
