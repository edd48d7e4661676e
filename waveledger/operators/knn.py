"""Exact nearest neighbours: cells of pivots in few dimensions, rotated lower bounds in many.

In few dimensions the triangle inequality leaves most cells of training rows unvisited. In many
it leaves none, so there all rows of a key are one cell, and vectors are turned to the axes of
greatest spread instead: distances over the first axes bound the whole from below, and only
pairs that such a bound cannot exclude are measured in full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waveledger.functions.scalars import portable_hash
from waveledger.operators.ranking import top_k
from waveledger.sources.tables import staged


#: Pivots of a key at most.
MOST_PIVOTS = 2_048
#: Rows of a cell, about, if the caller names no number of pivots.
CELL_ROWS = 4_096
#: Dimensions up to which cells are of use.
CELL_DIMENSIONS = 16
#: Rows of a block of either side: of 64 dimensions they are 8 MB, and each side is sent once for every block of the other.
BLOCK_ROWS = 16_384
#: How much larger than asked for the blocks of a large cell may be.
WIDER = 4
#: Share of the spread that the leading axes hold.
SPREAD_SHARE = 0.5
#: Points and rows that are met at once, and the share of pairs that the leading axes may leave.
TILE, WORTH = 1_024, 0.02
#: What rounding may add to each term of a sum, as a share of the whole, by bytes of a number.
EPSILON = {4: 2.4e-7, 8: 1e-12}


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences, a few rows at a time."""
    out = np.empty((len(points), len(centres)))
    step = max(1, 2_000_000 // max(1, centres.size))
    for at in range(0, len(points), step):
        some = points[at:at + step, None, :] - centres[None, :, :]
        out[at:at + step] = (some * some).sum(axis=2)
    return out


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(_squared(points, centres))


def axes(sample: np.ndarray) -> tuple[np.ndarray, int]:
    """Orthonormal axes, as columns, of greatest spread first, and how many hold SPREAD_SHARE of it.

    Any orthonormal axes give lower bounds; the sample only decides how tight they are.
    """
    centred = sample - sample.mean(0)
    spread, turn = np.linalg.eigh(centred.T @ centred)
    spread, turn = np.maximum(spread[::-1], 0), turn[:, ::-1]
    total = spread.sum()
    leading = int(np.searchsorted(np.cumsum(spread), SPREAD_SHARE * total)) + 1 if total > 0 else 1
    return turn, min(leading, len(spread))


def _merged(i: np.ndarray, j: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j, d2) the k nearest of each i, in order; of equal distances the least j."""
    order = np.lexsort((j, d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d2[keep]


def _measured(points: np.ndarray, base: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs by direct differences."""
    out = np.empty(len(i))
    for a in range(0, len(i), 2_048):
        out[a:a + 2_048] = ((points[i[a:a + 2_048]] - base[j[a:a + 2_048]]) ** 2).sum(1)
    return out


def _wide(x: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products, of a left and a right side, are |b|^2 - 2 p b."""
    return np.column_stack([x, np.ones(len(x))]) if left else np.column_stack([-2 * x, (x * x).sum(1)])


def closest(points: np.ndarray, base: np.ndarray, turned: tuple[np.ndarray, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(indices, squared distances, pairs measured) of the k rows of `base` nearest to each point.

    Rows of `base` are met TILE at a time. What a product of matrices shows to be farther than the k best
    so far of a point is not measured; the rest is, by direct differences. The product goes over the
    leading axes first, as long as these alone exclude most pairs, and is one of single precision where its
    rounding, which is allowed for, is small beside the distances. Of equal distances the row that stands first counts.
    """
    k = min(k, len(base))
    turn, m = turned
    found, squares, measured = np.empty((len(points), k), np.int64), np.empty((len(points), k)), 0
    middle = base.mean(0)
    apart = base - middle
    far = float(np.sqrt((apart * apart).sum(1).max(initial=0)))
    sides = {8: _wide(apart, False)}
    if far < 1e15:
        sides[4] = sides[8].astype(np.float32)
    axes_left = m < base.shape[1]
    if axes_left:
        lead = _wide(apart @ turn[:, :m], False)
    size = max(TILE, k)
    for at in range(0, len(points), TILE):
        some = points[at:at + TILE]
        n = len(some)
        here = some - middle
        own = (here * here).sum(1)
        # what rounding may add: by the terms of a sum, their greatest values and the unit of rounding
        terms = (base.shape[1] + 8) * (far + np.sqrt(own)) ** 2
        left = {8: _wide(here, True)}
        if axes_left:
            part = here @ turn[:, :m]
            part_own, part = (part * part).sum(1), _wide(part, True)
        best, merged, waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), 0, []
        reach, unit = np.full(n, np.inf), 8
        for b in range(0, len(base), size):
            here_to = min(b + size, len(base))
            if b == 0 and here_to > k:  # a distance within which each point has k rows: those of least bound, measured
                first = np.argpartition(left[8] @ sides[8][:here_to].T, k - 1, axis=1)[:, :k]
                reach = _measured(some, base, np.repeat(np.arange(n), k), first.ravel()).reshape(n, k).max(1)
                measured += first.size
                if 4 in sides and np.median(EPSILON[4] * terms) < 0.01 * np.median(reach) and own.max() < 1e30:
                    left[4], unit = left[8].astype(np.float32), 4

            def near(a: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return np.divmod(np.flatnonzero(a @ rows.T <= bound.astype(a.dtype)[:, None]), len(rows))

            allowed = reach + EPSILON[unit] * terms + 1e-9
            if axes_left and b:
                i, j = near(part, lead[b:here_to], reach + EPSILON[8] * terms + 1e-9 - part_own)
                axes_left = len(i) <= WORTH * n * (here_to - b)  # to measure more costs more than all axes at once
            if not axes_left or not b:
                i, j = near(left[unit], sides[unit][b:here_to], allowed - own)
            j += b
            measured += len(i)
            waiting.append((i, j, _measured(some, base, i, j)))
            if here_to >= 2 * merged or here_to == len(base) or sum(len(w[0]) for w in waiting) > 100 * n:
                best = _merged(*(np.concatenate(x) for x in zip(best, *waiting)), k)
                merged, waiting = here_to, []
                reach = best[2][k - 1::k]  # each point has k by now
        found[at:at + TILE], squares[at:at + TILE] = best[1].reshape(n, k), best[2].reshape(n, k)
    return found, squares, measured


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_key(batch: pa.RecordBatch, keys: list[str]):
    """(key tuple, places of its rows, their vectors) for each key of a batch."""
    v = _vectors(batch.column("v"))
    for key, rows in batch.select(keys).to_pandas().groupby(keys, sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), rows, v[rows]


def _assign_cells(train: DataFrame, pivots: dict, keys: list[str], schema: str) -> DataFrame:
    """Add each training row's nearest pivot (`cell`) and the distance to it."""
    made = T._parse_datatype_string(schema + ", cell bigint, d double")

    def run(batches):
        out = to_arrow_schema(made)
        for batch in batches:
            for key, rows, v in _by_key(batch, keys):
                d = _distances(v, pivots[key])
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(cell.astype(np.int64)),
                                                  pa.array(d[np.arange(len(d)), cell])], names=out.names).cast(out)

    return train.mapInArrow(run, made)


def _candidate_cells(test: DataFrame, pivots: dict, cells: dict, k: int, keys: list[str],
                     schema: str) -> DataFrame:
    """One row per (test row, cell that may hold one of its k nearest).

    By the triangle inequality no member of a cell is nearer than d - radius, and k members
    lie within `reach`; cells beyond that reach are left out without losing a neighbour.
    """
    made = T._parse_datatype_string(schema + ", cell bigint")

    def run(batches):
        out = to_arrow_schema(made)
        for batch in batches:
            for key, rows, v in _by_key(batch, keys):
                facts = cells.get(key)
                if facts is None:
                    continue
                ids, counts, radius, kth = facts
                d = _distances(v, pivots[key][ids])
                # k members of one cell, or all members of several cells together.
                reach = np.where(counts >= k, d + kth, np.inf).min(axis=1)
                far = d + radius
                order = np.argsort(far, axis=1)
                enough = np.cumsum(counts[order], axis=1) >= min(k, counts.sum())
                together = np.take_along_axis(far, order, axis=1)[
                    np.arange(len(d)), enough.argmax(axis=1)]
                reach = np.minimum(reach, together)
                near = d - radius <= (reach * (1 + 1e-9) + 1e-9)[:, None]
                at, c = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows[at])).columns, pa.array(ids[c].astype(np.int64))], names=out.names).cast(out)

    return test.mapInArrow(run, made)


def _spread(df: DataFrame, cells: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Put a row into its own hash block and into every block of the other side."""
    at = df.join(F.broadcast(cells), [*keys, "cell"])
    return (at.withColumn(own, portable_hash("id") % F.col(f"n_{own}"))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1)))
            .drop(f"n_{own}", f"n_{other}"))


def block_count(n: int, block_rows: int) -> int:
    """Blocks of one side of a cell: of `block_rows` up to four of them, of up to WIDER times as many rows beyond.

    Each side is sent once for every block of the other, so fewer blocks are less to shuffle.
    """
    return min(-(-n // block_rows), max(4, -(-n // (WIDER * block_rows))))


def default_pivots(n: int) -> int:
    """Every visit of a cell sends a row and gives k, so cells hold as many rows as one product compares at ease."""
    return min(MOST_PIVOTS, math.isqrt(n) + 1, -(-n // CELL_ROWS))


def nearest(train: DataFrame, test: DataFrame, k: int, keys: list[str], id_col: str,
            vector: str, label: str, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest training rows of every test row within `keys` (Euclidean; ties by id).

    `keys` must be few (folds).  Training rows belong to the cell of their nearest pivot;
    a test row visits only the cells that can hold one of its k nearest (beyond CELL_DIMENSIONS
    there is one cell).  Within a cell
    both sides are hashed into blocks of about `block_rows` (WIDER times that in large cells), one task compares one block
    pair and keeps k rows per test row, so a cell of any size is split.  The driver sees
    the pivots and one summary row per cell (`pivots` per key), never the data.  By default
    there is a pivot for every CELL_ROWS rows of the largest key, but no more than the square root of
    these; at most MOST_PIVOTS, which bounds the driver.
    The result is exact at any number. In many dimensions every pair of blocks is met, though few
    pairs of rows are measured in full, so this is meant for training sets of a size the caller bounds.

    Columns: keys, test_id, train_id, distance2, train_label, rank.
    """
    types = dict(train.dtypes)
    key_schema = [f"`{c}` {types[c]}" for c in keys]
    test_schema = ", ".join([*key_schema, f"id {types[id_col]}", "v array<double>"])
    train_schema = test_schema + ", label string"

    def doubles(c: str):
        return F.transform(c, lambda x: x.cast("double")).alias("v")

    left = train.select(*keys, F.col(id_col).alias("id"), doubles(vector),
                        F.col(label).cast("string").alias("label"))
    right = test.select(*keys, F.col(id_col).alias("id"), doubles(vector))

    largest, dims = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).agg(F.max("n"), F.max("dims")).first()
    dims = dims or 1
    if pivots is None:
        pivots = default_pivots(largest or 1)
    chosen: dict[tuple, list] = {}
    for r in top_k(left.select(*keys, "id", "v"), keys, [portable_hash("id"), "id"],
                   pivots if dims <= CELL_DIMENSIONS else min(MOST_PIVOTS, max(pivots, 4 * dims))).collect():
        chosen.setdefault(tuple(r[c] for c in keys), []).append(r.v)
    samples = {key: np.array(v) for key, v in chosen.items()}
    turned = {key: axes(v) for key, v in samples.items()}
    centres = {key: v if v.shape[1] <= CELL_DIMENSIONS else v[:1] for key, v in samples.items()}

    members = staged(_assign_cells(left, centres, keys, train_schema), "knn-cells")
    where = [*keys, "cell"]
    sizes = members.groupBy(*where).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    kth = top_k(members.select(*where, "d", "id"), where, ["d", "id"], k).groupBy(*where).agg(
        F.max("d").alias("kth"))
    summary: dict[tuple, list] = {}
    for r in sizes.join(kth, where).collect():
        summary.setdefault(tuple(r[c] for c in keys), []).append((r.cell, r.n, r.radius, r.kth))
    cells = {key: tuple(np.array(x) for x in zip(*sorted(rows))) for key, rows in summary.items()}

    visits = staged(_candidate_cells(right, centres, cells, k, keys, test_schema), "knn-visits")
    visit_counts = {tuple(r[c] for c in where): r["count"]
                    for r in visits.groupBy(*where).count().collect()}
    blocks = [(*key, int(c), block_count(int(n), block_rows), block_count(visit_counts.get((*key, int(c)), 1), block_rows))
              for key, rows in summary.items() for c, n, _, _ in rows]
    plan = train.sparkSession.createDataFrame(
        blocks, ", ".join([*key_schema, "cell bigint, n_tb bigint, n_sb bigint"]))

    one = [*where, "tb", "sb"]
    known = _spread(members.drop("d"), plan, keys, "tb", "sb").groupBy(*one)
    asked = _spread(visits, plan, keys, "sb", "tb").groupBy(*one)
    schema = T._parse_datatype_string(", ".join(
        [*key_schema, f"test_id {types[id_col]}", f"train_id {types[id_col]}", "distance2 double", "train_label string"]))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        a = a.sort_by("id").combine_chunks()
        best, d2, _ = closest(_vectors(b["v"]), _vectors(a["v"]), turned[tuple(a[c][0].as_py() for c in keys)], k)
        each, which = pa.array(np.repeat(np.arange(len(best)), best.shape[1])), pa.array(best.ravel())
        made = [*(b[c].take(each) for c in keys), b["id"].take(each), a["id"].take(which), pa.array(d2.ravel()), a["label"].take(which)]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in made], names=out.names).cast(out)

    found = known.cogroup(asked).applyInArrow(compare, schema)
    order = Window.partitionBy(*keys, "test_id").orderBy("distance2", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent label among the neighbours; a tie goes to the lowest label."""
    counts = neighbours.groupBy(*keys, "test_id", "train_label").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys, "test_id").agg(
        F.min_by("train_label", F.struct(-F.col("_c"), F.col("train_label"))).alias("predicted"))
