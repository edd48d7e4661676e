"""Random forests whose trees are dealt to tasks: a task grows some trees of a fold and gives only their votes.

The rows go to every (fold, block of trees) as numbers. Trees grow level by level, many nodes at a
time, as Spark ML's do: Poisson bootstrap, features drawn anew for each node, cuts at up to BINS
quantiles of the fold's training rows, gain in weighted Gini impurity or variance. Held-out rows go
down with the training rows, so no tree is kept, none passes through the driver, and parts of a tree
that no held-out row reaches are not grown. Results do not depend on the order of rows.

A task holds its fold's rows once (about 110 bytes each); `models` leaves sets beyond MOST rows to Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

#: Rows up to which trees are dealt whole to tasks.
MOST = 2_000_000
#: Trees of a block at least, as each block reads the fold's rows anew, and blocks of a forest at most.
TREES, BLOCKS = 10, 16
#: Ranges of a feature that splits lie between, and (tree, row) pairs that are split together.
BINS, PAIRS = 32, 1 << 16


def cuts(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Up to bins - 1 thresholds between distinct values; a value belongs below its threshold or on it."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) <= bins:
        at = np.arange(len(values) - 1)
    else:
        at = np.unique(np.searchsorted(np.cumsum(counts), len(x) * np.arange(1, bins) / bins))
        at = at[at < len(values) - 1]
    low, high = values[at], values[at + 1]
    with np.errstate(invalid="ignore", over="ignore"):
        middle = low / 2 + high / 2
    return np.where(np.isfinite(middle) & (middle >= low) & (middle < high), middle, low)


def recording_weights(key: np.ndarray, label: np.ndarray | None) -> np.ndarray:
    """Weights of `models.training_weights`: each recording alike, times the balanced class weight."""
    def equal(values: np.ndarray) -> np.ndarray:
        _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
        return len(values) / len(counts) / counts[which]

    return equal(key) if label is None else equal(key) * equal(label)


class Grower:
    """Trees over training rows (`bins`, target columns `y`, `weight`) and the votes of `asked` rows.

    For classes, `y` holds class numbers; a node's vote is its class shares. For numbers it holds
    values; the vote is their mean.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: np.ndarray, n_classes: int,
                 tried: int, depth: int, min_leaf: int):
        self.bins, self.y, self.weight, self.asked = bins, y, weight, asked
        self.classes, self.tried, self.depth, self.min_leaf = n_classes, tried, depth, min_leaf
        self.width = max(1, n_classes)
        self.votes = np.zeros(len(asked) * self.width)

    def _sums(self, place: np.ndarray, rows: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(weighted target sums by target and place, weights) of `n` places."""
        if self.classes:
            sums = np.bincount(self.y[rows] * n + place, w, n * self.width).reshape(self.width, n)
            return sums, sums.sum(0)
        return np.bincount(place, w * self.y[rows], n)[None], np.bincount(place, w, n)

    def grow(self, trees: Sequence[np.random.Generator], rng: np.random.Generator, gains: np.ndarray | None = None) -> None:
        """Grow one tree for each generator, which draws its bootstrap; add gains by tree and feature."""
        rows, times, node = [], [], []
        for t, own in enumerate(trees):
            drawn = own.poisson(1.0, len(self.y))
            if not drawn.any():
                drawn[:] = 1
            kept = np.flatnonzero(drawn)
            rows.append(kept)
            times.append(drawn[kept])
            node.append(np.full(len(kept), t))
        m, a = len(trees), len(self.asked)
        todo = [(0, np.concatenate(rows), np.concatenate(times), np.concatenate(node),
                 np.tile(np.arange(a), m), np.repeat(np.arange(m), a), np.arange(m))]
        while todo:
            level, rows, times, node, asked, at, tree = todo.pop()
            m = len(tree)
            if len(rows) + len(asked) > PAIRS and m > 1:
                half = int(np.searchsorted(np.cumsum(np.bincount(node, minlength=m)), len(rows) / 2)) + 1
                half = min(max(half, 1), m - 1)
                for low, high in ((0, half), (half, m)):
                    r, q = (node >= low) & (node < high), (at >= low) & (at < high)
                    todo.append((level, rows[r], times[r], node[r] - low, asked[q], at[q] - low, tree[low:high]))
                continue
            w = times * self.weight[rows]
            total, mass = self._sums(node, rows, w, m)
            feature, cut, gain = self._best(rows, times, w, node, total, mass, rng)
            split = np.isfinite(gain) & (level < self.depth)
            if gains is None:
                split &= np.bincount(at, minlength=m) > 0  # only what a held-out row reaches
            else:
                np.add.at(gains, (tree[split], feature[split]), gain[split])
            ends = ~split[at]
            if ends.any():
                vote = (total[:, at[ends]] / mass[at[ends]]).T
                np.add.at(self.votes, (asked[ends, None] * self.width + np.arange(self.width)).ravel(), vote.ravel())
            if not split.any():
                continue
            rank = np.cumsum(split) - 1
            r, q = split[node], ~ends
            rows, times, node, asked, at = rows[r], times[r], node[r], asked[q], at[q]
            right = self.bins[rows, feature[node]] > cut[node]
            below = self.asked[asked, feature[at]] > cut[at]
            todo.append((level + 1, rows, times, 2 * rank[node] + right, asked, 2 * rank[at] + below,
                         np.repeat(tree[split], 2)))

    def _best(self, rows, times, w, node, total, mass, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, last bin of the left side, gain) of each node's best split; gain -inf where there is none."""
        m, d = len(mass), self.bins.shape[1]
        count = np.bincount(node, times, m)
        drawn = rng.random((m, d)).argsort(1)[:, :self.tried]
        own = (total * total).sum(0) / mass
        feature, cut, best = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, -np.inf)
        if self.classes:
            mixed = np.count_nonzero(total, axis=0) > 1
        else:
            squares = np.bincount(node, w * self.y[rows] ** 2, m)
            mixed = squares - own > 1e-12 * squares
        open_ = mixed & (count >= 2 * self.min_leaf)
        if not open_.any():
            return feature, cut, best
        # settled nodes take no part
        rank, kept = np.cumsum(open_) - 1, open_[node]
        rows, times, w, node = rows[kept], times[kept], w[kept], rank[node[kept]]
        ids = np.flatnonzero(open_)
        total, mass, count, own, drawn, m = total[:, ids], mass[ids], count[ids], own[ids], drawn[ids], len(ids)
        for s in range(drawn.shape[1]):
            key = node * BINS + self.bins[rows, drawn[node, s]]
            if m * BINS <= 2 * len(rows):
                cells, cell = np.arange(m * BINS), key
            else:
                cells, cell = np.unique(key, return_inverse=True)
            n = len(cells)
            sums, weights = self._sums(cell, rows, w, n)
            here = cells // BINS
            first = np.searchsorted(here, np.arange(m))
            size = np.diff(first, append=n)

            def upto(x: np.ndarray) -> np.ndarray:
                run = np.cumsum(x, axis=-1)
                return run - np.repeat(run[..., first] - x[..., first], size, axis=-1)

            left, wl, nl = upto(sums), upto(weights), upto(np.bincount(cell, times, n))
            right, wr = np.repeat(total, size, axis=-1) - left, mass[here] - wl
            fine = (nl >= self.min_leaf) & (count[here] - nl >= self.min_leaf)
            score = np.full(n, -np.inf)
            with np.errstate(invalid="ignore", divide="ignore"):
                both = (left * left).sum(0) / wl + (right * right).sum(0) / wr
            score[fine] = both[fine] - own[here[fine]]
            top = np.maximum.reduceat(score, first)
            hit = np.flatnonzero(score == top[here])[::-1]
            place = np.empty(m, np.int64)
            place[here[hit]] = hit  # the first of equal ones stays
            better = top > np.maximum(best[ids], 1e-9 * np.abs(own))
            feature[ids[better]] = drawn[better, s]
            cut[ids[better]] = cells[place[better]] % BINS
            best[ids[better]] = top[better]
        return feature, cut, best


def _plain(rows: DataFrame, key: str, target: str, held: list, trees: int) -> tuple[DataFrame, int]:
    """The rows once for every (fold, block): what a task needs of them."""
    blocks = max(1, min(BLOCKS, trees // TREES))
    out = rows.select(
        "_row", F.xxhash64(key).alias("key"), F.col(key).isNotNull().alias("keyed"), F.col(target).cast("double").alias("y"),
        vector_to_array("features").alias("x"), F.explode(F.array(*held)).alias("part")).select(
        "_row", "key", "keyed", "y", "x", "part.*").where(F.col("asked").isNotNull()).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # one task for each: their work is in the trees, not in the bytes that adaptive execution would join them by
    dealt = out.withColumn("job", F.col("part") * F.lit(blocks) + F.col("block"))
    return dealt.repartitionById(len(held) * blocks, "job"), blocks


def _read(table: pa.Table) -> tuple[np.ndarray, ...]:
    """row, key, y, x, asked, known of a group, in an order that only their content decides."""
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    y = table.column("y").to_numpy()
    asked = table.column("asked").to_numpy()
    known = ~asked & table.column("keyed").to_numpy() & ~np.isnan(y)
    key = table.column("key").to_numpy()
    order = np.lexsort((*x.T, key, y, asked))
    return table.column("_row").to_numpy()[order], key[order], y[order], x[order], asked[order], known[order]


def _task(trees: int, blocks: int, n_classes: int, tried: int, depth: int, min_leaf: int, seed: int, weighted: bool, gains: bool):
    """What a task does with the rows of a (fold, block); rows of `gains` are blocks, not asked rows."""
    def work(names: tuple, table: pa.Table) -> pa.Table:
        fold, block = divmod(names[0].as_py(), blocks)
        row, key, y, x, asked, known = _read(table)
        if not known.any():
            raise ValueError(f"fold {fold} has no training rows")
        target = y[known]
        shift = 0.0
        if n_classes:
            if ((target < 0) | (target >= n_classes) | (target != np.floor(target))).any():
                raise ValueError(f"labels are not 0 to {n_classes - 1}")
            target = target.astype(np.int64)
        else:
            shift = float(target.mean())
            target = target - shift
        weight = recording_weights(key[known], target if n_classes else None) if weighted else np.ones(len(target))
        bins = np.empty(x.shape, np.uint8)
        for j in range(x.shape[1]):
            bins[:, j] = np.searchsorted(cuts(x[known, j]), x[:, j])
        grower = Grower(bins[known], target, weight, bins[asked], n_classes, tried, depth, min_leaf)
        mine = range(block, trees, blocks)
        step = max(1, PAIRS // len(row))
        share = np.zeros(x.shape[1])
        for at in range(0, len(mine), step):
            some = mine[at:at + step]
            found = np.zeros((len(some), x.shape[1])) if gains else None
            grower.grow([np.random.default_rng([seed, fold, 0, t]) for t in some],
                        np.random.default_rng([seed, fold, 1, some[0]]), found)
            if gains:
                sums = found.sum(1, keepdims=True)
                share += np.divide(found, sums, out=np.zeros_like(found), where=sums > 0).sum(0)
        width = grower.width
        flat, n, ids = (share, 1, [block]) if gains else (grower.votes + shift * len(mine), int(asked.sum()), row[asked])
        offsets = np.arange(n + 1, dtype=np.int32) * (len(share) if gains else width)
        return pa.table({"_row": pa.array(ids, pa.int64()), "block": pa.array(np.full(n, block), pa.int32()),
                         "votes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return work


_VOTES = T.StructType([T.StructField("_row", T.LongType()), T.StructField("block", T.IntegerType()),
                       T.StructField("votes", T.ArrayType(T.DoubleType()))])


def _added(parts: DataFrame, by: Sequence[str], trees: int) -> DataFrame:
    """by, votes: the mean over the trees, added up in the order of blocks."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("block", "votes"))), lambda p: p["votes"])
    summed = F.aggregate(F.slice("_p", 2, BLOCKS), F.get("_p", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return parts.groupBy(*by).agg(lists.alias("_p")).select(*by, F.transform(summed, lambda v: v / F.lit(float(trees))).alias("votes"))


def out_of_fold_votes(rows: DataFrame, folds: Sequence, key: str, target: str, n_classes: int, trees: int, tried: int,
                      depth: int, min_leaf: int, seed: int, fold: str = "fold") -> DataFrame:
    """_row, votes: class shares (or, for `n_classes` 0, the mean) that the trees of its fold give each held-out row.

    `rows` is a written table with `_row`, which tells rows apart, and `features`.
    """
    held = [F.struct(F.lit(p).alias("part"), (F.col(fold) == F.lit(f)).alias("asked")) for p, f in enumerate(folds)]
    plain, blocks = _plain(rows, key, target, held, trees)
    votes = plain.groupBy("job").applyInArrow(
        _task(trees, blocks, n_classes, tried, depth, min_leaf, seed, True, False), _VOTES)
    return _added(votes, ["_row"], trees)


def importance(rows: DataFrame, target: str, n_classes: int, features: Sequence[str], trees: int, tried: int, depth: int,
               min_leaf: int = 1, seed: int = 42) -> DataFrame:
    """feature, importance: share of the gain by feature, equal for every tree, of a forest over all rows."""
    rows = rows.withColumns({"_row": F.lit(0).cast("bigint"), "_all": F.lit(0)})
    plain, blocks = _plain(rows, "_all", target, [F.struct(F.lit(0).alias("part"), F.lit(False).alias("asked"))], trees)
    gains = plain.groupBy("job").applyInArrow(
        _task(trees, blocks, n_classes, tried, depth, min_leaf, seed, False, True), _VOTES)
    one = _added(gains.withColumn("_all", F.lit(0)), ["_all"], trees)
    names = F.array(*[F.lit(f) for f in features])
    summed = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
    return one.select(F.explode(F.arrays_zip(names.alias("f"), F.transform("votes", lambda v: F.try_divide(v, summed)).alias("v"))).alias("z")).select(
        F.col("z.f").alias("feature"), F.coalesce("z.v", F.lit(0.0)).alias("importance"))
