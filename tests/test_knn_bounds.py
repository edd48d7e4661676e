"""Lower bounds of the nearest-neighbour search."""

import numpy as np
import pytest

from waveledger.operators import knn


def brute(points, base, k):
    d2 = ((points[:, None] - base[None]) ** 2).sum(2)
    best = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(d2, best, 1)


@pytest.mark.parametrize("n,dims,k", [(1, 3, 5), (7, 1, 3), (300, 8, 5), (300, 64, 5), (120, 20, 120)])
def test_equal_to_all_pairs(n, dims, k):
    rng = np.random.default_rng(n + dims)
    base = rng.normal(size=(n, dims)) * rng.exponential(size=dims)
    base[n // 2:] = base[:n - n // 2]  # ties: the first counts
    points = np.concatenate([rng.normal(size=(40, dims)), base[:5]])
    found, d2, full = knn.closest(points, base, knn.axes(base), k)
    best, want = brute(points, base, min(k, n))
    assert (found == best).all() and np.allclose(d2, want) and full >= found.size


def test_constant_vectors():
    base = np.ones((20, 30))
    found, d2, _ = knn.closest(base[:3], base, knn.axes(base), 4)
    assert (found == np.arange(4)).all() and (d2 == 0).all()


def test_few_pairs_are_measured_in_full(spark):
    """On the windows: the share of pairs that the bound leaves."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows if r.embedding is not None and None not in r.embedding])
    x = (x - x.mean(0)) / x.std(0)
    points, base = x[::5], np.delete(x, np.s_[::5], axis=0)
    found, _, full = knn.closest(points, base, knn.axes(base[:256]), 5)
    assert (found == brute(points, base, 5)[0]).all()
    print("share", full / (len(points) * len(base)))
    assert full < 0.2 * len(points) * len(base)


def test_axes_are_orthonormal():
    sample = np.random.default_rng(0).normal(size=(30, 12)) * np.arange(1, 13)
    turn, leading = knn.axes(sample)
    assert np.allclose(turn.T @ turn, np.eye(12)) and leading < 12
    share = ((sample - sample.mean(0)) @ turn).var(0)
    assert (np.diff(share) < 1e-9).all() and share[:leading].sum() >= knn.SPREAD_SHARE * share.sum()


def test_large_blocks_are_met_in_tiles(monkeypatch):
    """Every pair went through several matrices as large as the block; now all but a few are left out by one product."""
    monkeypatch.setattr(knn, "TILE", 64)
    rng = np.random.default_rng(9)
    for spread in (np.ones(20), np.r_[np.full(3, 30.0), np.ones(17)]):
        base = rng.normal(size=(900, 20)) * spread + 1e4
        base[600:700] = base[:100]
        points = np.concatenate([rng.normal(size=(150, 20)) * spread + 1e4, base[:20]])
        found, d2, full = knn.closest(points, base, knn.axes(base[:256]), 5)
        best, want = brute(points, base, 5)
        assert (found == best).all() and (d2 == want).all()
        assert full < 0.1 * len(points) * len(base)


def test_distances_that_single_precision_cannot_tell():
    rng = np.random.default_rng(10)
    base = rng.normal(size=(3_000, 6)) * 1e-5
    base[-1] = 1e3  # one far row, beside which all others are one
    points = rng.normal(size=(50, 6)) * 1e-5
    found, d2, full = knn.closest(points, base, knn.axes(base[:100]), 3)
    best, want = brute(points, base, 3)
    assert (found == best).all() and (d2 == want).all()
    found, _, _ = knn.closest(points * 1e25, base[:-1] * 1e25, knn.axes(base[:100]), 3)  # squares beyond single precision
    assert (found == brute(points * 1e25, base[:-1] * 1e25, 3)[0]).all()


def test_blocks_of_a_large_table_are_sent_a_few_times():
    """492,000 training and 123,000 test rows of a fold were sent 8 and 30 times."""
    assert knn.block_count(492_000, knn.BLOCK_ROWS) <= 8 and knn.block_count(123_000, knn.BLOCK_ROWS) <= 4


def test_cells_are_few_unless_the_rows_are_many(spark):
    """As many cells as the square root of the rows: in nine dimensions each test row visited nearly all, and each visit gave k rows."""
    assert [knn.default_pivots(n) for n in (1, 500, 34_188, 10**9)] == [1, 1, 9, knn.MOST_PIVOTS]
    rng = np.random.default_rng(11)
    base, points = rng.normal(size=(5_000, 9)), rng.normal(size=(60, 9))
    train, test = (spark.createDataFrame([(0, i, v.tolist(), "a") for i, v in enumerate(x)], "fold bigint, id bigint, v array<double>, label string")
                   for x in (base, points))
    got = {}
    for r in knn.nearest(train, test, 5, ["fold"], "id", "v", "label").collect():
        got.setdefault(r.test_id, {})[r["rank"] - 1] = r.train_id
    best, _ = brute(points, base, 5)
    assert all([got[i][p] for p in range(5)] == best[i].tolist() for i in range(60))
