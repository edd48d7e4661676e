"""Steps whose cost has to follow their input: results held against plain versions, and what made them grow faster."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from waveledger.operators import knn, metrics, stats
from waveledger.sources import files, scope_csv, tables


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_macro_curve_looks_up_neighbours_without_frames_to_the_end(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), [round(float(x), 2) for x in rng.normal(size=3)]) for _ in range(300)]
    made = metrics.macro_roc_curve(spark.createDataFrame(rows, "label bigint, scores array<double>"), "label", "scores", [0, 1, 2], slices=7)
    assert "unboundedfollowing" not in plan_of(made)  # such a frame costs the square of its partition
    curves = []
    for c in range(3):
        pos = np.array([r[0] == c for r in rows])
        score = np.array([r[1][c] for r in rows])
        points = [(0.0, 0.0)] + [(float((score[~pos] >= s).mean()), float((score[pos] >= s).mean())) for s in sorted(set(score), reverse=True)]
        curves.append(points)
    want = {}
    for x in {x for points in curves for x, _ in points}:
        total = 0.0
        for points in curves:
            at = [y for px, y in points if px == x]
            before = max(p for p in points if p[0] <= x)
            after = min((p for p in points if p[0] > x), default=None)
            total += max(at) if at else before[1] + (after[1] - before[1]) * (x - before[0]) / (after[0] - before[0])
        want[round(x, 12)] = total / 3
    got = {round(r.fpr, 12): r.macro_tpr for r in made.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_small_files_are_listed_once_and_share_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.csv").write_text("Time(s),CH1(V)\n0,1\n0.5,2\n")
    listing = files.listing(spark, str(tmp_path))
    assert "MapInPandas" not in plan_of(listing)  # each level was listed again for the next and for every reader
    assert listing.count() == 40
    with tables.scope() as made:
        rows = scope_csv.read_chunks(listing).collect()
    assert sorted(r.path for r in rows) == sorted(str(tmp_path / f"d{k}" / "a.csv") for k in range(40))
    assert all(list(r.samples) == [1.0, 2.0] and r.fs == 2.0 for r in rows)
    # a file of 30 bytes stood for 8 MB, so four of them made a task
    assert all(len(spark.read.parquet(folder).inputFiles()) == 1 for folder in made)


def test_many_small_ranges_are_dealt_by_the_files_they_open(spark):
    dealt = files.spread(spark.range(1000).withColumn("n", F.lit(10)), F.col("n"), "id")
    assert dealt.rdd.getNumPartitions() == -(-1000 // files.TASK_FILES)


def test_large_cells_have_fewer_blocks():
    assert [knn.block_count(n, 4096) for n in (1, 4096, 4097, 16_384)] == [1, 1, 2, 4]  # small ones stay as they were
    assert [knn.block_count(n, 4096) for n in (34_000, 68_000, 400_000)] == [4, 5, 25]
    assert max(n / knn.block_count(n, 4096) for n in range(1, 300_000, 997)) <= knn.WIDER * 4096  # a task holds no more


def test_draws_of_many_iterations_at_once_are_those_of_one_after_the_other():
    x, draws = np.random.default_rng(1).normal(size=300), np.array([0, 5, 300, 0, 0, 700, 1, 0])
    one = np.random.default_rng(2)
    want = [float(x[one.integers(0, len(x), m)].sum()) for m in draws]
    for at_once in (1, 600, 10_000):
        assert np.allclose(stats.drawn_sums(x, draws, np.random.default_rng(2), at_once), want, rtol=0, atol=1e-9)
