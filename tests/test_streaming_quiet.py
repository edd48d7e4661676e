"""Quiet runs of a stream equal those of the table."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waveledger.streaming import quiet

KEYS = ["path"]


def samples(seed=1):
    """(path, i, ms, value): runs of zeros, a gap, missing values; one sample a second."""
    rng = random.Random(seed)
    rows = []
    for p in ("a", "b", "c"):
        i = 0
        while i < 120:
            n, value = rng.randint(1, 9), rng.choice([0.0, 0.0, 5.0, None, float("nan"), -0.4])
            for _ in range(n):
                rows.append((p, i, 1_000 * i, value))
                i += 1
            i += rng.choice([0, 0, 0, 0, 3])
    return rows


def late(rows, seed, delay):
    """The rows in an order in which none is later than `delay` seconds."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[2] + 1_000 * rng.uniform(0, delay))


@pytest.mark.parametrize("least", [1, 4])
def test_stream_equals_table(spark, tmp_path, least):
    rows = samples()
    schema = "path string, i bigint, ms bigint, value double"
    source = tmp_path / "in"
    source.mkdir()
    arriving = late(rows, 2, 8)
    arriving += [("end", 0, 10_000_000, 9.0), ("end", 1, 20_000_000, 9.0)]  # time goes on after the last sample
    for k, at in enumerate(range(0, len(arriving), 60)):
        pd.DataFrame(arriving[at:at + 60], columns=["path", "i", "ms", "value"]).to_parquet(source / f"{k:03d}.parquet", coerce_timestamps="us")
    shape = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms"))
    stream = spark.readStream.schema("path string, i bigint, ms bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    found = quiet.quiet_runs(stream.withColumn("ts", F.timestamp_millis("ms")), KEYS, 0.5, "10 seconds", 30, least)
    q = found.writeStream.outputMode("append").format("memory").queryName(f"quiet{least}").option(
        "checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table(f"quiet{least}").collect())
    want = sorted(tuple(r) for r in quiet.quiet_runs(shape, KEYS, 0.5, "10 seconds", 30, least).collect())
    assert got == want and len(want) > 5


def test_samples_wait_for_the_watermark():
    waiting = [(2, 20, True), (0, 0, True), (1, 10, True), (3, 30, False), (5, 50, True), (4, 40, True)]
    ended, rest, run = quiet.advance(waiting, None, 10)
    assert (ended, run) == ([], (0, 2, 10)) and sorted(w[0] for w in rest) == [2, 3, 4, 5]
    ended, rest, run = quiet.advance(rest, run, 40)
    assert ended == [(0, 3)] and run == (4, 5, 40) and rest == [(5, 50, True)]
    assert quiet.advance(rest, run, 100) == ([], [], (4, 6, 50))
    assert quiet.advance([(9, 90, True)], (4, 6, 50), 100) == ([(4, 6)], [], (9, 10, 90))  # indexes are missing between


def test_python_is_called_for_buckets_and_not_for_keys(spark, tmp_path):
    """Many keys share a state: calls of a batch do not grow with the keys; keys of all kinds come back whole."""
    rows = [(None if k == 7 else (1 << 60) + k, f"n{k % 3}", i, 1_000 * i, 0.0 if i % 5 else 3.0) for k in range(300) for i in range(12)]
    end = [(-1, "end", 0, 10_000_000, 9.0), (-1, "end", 1, 20_000_000, 9.0)]
    schema = "k bigint, name string, i bigint, ms bigint, value double"
    source = str(tmp_path / "in")
    for part in (rows, end[:1], end[1:]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(source)
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = quiet.quiet_runs(stream, ["k", "name"], 0.5, "10 seconds", 30, buckets=4)
    q = found.writeStream.outputMode("append").format("memory").queryName("buckets").option(
        "checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        states = max(op.numRowsTotal for p in q.recentProgress for op in p.stateOperators)
    finally:
        q.stop()
    got = spark.table("buckets")
    assert got.dtypes[:2] == [("k", "bigint"), ("name", "string")] and states <= 4
    want = quiet.quiet_runs(table, ["k", "name"], 0.5, "10 seconds", 30)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 900


def test_all_keys_of_a_bucket_advance_as_each_alone():
    rng = np.random.default_rng(5)
    for case in range(300):
        n_keys, upto, idle = int(rng.integers(1, 5)), 60, 15
        n = int(rng.integers(0, 30))
        # repeated and late indices in half of the cases
        i = rng.integers(0, 12, n) if case % 2 else rng.permutation(40)[:n]
        waiting = np.stack([rng.integers(0, n_keys, n), i, rng.integers(0, 80, n), rng.integers(0, 2, n)], 1).astype(np.int64)
        runs = np.array([(k, 2, int(rng.integers(3, 8)), int(rng.integers(0, 60))) for k in range(n_keys) if rng.random() < 0.5], np.int64).reshape(-1, 4)
        want_ended, want_rest, want_runs = [], [], []
        for k in range(n_keys):
            mine = [(a, b, bool(q)) for a, b, q in waiting[waiting[:, 0] == k, 1:].tolist()]
            opened = [tuple(r) for r in runs[runs[:, 0] == k, 1:].tolist()]
            ended, rest, run = quiet.advance(mine, opened[0] if opened else None, upto)
            if run is not None and not rest and run[2] + idle <= upto:
                ended, run = [*ended, run[:2]], None
            want_ended += [(k, *r) for r in ended]
            want_rest += [(k, *w) for w in rest]
            want_runs += [(k, *run)] if run is not None else []
        got = [sorted(map(tuple, x.tolist())) for x in quiet.advance_all(waiting, runs, upto, idle)]
        assert got == [sorted(want_ended), sorted(want_rest), sorted(want_runs)]
