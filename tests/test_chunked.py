"""Checks of stored chunks against the long form, on awkward cuts; folds of groups with several classes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveledger.functions import ordered
from waveledger.operators import benchmark, chunked, models, quality, splits, timefeat, windows

KEYS = ["path"]


def recordings(seed=1):
    """path -> samples: gaps, flat parts, one sample, values with a large offset."""
    rng = random.Random(seed)
    out = {}
    for k in range(8):
        x = []
        while len(x) < rng.choice([1, 9, 40, 200]):
            kind = rng.random()
            n = rng.randint(1, 12)
            x += [0.0] * n if kind < 0.4 else [float(rng.randint(-3, 3))] * n if kind < 0.6 else [float(rng.randint(0, 255)) for _ in range(n)]
        out[f"r{k}"] = x
    out["offset"] = [1e7 + (i % 5) * 1e-3 for i in range(300)]
    out["zeros"] = [0.0] * 33
    return out


def frames(spark, data, seed=2):
    """(chunks of uneven lengths, long form) of the same samples; chunks of length 0 and error rows besides."""
    rng = random.Random(seed)
    chunks, long = [], []
    for path, x in data.items():
        at = 0
        while at < len(x):
            n = rng.choice([1, 2, 3, 7, 30])
            chunks.append((path, "a", at, len(x), x[at:at + n]))
            at += n
        long += [(path, "a", i, len(x), v) for i, v in enumerate(x)]
        chunks.append((path, "a", len(x), len(x), []))
    chunks.append(("broken", None, None, None, None))
    rng.shuffle(chunks)
    schema = "path string, channel string, {} bigint, n bigint, {}"
    return (spark.createDataFrame(chunks, schema.format("start_sample", "samples array<double>")),
            spark.createDataFrame(long, schema.format("i", "value double")))


def same(a, b, digits=6):
    def plain(v):
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        return float(f"{v:.{digits}g}") if isinstance(v, float) else v

    rows = lambda df, cols: sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


@pytest.fixture(scope="module")
def both(spark):
    return frames(spark, recordings())


def test_recording_measures(both):
    chunks, long = both
    same(chunked.channel_stats(chunks, KEYS), timefeat.channel_stats(long, KEYS))
    same(chunked.clipping(chunks, KEYS, F.lit(-1.0), F.lit(200.0)), timefeat.clipping(long, KEYS, F.lit(-1.0), F.lit(200.0)))
    same(chunked.worst_dc_offset(chunks, KEYS, "channel"), timefeat.worst_dc_offset(long, KEYS, "channel"))


def test_deviation_of_small_changes_on_a_large_offset(both):
    got = {r.path: r.std for r in chunked.channel_stats(both[0], KEYS).collect()}
    assert got["offset"] == pytest.approx(np.std([(i % 5) * 1e-3 for i in range(300)]), rel=1e-6)


@pytest.mark.parametrize("block", [1, 4, 10])
def test_blocks(both, block):
    chunks, long = both
    found, want = chunked.quiet_blocks(chunks, KEYS, block), quality.quiet_blocks(long, KEYS, block)
    same(found, want)
    same(chunked.leading_quiet(chunks, found, KEYS, block, 8.0), quality.leading_quiet(long, want, KEYS, block, 8.0))
    same(chunked.rms_variation(chunks, KEYS, block), timefeat.rms_variation(long, KEYS, block))
    same(chunked.quiet_blocks(chunks, KEYS, block, alone=False), want)


def test_blocks_of_two_channels_are_merged(spark):
    x = [float(v) for v in range(20)]
    chunks = spark.createDataFrame([("p", c, a, 20, x[a:a + 5]) for c in "ab" for a in range(0, 20, 5)],
                                   "path string, channel string, start_sample bigint, n bigint, samples array<double>")
    got = chunked.complete_blocks(chunks, KEYS, 5, alone=False).orderBy("block").collect()
    assert [r.rms for r in got] == pytest.approx([np.sqrt(np.mean(np.square(x[a:a + 5]))) for a in range(0, 20, 5)])


@pytest.mark.parametrize("bins", [1, 7, 1000])
def test_envelope(both, bins):
    chunks, long = both
    same(chunked.envelope(chunks.where("samples is not null"), KEYS, 8.0, bins), windows.envelope(long, KEYS, 8.0, bins))


@pytest.mark.parametrize("skip", [0, 5, 31])
def test_tumbling_arrays(both, skip):
    chunks, long = both
    got = chunked.tumbling_windows(chunks.where("samples is not null"), KEYS, 6, skip).select("path", "segment_index", "samples")
    same(got, windows.tumbling_windows(long, KEYS, 6, skip).select("path", "segment_index", "samples"))


def test_runs_and_baseline(both):
    chunks, long = both
    same(chunked.runs(chunks, KEYS, lambda v: v == 0), ordered.runs(long, KEYS, "i", F.col("value") == 0))
    same(chunked.zero_baseline(chunks, KEYS), quality.zero_baseline(long, KEYS))


@pytest.mark.parametrize("slice_len", [1, 3, 8, 50, 1 << 26])
def test_touching_pieces_join_across_slices(spark, slice_len):
    rng = random.Random(slice_len)
    pieces, want = [], set()
    for key in ("a", "b", None):
        at = 0
        for _ in range(40):
            at += rng.choice([1, 1, 2, 9])
            begin = at
            for _ in range(rng.choice([1, 1, 2, 6])):
                n = rng.choice([1, 2, 5, 20])
                pieces.append((key, at, at + n))
                at += n
            if key is not None:
                want.add((key, begin, at))
    frame = spark.createDataFrame([p for p in pieces if p[0]], "path string, start bigint, end bigint")
    got = {tuple(r) for r in ordered.join_touching(frame, KEYS, slice_len).collect()}
    assert got == want


def test_nulls_and_gaps_in_samples(spark):
    chunks = spark.createDataFrame([("p", "a", 0, 8, [None, 2.0, float("nan"), 4.0]), ("p", "a", 4, 8, [0.0, None, 0.0, 0.0]),
                                    ("q", "a", 0, 2, [None, None])],
                                   "path string, channel string, start_sample bigint, n bigint, samples array<double>")
    got = {r.path: r for r in chunked.channel_stats(chunks, KEYS).collect()}
    assert set(got) == {"p"} and got["p"].n == 5 and got["p"].vmax == 4.0
    assert sorted(tuple(r) for r in chunked.runs(chunks, KEYS, lambda v: v == 0).collect()) == [("p", 4, 5), ("p", 6, 8)]
    none = chunks.where("false")
    assert chunked.channel_stats(none, KEYS).count() == chunked.zero_baseline(none, KEYS).count() == 0


def test_few_rows_are_shuffled(spark):
    """Of long recordings, what is exchanged follows the chunks."""
    chunks = spark.range(40).selectExpr(
        "cast(id % 2 as string) as path", "'a' as channel", "(id div 2) * 10000 as start_sample", "200000L as n",
        "transform(sequence(0, 9999), i -> cast((i * 7919 + id) % 256 as double)) as samples")
    parts = chunked.block_measures(chunks, KEYS, lambda i: F.floor(i / F.lit(3000)), lambda b: b * 3000)
    assert parts.count() == 2 * 67
    cut = parts.where("last - first + 1 < 3000")
    assert cut.count() == 2  # only the tails


# ---- folds

def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def plain_folds(rows, k, seed=42, bits=4):
    classes = sorted({c for _, c in rows}, key=lambda c: (c is not None, c))
    cut = lambda x: x >> max(x.bit_length() - bits, 0) << max(x.bit_length() - bits, 0)
    totals = [sum(c == x for _, c in rows) for x in classes]
    kinds = {}
    for g in {g for g, _ in rows}:
        kinds.setdefault(tuple(cut(sum(r == (g, c) for r in rows)) for c in classes), []).append(g)
    have, out = [[0] * len(classes) for _ in range(k)], {}
    for v in sorted(kinds, key=lambda v: (sum(v), v), reverse=True):
        groups = sorted(kinds[v], key=lambda g: digest(seed, g))
        full = len(groups) // k * k
        for r, g in enumerate(groups):
            if r < full:
                out[g] = r % k
                continue
            cost = [sum(x * y / t**2 for x, y, t in zip(have[f], v, totals)) for f in range(k)]
            f = min(range(k), key=lambda f: (cost[f], sum(have[f]), f))
            have[f] = [x + y for x, y in zip(have[f], v)]
            out[g] = f
    return out


def mixed_rows(seed=3, groups=60, nulls=True):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for c in rng.sample([0, 1, 2] + ([None] if nulls else []), rng.randint(1, 3)):
            rows += [(f"g{g}", c)] * rng.choice([1, 1, 2, 40])
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_mixed_groups_are_dealt_once(spark, k):
    rows = mixed_rows()
    frame = spark.createDataFrame(rows, "key string, label int")
    got = splits.mixed_group_folds(frame, "key", "label", k).collect()
    assert len(got) == 60 and {r.key: r.fold for r in got} == plain_folds(rows, k)
    assert {tuple(r) for r in splits.mixed_group_folds(frame.repartition(7), "key", "label", k).collect()} == {tuple(r) for r in got}


def test_class_shares_are_even(spark):
    rows = mixed_rows(9, 400, nulls=False)
    fold = {r.key: r.fold for r in splits.mixed_group_folds(spark.createDataFrame(rows, "key string, label int"), "key", "label", 5).collect()}
    for c in (0, 1, 2):
        total = sum(x == c for _, x in rows)
        shares = [sum(x == c and fold[g] == f for g, x in rows) / total for f in range(5)]
        assert max(shares) < 0.3 and min(shares) > 0.1


def test_too_many_class_counts_are_refused(spark):
    frame = spark.createDataFrame(mixed_rows(), "key string, label int")
    with pytest.raises(ValueError, match="bits"):
        splits.mixed_group_folds(frame, "key", "label", 3, most=2)


def test_task_folds_of_mixed_groups_keep_rows_and_leak_nothing(spark):
    """Twelve groups of two classes: 48 rows in, 48 out, each group in one fold."""
    rows = [(f"g{g}", float(c), i) for g in range(12) for c in (g % 3, (g + 1) % 3) for i in range(2)]
    dealt, k = models.task_folds(spark.createDataFrame(rows, "key string, label double, i int"), "key", "label")
    assert dealt.count() == 48 and dealt.select("key", "fold").distinct().count() == 12
    member = splits.fold_membership(dealt.select("key", "i").withColumn("i", F.col("i")), dealt.select("key", "fold").distinct(), "key", k)
    assert splits.leaked_groups(member, "key").count() == 0


def test_plan_keeps_the_labels_of_mixed_points(spark):
    rows = [(f"g{g}", (g + (g % 2) * (s % 2)) % 3, m, s, 1.0) for g in range(12) for m in ("a", "b") for s in range(4)]
    frame = spark.createDataFrame(rows, "group_id string, label int, modality string, segment_index int, x double")
    spans = spark.createDataFrame([(f"g{g}", m, 4.0) for g in range(12) for m in ("a", "b")], "group_id string, modality string, duration_s double")
    made = benchmark.plan(frame, spans, ["a", "b"], 1.0, 0.0, k=3)
    assert made.rows.count() == len(rows)
    labels = {r.group_id: r.label for r in made.manifest.collect()}
    assert labels["g0"] == 0 and labels["g1"] is None
    assert made.rows.select("group_id", "fold").distinct().count() == 12
    assert {(r.group_id, r.label) for r in made.rows.select("group_id", "label").distinct().collect()} == {(r[0], r[1]) for r in rows}
