"""Periodic runs, exact dedup and hard negatives against plain versions."""

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from waveledger.llm import exact_dedup, hard_negatives, periodic_runs  # noqa: E402


# ---- periodic runs

def word_rows(rng):
    """Words with runs of many periods, of few words or of one."""
    kind, n = rng.randint(0, 4), rng.randint(0, 260)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    words = []
    while len(words) < n:
        part = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
        words += part * rng.randint(1, 9) + [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 4))]
    return words


def test_solver_finds_all_runs():
    rng = random.Random(2)
    for _ in range(400):
        words = word_rows(rng)
        numbers = np.array([hash(w) % 10**9 for w in words], np.int64)
        got = sorted((x, y - x, q) for q, x, y in periodic_runs.solve(numbers, len(words)) if y - x >= 6)
        assert got == plain.runs(words)


def test_z_function():
    rng = random.Random(4)
    for _ in range(50):
        s = [rng.randint(0, 2) for _ in range(40)]
        want = [0] + [next((k for k in range(40 - i) if s[k] != s[i + k]), 40 - i) for i in range(1, 40)]
        assert periodic_runs.z_function(s) == want


def run_rows(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id long")
    return [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed)
            for r in periodic_runs.periodic_runs(docs, **options).collect()]


def run_docs():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a\x0ba\x0ca\ra\na a  a", "é é é é é é x", "a a " * 30]
    texts += [" ".join(word_rows(rng)) for _ in range(40)]
    long = [f"x{rng.randint(0, 10**6)}" for _ in range(3000)]
    long[400:400 + 5 * 330] = long[400:730] * 5
    long[2500:2900] = ["same"] * 400
    texts += [" ".join(long), " ".join(["all"] * 2000), " ".join(long), "x y " * 900]
    return [(k * 3 if k % 11 else None, t, "clash", k) for k, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [1 << 15, 256])
def test_runs(spark, monkeypatch, chunk):
    """Also with documents that are dealt out in chunks."""
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    rows = run_docs()
    got = run_rows(spark, rows + rows[5:8])
    want = []
    for i, text, _, _ in rows + rows[5:8]:
        words = plain.WORD.findall(text or "")
        found = plain.runs(words)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(words), found, " ".join(w for k, w in enumerate(words) if k not in gone)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    if chunk == 256:
        more = run_rows(spark, rows, copies=7, least=20)
        assert {r[3] for r in more if r[2]} and all(n >= max(20, 7 * q) for r in more for _, n, q in r[2])
        want = {(r[0], tuple(r[2])): plain.runs(plain.WORD.findall(t or ""), 7, 20) for r, (_, t, _, _) in zip(
            sorted(more, key=order), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True) if r[0] is not None}
        assert all(list(k[1]) == v for k, v in want.items())


def test_runs_of_nothing(spark):
    assert run_rows(spark, []) == []
    with pytest.raises(ValueError):
        run_rows(spark, [], copies=2)


# ---- exact dedup

def marks(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, keep long, rows string")
    return docs, [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
                  for r in exact_dedup.mark_copies(docs, **options).collect()]


def copies():
    rng = random.Random(6)
    texts = [None, "", " ", "\t\n", "a b", "a  b", " a b", "a b ", "a b", "A b", "x" * 200_000, "x" * 200_000, "x" * 199_999 + "y"]
    texts += [f"text {rng.randint(0, 20)} \n of many" for _ in range(120)] + ["hot copy"] * 100
    rows = [(k, t, "h", 1, None) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, "a b", "h", 1, None), (None, "only here", "h", 1, None), (30, rows[0][1], "h", 1, None)]
    return rows + [(500, "again", "h", 1, None)] * 2


def equal_texts(rows):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t, *_ in rows:
        least.setdefault(normal(t), []).append(-1 if i is None else i)
    out = []
    for i, t, *_ in rows:
        ids = least[normal(t)]
        keep = min(ids)
        out.append((i, None if keep < 0 else keep, len(ids), (-1 if i is None else i) == keep, plain.sha(normal(t))))
    return out


def ordered(rows):
    return sorted(rows, key=str)


def test_copies(spark):
    rows = copies()
    assert ordered(marks(spark, rows)[1]) == ordered(equal_texts(rows))
    assert marks(spark, [])[1] == []


def test_colliding_hashes_do_not_merge_texts(spark):
    """A hash of few values: bytes part what it puts together."""
    rows = copies()
    few = lambda text: F.char_length(text) % 3
    docs, got = marks(spark, rows, content_hash=few)
    assert ordered(got) == ordered(equal_texts(rows))
    kept = exact_dedup.keep_first(docs, content_hash=few)
    assert kept.columns == docs.columns
    want = {(r[0], r[4]) for r in equal_texts(rows) if r[3]}
    left = [(r.doc_id, plain.sha(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""))) for r in kept.collect()]
    assert len(left) == len(want) and set(left) == want


# ---- hard negatives

def test_curve_visits_neighbours():
    """All cells of a cube in curve order: each step changes one axis by one, and places are unique."""
    for dims, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        keys = hard_negatives.curve_keys(cells, bits)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(keys) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    block, anchors = rng.integers(-300, 300, (40, 16)), rng.integers(-300, 300, (9, 16))
    low, high = hard_negatives.bounds(anchors, block.min(0)[None], block.max(0)[None])
    scores = anchors @ block.T
    assert (low[:, 0] <= scores.min(1)).all() and (high[:, 0] >= scores.max(1)).all()
    # a zone of one point is told exactly but for the slack
    low, high = hard_negatives.bounds(anchors, block[:1], block[:1])
    assert (high - low < 3).all()


def test_products_are_exact():
    a = np.array([[2**31 - 1, -(2**31 - 1)], [3, 4]])
    assert hard_negatives.products(a, a).tolist() == [[2 * (2**31 - 1) ** 2, -(2**31 - 1)], [-(2**31 - 1), 25]]
    big = np.full((1, 8), 2**31 - 1)
    assert hard_negatives.products(big, big).tolist() == [[2**63 - 1]]
    assert hard_negatives.products(np.zeros((2, 0), int), np.zeros((3, 0), int)).shape == (2, 3)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, q string, block long, anchor string")
    got = hard_negatives.hard_negatives(frame, F.expr("vec_id % 10 = 0"), **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


def some_vectors(seed, n, dims, labels=4):
    """Clusters, copies, ties of scores, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for k in range(n):
        v = (centres[rng.integers(6)] + 0.4 * rng.normal(size=dims)).round(1).tolist()
        rows.append([k, int(rng.integers(labels)), v])
    for k in range(0, n, 9):
        rows[k][2] = rows[0][2]
    rows[3][1], rows[4][2], rows[5][2] = None, None, [float("nan"), *rows[5][2][1:]]
    rows[6][2], rows[7][2], rows[8][2] = [None, *rows[6][2][1:]], rows[7][2][:3], []
    rows[20][2] = [0.0] * dims
    rows += [[-10, 1, rows[1][2]], [None, 2, rows[2][2]], [None, 2, rows[2][2]]]
    return [(*r, "clash", 0, None) for r in rows]


def wanted(rows, scale=256, positives=5, negatives=5, low=80, high=100):
    good = [(-1 << 63 if i is None else i, label, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int)) for i, label, v, *_ in rows
            if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (ident, label, v) in enumerate(good):
        if ident % 10 or ident == -1 << 63:
            continue
        scores = sorted((-int(v @ w), i, other) for b, (i, other, w) in enumerate(good) if b != a and len(w) == len(v))
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            hard = [(t, i) for t, i, o in scores if o != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(ident, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hard)]
    return sorted([tuple(None if x == -1 << 63 else x for x in r) for r in out], key=str)


@pytest.mark.parametrize("seed,dims", [(1, 5), (2, 12), (3, 2)])
def test_hard_negatives(spark, monkeypatch, seed, dims):
    """Small blocks, chunks and groups, so that zone maps, merging and several tasks are at work."""
    for name, value in {"BLOCK_ROWS": 8, "SORT_ROWS": 64, "CHUNK": 4, "CHUNKS": 2, "ZONES": 8, "BLOCKS": 4, "SCORES": 64}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_vectors(seed, 300, dims)
    assert mined(spark, rows) == wanted(rows)
    assert mined(spark, rows, positives=2, negatives=3, low_percent=50, high_percent=90) == wanted(rows, 256, 2, 3, 50, 90)


def test_hard_negatives_large_blocks_and_none(spark):
    rows = some_vectors(7, 400, 6, labels=2)
    assert mined(spark, rows) == wanted(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, [1.0], "", 0, None), (10, 1, None, "", 0, None)]) == []
    huge = [(k, k % 2, [float(x) * 3e30 for x in (1, -1, k)], "", 0, None) for k in range(20)]
    assert all(r[4] >= r[5] for r in mined(spark, huge))


def test_few_blocks_are_read(spark, monkeypatch):
    """Well parted clusters: the bounds leave out most blocks."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.choice([-1.0, 1.0], size=(16, 8)) * 3
    rows = [(k, int(rng.integers(2)), (centres[k % 16] + 0.05 * rng.normal(size=8)).tolist(), "", 0, None) for k in range(1600)]
    for name, value in {"CHUNK": 16, "CHUNKS": 1}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    seen = []
    kept = hard_negatives._needed
    monkeypatch.setattr(hard_negatives, "_needed", lambda *a: seen.append(kept(*a)) or seen[-1])
    assert mined(spark, rows) == wanted(rows)
    for need in seen:
        need = need.distinct().collect()
        assert len(need) <= 0.4 * len({r.cgroup for r in need}) * 1600 / 16


def test_digests_of_the_run_query(spark):
    """The query's digests follow from the operator's rows."""
    from waveledger.llm.queries import QUERIES, planted_repeats

    sf = "/root/testdata/sf0.001"
    docs = planted_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    for d in docs:
        words = plain.WORD.findall(d.text or "")
        found = plain.runs(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
