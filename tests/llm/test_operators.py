"""Each corpus operator against a plain version, on small and awkward inputs."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from waveledger.llm import (  # noqa: E402
    bpe, cover_tree, exact_dedup, html_text, line_crf, line_dedup, packing, periodic_runs, quality_rules, sharding, shared,
    simhash, suffix_dedup)
from waveledger.llm.queries import QUERIES, vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and long texts, copies, near copies, shared passages, ties, odd characters."""
    rng = random.Random(3)
    shared_part = passage(rng, 60)
    base = passage(rng, 300)
    texts = [None, "", " \n\t", "a", "a b", "one two three", base, base, base + " end", "x " + base]
    texts += [passage(rng, 40) + " " + shared_part + " " + passage(rng, 40) for _ in range(12)]
    texts += ["a" * 500, "a" * 350, "ab" * 200, "é" * 150, "\U0001f600" * 80, "z" * 99, "q" * 100, "q" * 100]
    texts += [passage(rng, 12000), "\n".join([shared_part, "mid", base[:200], "tail"] * 3)]
    texts += ["\n".join(["first line", "second line", "third line", f"own {k}", "", "first line"]) for k in range(4)]
    texts += [base.replace("a", "A"), "<|endoftext|> x <|startoftext|> 'S I'LL ΑΣ a b a\x1cb"]
    rows = [(k * 7 + 1, t, ["en", None, "de"][k % 3], ["s0", None][k % 2]) for k, t in enumerate(texts)]
    rows[3] = (None, *rows[3][1:])
    return rows


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    got = {r.node: r.root for r in shared.components(frame(spark, pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: c for n, c in plain.classes({x for p in pairs for x in p}, pairs).items() if n in linked}
    assert shared.components(frame(spark, [], "a long, b long")).count() == 0


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(shared, "RANK_ROWS", 16)
    rows = spark.range(500).selectExpr("id", "id % 3 AS g", "xxhash64(id) AS h")
    got = shared.ranked(rows, ["g"], "h", ["id"], 500, "r", "n").collect()
    for g in range(3):
        mine = sorted((r.h, r.r) for r in got if r.g == g)
        assert [r for _, r in mine] == list(range(len(mine))) and {r.n for r in got if r.g == g} == {len(mine)}


# --- suffix dedup

def check_substrings(spark, rows):
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(frame(spark, rows)).collect()}
    for doc, (kept, removed, runs) in plain.substrings([r[:2] for r in rows]).items():
        r = got[doc]
        assert bytes(r.kept) == kept and len(r.removed) == runs and sum(x.end - x.start for x in r.removed) == removed
    assert len(got) == len(rows)


def test_substrings(spark, awkward):
    check_substrings(spark, awkward)


def test_substrings_of_few_letters(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 130))) for _ in range(10)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), None, None) for k in range(40)]
    check_substrings(spark, rows)


def test_substrings_split_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    rng = random.Random(9)
    line = passage(rng, 18)[:88]
    same = passage(rng, 60)
    rows = [(k, passage(rng, 8)[: rng.randint(5, 40)] + line + rng.choice("uvw") * 9 + passage(rng, 8) + same, None, None)
            for k in range(40)]
    check_substrings(spark, rows)


@pytest.mark.parametrize("together", [False, True])
def test_crowded_strings_are_reduced_before_they_travel(together):
    """A passage in different surroundings: a key has one row of each batch (with `shared`, two)."""
    rng = random.Random(14)
    middle = passage(rng, 60).encode()[:104].decode(errors="ignore")
    texts = [passage(rng, 12) + middle + passage(rng, 12) for _ in range(60)]
    parts = [pa.RecordBatch.from_pydict({"doc": [*ids], "tag": [0] * 20, "text": [texts[k] for k in ids], "wanted": [[
        {"key": key, "place": place, "crowded": True} for key, _, doc, _, place in rows if doc == k] for k in ids]})
        for ids in (range(40, 60), range(20), range(20, 40)) for rows in [records(texts, ids)]]
    make = suffix_dedup._slices(100, together)[0]
    slices = [pa.Table.from_batches(make(iter([p]))) for p in parts]
    assert all(max(Counter(t["key"].to_pylist()).values()) <= 1 + together for t in slices)
    merged = pa.concat_tables(slices).sort_by([(c, "ascending") for c in ("key", "far", "doc", "anchor", "tag")])
    spans = {}
    for batch in suffix_dedup._sorted_repeats(100, together)[0](merged.to_batches(max_chunksize=7)):
        for r in batch.to_pylist():
            spans.setdefault(r["doc"], set()).update(range(r["start"], r["end"]))
    want = {}
    seen = Counter(s for t in texts for s in {t.encode()[a:a + 100] for a in range(len(t.encode()) - 99)})
    first = set()
    for k, t in enumerate(texts):
        data = t.encode()
        for a in range(len(data) - 99):
            s = data[a:a + 100]
            if seen[s] > 1 and together or s in first:
                want.setdefault(k, set()).update(range(a, a + 100))
            first.add(s)
    assert spans == want and len(want) == 59 + together


def records(texts, ids):
    """All pieces of the texts, as (key, piece, doc, place)."""
    batch = pa.RecordBatch.from_pydict({"doc": [*ids], "tag": [0] * len(ids), "seed": [0] * len(ids),
                                        "text": [texts[k] for k in ids]})
    return [tuple(r.values()) for b in suffix_dedup._records(100, True)[0](iter([batch])) for r in b.to_pylist()]


def test_repeated_rows_are_one_document(spark):
    text = "abcdefghij" * 5 + "".join(map(chr, range(200, 290)))
    rows = frame(spark, [(5, text), (5, text), (9, text)], "doc_id long, text string")
    got = suffix_dedup.dedup_substrings(rows).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(5, 230), (5, 230), (9, 0)]


def test_suffix_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    strings += [b"ab" * 20 + s for s in strings[:100]]
    group = np.array([k % 3 for k in range(len(strings))])
    order, common = suffix_dedup.sort_suffixes(group, strings, 0)
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], s) for i, s in enumerate(strings))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == (same if group[order[k - 1]] == group[order[k]] else -1)


# --- embeddings

def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(160):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((len(rows) * 3, int(k % 3), (centre + 0.12 * rng.normal(size=8)).tolist()))
    rows += [(9001, 1, rows[0][2]), (9002, 0, [2 * x for x in rows[0][2]]), (9003, 0, rows[0][2]), (9004, 0, [0.0] * 8),
             (9005, 0, None), (9006, None, rows[0][2]), (9007, 0, [float("nan")] * 8), (9008, 0, [None] * 8),
             (9009, 0, []), (9010, 0, [float("inf")] + [1.0] * 7), (9011, 0, [1.0, 2.0]), (9012, 0, [1.0, 2.0]),
             (9013, 0, [1e300] * 8), (9014, 0, [1e-300] * 8)]
    got = cover_tree.near_vectors(frame(spark, rows, "vec_id long, label int, embedding array<double>")).collect()
    want = plain.vectors([r for r in rows if r[0] < 9013])
    huge = {r.vec_id: r for r in got if r.vec_id >= 9013}
    assert huge[9013].component_id == huge[9014].component_id and huge[9013].n_links >= 1
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id < 9013} == {
        i: (n, c, i == c) for i, (n, c) in want.items()}


def test_vectors_over_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "NODE", 16)
    monkeypatch.setattr(cover_tree, "CHUNK", 50)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 6))
    rows = [(k, 0, (centre[k % 40] + 0.1 * rng.normal(size=6)).tolist()) for k in range(400)]
    got = cover_tree.near_vectors(frame(spark, rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain.vectors(rows)


def test_vectors_copied_across_labels(spark, monkeypatch):
    """Copies under several labels are upper nodes of each; labels stay apart."""
    monkeypatch.setattr(cover_tree, "NODE", 8)
    monkeypatch.setattr(cover_tree, "CHUNK", 50)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(30, 6))
    copied = [(centre[k % 30] + 0.1 * rng.normal(size=6)).tolist() for k in range(150)]
    rows = [(1000 * label + k, label, v) for label in range(3) for k, v in enumerate(copied)]
    rows += [(9000 + k, 1, (centre[k % 30] + 0.1 * rng.normal(size=6)).tolist()) for k in range(60)]
    got = cover_tree.near_vectors(frame(spark, rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain.vectors(rows)


def test_cover_tree_covers():
    x = np.random.default_rng(6).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.CoverTree(x)

    def below(node):
        if not tree.children[node]:
            return [tree.centre[node]]
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in kids)
        points = [p for c in kids for p in below(c)]
        assert max(np.linalg.norm(x[points] - x[tree.centre[node]], axis=1)) <= tree.radius[node] + 1e-7
        return points

    assert sorted(below(0)) == list(range(300))


# --- tokens

def check_pieces(rows, got):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(rows)
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[row[0]], key=lambda r: r.start):
            piece = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(r.length for r in got) / (4096 * len(by_sequence))


def test_packing(spark, awkward):
    check_pieces(awkward, packing.pack_documents(frame(spark, awkward), vocabulary("word_bpe_49k.json")).collect())


def test_packing_fills(spark):
    docs = shared.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_pieces(rows, QUERIES["op3_packing"](spark, SF).collect()) > 0.95


def test_nnls_and_plan():
    rng = np.random.default_rng(0)
    a = rng.random((12, 20))
    x = packing.nnls(a, b := rng.random(12) * 3, 200)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-5 and abs(gradient[x > 1e-9]).max() < 1e-5
    histogram = {int(c): int(rng.integers(1, 900)) for c in rng.integers(1, 257, 90) * 16}
    plan = packing.plan(histogram)
    used = {}
    for sizes, times in plan:
        assert sum(sizes) <= 4096 and times > 0
        for c in sizes:
            used[c] = used.get(c, 0) + times
    assert used == histogram and packing.plan({}) == []


def test_bpe(spark, awkward):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    encoded = bpe.encode(frame(spark, awkward), path, decoded_col="back")
    got = bpe.decode(encoded, path).collect()
    assert len(got) == len(awkward)
    for r in got:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == r.back == tokenizer.decode(ids, skip_special_tokens=False)
    odd = frame(spark, [(1, [50256, 197, 70000, -1]), (2, None), (3, [])], "id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, path).orderBy("id").collect()] == [
        tokenizer.decode([50256, 197], skip_special_tokens=False), "", ""]


# --- pages

def test_pages(spark):
    rng = random.Random(5)
    notice = passage(rng, 25)
    own = [passage(rng, 30) for _ in range(3)]
    rows = [
        (1, "http://a.org/1", "<html><head><title>T</title></head><body><header>top</header><nav><a>menu</a></nav><article>"
         "<header><h1>Head</h1></header><p class=lead>One <b>t</b>wo&amp;three<br>four<div class='ad box'>buy</div>"
         "<p>five<script>var a='</p>'</script></p><ul><li>six<li>seven</ul><form>f<input></form></article>"
         "<section class=comments>c</section><footer>foot</footer>"),
        (2, None, None), (3, "", ""), (None, "x", "plain &lt;text&gt; &copy; only"),
        (4, "http://www.b.org/1", f"<div><p>{own[0]}</p><p>{notice}</p></div>"),
        (5, "https://B.org/2", f"<p>{notice}</p><p>{own[1]}</p>"),
        (6, "https://c.org/2", f"<p>{notice}</p><p>{own[2]}</p><!-- x --><div hidden>h</div><img alt=q <unfinished"),
        (7, "http://d.org", "<main><p>m<aside>side</aside><svg><text>s</text></svg>n</main><p>out</p>"),
    ]
    got = {r.page_id: r for r in html_text.main_text(
        frame(spark, [(*r, 0) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == "Head One two&three four five six seven"
    assert got[2].text == got[3].text == "" and got[None].text == "plain <text> © only"
    assert got[4].text == own[0] and got[5].text == own[1] and got[6].text == f"{notice} {own[2]}"
    assert got[7].text == "m n" and all(r.n_chars == len(r.text) for r in got.values())


# --- shards

def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 64)
    monkeypatch.setattr(shared, "RANK_ROWS", 64)
    rows = [(k, f"text é {k % 50}", None, "hot" if k % 3 == 0 else f"s{k % 7}" if k % 11 else None) for k in range(1000)]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
        text = f"text é {r.doc_id % 50}".encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.grown_shard is None and r.law == "rows"
    assert sorted(per) == list(range(24)) and {len(x) for x in per.values()} == {41, 42}
    for mine in per.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    for source in {r.source for r in got}:
        share = [sum(r.source == source for r in x) for x in per.values()]
        assert max(share) - min(share) <= 4
    again = sharding.shard_documents(frame(spark, rows[::-1])).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


# --- quality

def test_counts(spark, awkward):
    got = {r.doc_id: r for r in quality_rules.rate_documents(frame(spark, awkward)).collect()}
    for doc, text, *_ in awkward:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_drop_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (shared.table(spark, sf, t) for t in ("documents", "labels"))
    rated = quality_rules.rate_documents(docs).join(labels, "doc_id").filter("not base_failed").collect()
    bad, good = ([r for r in rated if r.quality == q] for q in (0, 1))
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality_rules.rate_documents(docs).filter("kept").collect()}


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (shared.table(spark, sf, t) for t in ("documents", "labels"))
    got = line_crf.classify(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
    away = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in away) >= 0.95 * len(away) and 0 <= min(r.score for r in got)


def test_classifier_ignores_held_out_labels(spark):
    docs, labels = (shared.table(spark, SF, t) for t in ("documents", "labels"))
    turned = labels.withColumn("quality", line_crf.F.when(line_crf.held_out(), 1 - line_crf.F.col("quality"))
                               .otherwise(line_crf.F.col("quality")))
    a, b = (line_crf.train(docs, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()


def test_forward_backward():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 4, 9])
    score, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    field = line_crf.LineField(np.array([1.0]), moves)
    got = line_crf.good_lines(score[:, None], first, field)
    for a, b in zip(first, first[1:]):
        n, weight, total = b - a, np.zeros(b - a), 0.0
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            p = np.exp(sum(s for s, v in zip(score[a:b], y) if v) + sum(moves[u, v] for u, v in zip(y, y[1:])))
            total += p
            weight += p * np.array(y)
        assert np.allclose(got[a:b], weight / total)


# --- near copies and lines

def test_simhash(spark, awkward):
    rows = [r for r in awkward if r[0] is not None]
    rng = random.Random(11)
    base = passage(rng, 900).split()
    for k in range(30):
        words = list(base)
        words[rng.randrange(900)] = f"w{k}"
        rows.append((1000 + k, " ".join(words), None, None))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain.near_documents([r[:2] for r in rows])
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == [
        "doc_id", "text", "lang", "source"]


def test_missing_and_repeated_ids_link_nothing(spark):
    rng = random.Random(13)
    texts = [passage(rng, 60) for _ in range(6)]
    prints = [plain.simhash(t) for t in texts]
    assert min((a ^ b).bit_count() for k, a in enumerate(prints) for b in prints[:k]) > simhash.DISTANCE
    ids = [(None, 0), (12, 0), (None, 1), (77, 1), (None, 2), (None, 2), (5, 3), (5, 4), (90, 4), (None, 5)]
    rows = [(i, texts[t], None, None) for i, t in ids]
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    want = {0: 12, 1: 77, 2: None, 3: 5, 4: 5, 5: None}
    assert got == {(i, prints[t]): want[t] for i, t in ids}
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert len(kept) == 6 and {(r.doc_id, r.text) for r in kept} == {(want[t], texts[t]) for t in want}


def test_covering_anchors_lose_no_link(spark):
    rng = random.Random(12)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for n in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame(spark, rows, "fp long, node long")).collect()}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
            if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want


def test_lines(spark, awkward):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, awkward)).collect()}
    for doc, (n, removed, left) in plain.lines([r[:2] for r in awkward]).items():
        r = got[doc]
        assert (r.n_lines, r.n_removed_lines, r.text or "") == (n, removed, left)
    assert got[1].text is None


# --- all of them

OPERATORS = {
    "suffix": lambda d: suffix_dedup.dedup_substrings(d), "cut texts": lambda d: suffix_dedup.deduped_texts(d),
    "packing": lambda d: packing.pack_documents(d, vocabulary("word_bpe_49k.json")),
    "pages": lambda d: html_text.main_text(d, "doc_id", "source", "text"),
    "shards": lambda d: sharding.shard_documents(d), "encode": lambda d: bpe.encode(d, vocabulary("byte_bpe_50k.json")),
    "crf": lambda d: line_crf.classify(d, d.selectExpr("doc_id", "cast(null as int) AS quality")),
    "rules": lambda d: quality_rules.rate_documents(d), "keep good": lambda d: quality_rules.keep_good(d),
    "near": lambda d: simhash.near_duplicates(d), "keep one": lambda d: simhash.keep_one(d),
    "lines": lambda d: line_dedup.dedup_lines(d), "runs": lambda d: periodic_runs.periodic_runs(d),
    "copies": lambda d: exact_dedup.mark_copies(d), "keep first": lambda d: exact_dedup.keep_first(d),
}
CLASHING = ("row", "_row", "_id", "_h", "doc", "tag", "kept", "n_lines", "ids", "label", "score", "_text", "key")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_null_and_clashing(spark, name):
    schema = DOCS + "".join(f", {c} string" for c in CLASHING)
    none = frame(spark, [], schema)
    assert OPERATORS[name](none).count() == 0
    nulls = frame(spark, [(None,) * (4 + len(CLASHING))] * 2 + [(1, "a b c", "en", "s") + ("x",) * len(CLASHING)] * 2, schema)
    got = OPERATORS[name](nulls).collect()
    assert len(got) == {"keep good": 0, "keep one": 2, "keep first": 2}.get(name, 4)


def test_vectors_empty_and_null(spark):
    schema = "vec_id long, label int, embedding array<float>, v string, id string, links int"
    assert cover_tree.near_vectors(frame(spark, [], schema)).count() == 0
    got = cover_tree.near_vectors(frame(spark, [(None, 1, [1.0, 0.0], "", "", 1)] * 3 + [(4, 1, [1.0, 0.1], "", "", 1)], schema))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got.collect()) == [
        (0, 3, None), (0, 3, None), (0, 3, None), (4, 3, None)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="doc_id"):
        simhash.near_duplicates(spark.range(3).withColumnRenamed("id", "text"))
