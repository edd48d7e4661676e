"""Host search of pages, texts that share an id, cut-offs that follow the data, and what the classifier learns from."""

import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from waveledger.llm import html_text, line_crf, packing, quality_rules, sharding, suffix_dedup  # noqa: E402


def passage(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


# ---- texts that share an id

def test_many_texts_without_id_lose_no_unique_bytes(spark):
    """Thousands of rows with a null or repeated id; half share a passage, the others share nothing."""
    rng = random.Random(21)
    common = passage(rng, 40)
    rows = []
    for k in range(3000):
        ident = None if k % 3 else 7
        own = f"{k} " + passage(rng, 30)
        rows.append((ident, f"{own} {common} {passage(rng, 5)}" if k % 2 else own))
    cut = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.md5("text")))
    got = {r.name: (r.n_bytes, sum(x.end - x.start for x in r.removed)) for r in cut.collect()}
    import hashlib

    kept_whole = 0
    for k, (_, text) in enumerate(rows):
        n, gone = got[hashlib.md5(text.encode()).hexdigest()]
        assert n == len(text.encode())
        if not k % 2:
            assert gone == 0
        else:
            kept_whole += gone < len(common.encode())
    assert kept_whole == 1  # the passage stays where it is first


def multikey(rng, n):
    return np.array([rng.randint(0, 3) for _ in range(n)], np.uint64)


def test_multikey_quicksort_orders_as_a_sort_does():
    rng = random.Random(3)
    for n in (0, 1, 2, 17, 300):
        group, keys = multikey(rng, n).astype(np.int64), [multikey(rng, n), multikey(rng, n)]
        order, head = suffix_dedup.multikey_quicksort(group, keys)
        rows = list(zip(group.tolist(), keys[0].tolist(), keys[1].tolist(), strict=True))
        got = [rows[i] for i in order]
        assert got == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert head.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(n)]


# ---- host search

def shared_bytes(texts, n):
    """{(doc, tag): bytes that a string of n bytes covers which two texts of the seed have}."""
    owners = {}
    for doc, tag, seed, text in texts:
        data = text.encode()
        for i in range(len(data) - n + 1):
            owners.setdefault((seed, data[i:i + n]), set()).add((doc, tag))
    out = {}
    for doc, tag, seed, text in texts:
        data, marked = text.encode(), set()
        for i in range(len(data) - n + 1):
            if len(owners[seed, data[i:i + n]]) > 1:
                marked.update(range(i, i + n))
        out[doc, tag] = marked
    return out


@pytest.mark.parametrize("crowd", [2000, 3])
def test_shared_spans_equal_a_plain_search(spark, monkeypatch, crowd):
    """Passages inside and across texts, copies, a text that repeats itself, equal ids with different tags."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(8)
    parts = [passage(rng, 14) for _ in range(8)]
    texts = []
    for k in range(60):
        text = "\n".join(rng.choice(parts) if rng.random() < 0.5 else passage(rng, rng.randint(1, 20)) for _ in range(5))
        texts.append((k // 2, k % 2, k % 3, text))
    own = passage(rng, 15)
    texts += [(90, 0, 1, f"{own}\n{own}\n{own}"), (91, 0, 1, texts[4][3]), (92, 0, 2, f"{parts[0]}\n{parts[0]}")]
    frame = spark.createDataFrame(texts, "doc long, tag long, seed long, text string")
    got = {}
    for r in suffix_dedup.repeated_spans(frame, 64, shared=True).collect():
        got.setdefault((r.doc, r.tag), set()).update(range(r.start, r.end))
    assert {k: v for k, v in shared_bytes(texts, 64).items() if v} == got


def page(article, menu="", head=""):
    return f"<html><head><title>t</title></head><body><nav>{menu}</nav>{head}<article>{article}</article></body></html>"


def test_unlabelled_boilerplate_inside_articles_goes(spark):
    """An advert that most articles of a host carry goes; a passage that a few share, and copies, stay."""
    rng = random.Random(9)
    advert = "Buy the finest lamps of the town today, they are cheap and bright and cheap. " + passage(rng, 8)
    quoted, copied = passage(rng, 30), [passage(rng, 30) for _ in range(4)]
    rows, want = [], {}
    for k in range(30):
        paragraphs = [f"{passage(rng, 25)} {k}" for _ in range(4)]
        if k < 6:
            paragraphs[1] = quoted
        told = list(paragraphs)
        if k % 5:
            paragraphs.insert(k % 4, advert)
        rows.append((k, f"http://one.example.org/{k}", page("".join(f"<p>{p}</p>" for p in paragraphs))))
        want[k] = " ".join(told)
    # a host whose articles are near copies of each other, and one with two pages only
    for k in range(30, 40):
        text = [*copied, f"{passage(rng, 12)} {k}"]
        rows.append((k, f"http://two.example.org/{k}", page("".join(f"<p>{p}</p>" for p in text))))
        want[k] = " ".join(text)
    for k in (40, 41):
        rows.append((k, f"http://three.example.org/{k}", page(f"<p>{quoted}</p><p>{k} {copied[0]}</p>")))
        want[k] = f"{quoted} {k} {copied[0]}"
    # twenty copies of one page count as one page
    rows += [(k, "http://four.example.org/", page(f"<p>{quoted}</p><p>{copied[1]}</p>")) for k in range(50, 70)]
    want |= {k: f"{quoted} {copied[1]}" for k in range(50, 70)}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert got == want
    told = html_text.evidence(frame).first()
    assert told.asked_blocks >= 24 and told.pages == 62 and told.article_blocks > 100


def test_open_pages_lose_what_their_host_repeats(spark):
    """Pages without an article: what a plain host search covers goes, word by word."""
    rng = random.Random(10)
    banner = passage(rng, 20)
    rows = [(k, "http://open.example.org/a", f"<div>{banner}</div><p>{passage(rng, 20)} {k}</p>") for k in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    texts = [(i, 0, 0, "\n".join(html_text.article_blocks(html_text.blocks(h))[1])) for i, _, h in rows]
    gone = shared_bytes(texts, html_text.REPEAT)
    for i, _, _, text in texts:
        words, at = [], 0
        for w in text.replace("\n", " ").split(" "):
            size = len(w.encode())
            if not set(range(at, at + size)) <= gone[i, 0]:
                words.append(w)
            at += size + 1
        assert got[i] == " ".join(words) and banner not in got[i]


def test_equal_ids_and_ties(spark):
    """Rows of one id with different html are pages of their own; equal rows have equal texts."""
    html = [page(f"<p>text number {k}</p>") for k in range(4)] + ["", None]
    rows = [(None, "http://h.org/", h) for h in html] + [(1, None, html[0])] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("seed", F.lit("clash"))
    got = sorted((r.page_id or 0, r.text) for r in html_text.main_text(frame).collect())
    assert got == sorted([(0, f"text number {k}") for k in range(4)] + [(0, ""), (0, "")] + [(1, "text number 0")] * 2)


def test_deep_and_long_pages_take_time_in_proportion():
    def seconds(n):
        html = "<div>" * n + "<b>x</b>" * n + "<span class=ad>" * n + "<p>y" * n + "</i>" * n
        begin = time.perf_counter()
        assert html_text.blocks(html)
        return time.perf_counter() - begin

    seconds(500)
    small, large = seconds(4_000), seconds(40_000)  # the larger page has 1.2 MB
    assert large < 40 * small + 0.5 and large < 20


# ---- rules

def rated(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r for r in quality_rules.rate_documents(docs).collect()}


def test_a_source_that_is_junk_for_two_fifths_is_cut(spark):
    rng = random.Random(11)
    clean = lambda k: f"{passage(rng, 60)} {k}"
    junk = lambda k: " ".join(w + rng.choice("#*$%&") * 2 for w in passage(rng, 60).split(" "))
    rows, bad = [], set()
    for s in range(6):
        for k in range(300):
            ident = s * 1000 + k
            spoiled = k % 5 < 2 if s == 0 else k % 50 == 0
            bad |= {ident} if spoiled else set()
            rows.append((ident, junk(k) if spoiled else clean(k), "en", f"s{s}"))
    got = rated(spark, rows)
    assert {i for i, r in got.items() if not r.kept} == bad


def test_cut_offs_follow_the_data(spark):
    """The same texts are kept where they are the rule and go where they stand apart."""
    rng = random.Random(12)
    marked = lambda: " ".join(w + "#" * (i % 2) for i, w in enumerate(passage(rng, 60).split(" ")))
    rows = [(k, marked(), "code", "a") for k in range(400)]
    rows += [(1000 + k, marked() if k % 40 == 0 else f"{passage(rng, 60)} {k}", "en", "a") for k in range(400)]
    got = rated(spark, rows)
    assert all(got[k].kept for k in range(400))
    assert {k for k in range(400) if not got[1000 + k].kept} == {k for k in range(400) if k % 40 == 0}


def test_thinning_tails_are_not_cut(spark):
    """Rates that decay without a gap: nothing is far from the rest."""
    rng = random.Random(13)
    rows = []
    for k in range(1500):
        share = rng.random() ** 4 * 0.5
        rows.append((k, " ".join(w + "#" * (rng.random() < share) for w in passage(rng, 80).split(" ")), "en", None))
    assert all(r.kept for r in rated(spark, rows).values())


# ---- classifier

def test_classifier_learns_from_all_parts_and_one_row_of_an_id(spark):
    assert line_crf.sampled_runs(10, 200, 1) == [(0, 10)]
    for n in (201, 1000, 50_001):
        runs = line_crf.sampled_runs(n, 200, 5)
        assert sum(b - a for a, b in runs) == 200 and all(a < b <= n for a, b in runs)
        assert all(x[1] <= y[0] for x, y in zip(runs, runs[1:])) and runs[-1][0] >= n * 7 // 8
    assert line_crf.sampled_runs(1000, 200, 5) != line_crf.sampled_runs(1000, 200, 6)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    good, bad = "A plain sentence of words stands here.\nAnother one follows it.", "### $$$ %%% |||\n&&& <<< >>> ###"
    docs = [(i, good if i % 2 else bad) for i in ids[:40]]
    labels = spark.createDataFrame([(i, i % 2) for i in ids[:40]], "doc_id long, quality int")
    one = line_crf.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    many = line_crf.train(spark.createDataFrame(docs + [docs[0]] * 10_000, "doc_id long, text string"), labels)
    assert (one.weights == many.weights).all() and (one.moves == many.moves).all()


def test_scores_equal_a_plain_forward_backward(spark):
    """The whole of a score, from the text: all label sequences of short texts are summed up."""
    rng = random.Random(14)
    texts = ["", None, "one line", *("\n".join(passage(rng, rng.randint(0, 6)) + rng.choice(["", ".", "##"]) for _ in range(6)) for _ in range(12))]
    weights = np.array([rng.uniform(-1, 1) for _ in range(line_crf.N_FEATURES)])
    moves = np.array([[0.3, -0.2], [-0.5, 0.6]])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in line_crf.score(docs, line_crf.LineField(weights, moves)).collect()}
    for i, text in enumerate(texts):
        x, length, _ = line_crf.line_features([text or ""])
        own, n = x @ weights, len(x)
        total, good = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            p = np.exp(sum(s for s, v in zip(own, y, strict=True) if v) + sum(moves[u, v] for u, v in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        assert n == (text or "").count("\n") + 1
        assert got[i] == pytest.approx(float((good / total) @ (length + 1.0) / (length + 1.0).sum()))


# ---- shards, repeat counts

def test_shards_equal_a_plain_rank_and_cut(spark):
    rng = random.Random(15)
    rows = [(k, passage(rng, 3), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.shard_documents(docs, shards=24).collect()
    source = {k: s for k, _, s in rows}
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    totals = {s: sum(v == s for v in source.values()) for s in set(source.values())}
    for s, total in totals.items():
        # a plain cut of ranks: every shard has its share of each source, up to a row at each edge
        for shard in range(24):
            have = sum(source[r.doc_id] == s for r in got if r.shard == shard)
            assert abs(have - total * sizes[shard] / len(rows)) <= 2
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))


def test_nnls_says_when_it_stops_early():
    rng = np.random.default_rng(5)
    a, b = rng.random((30, 60)), rng.random(30) * 9
    with pytest.raises(RuntimeError):
        packing.nnls(a, b, 1)
    x = packing.nnls(a, b, 1000)
    assert (x >= 0).all() and (a.T @ (b - a @ x)).max() < 1e-5


def test_the_search_sees_whole_articles(spark):
    """A passage of another page's article is shared text of the host, whether or not it could be voted out there."""
    passage = "the turbine was opened in spring and its bearings were measured by three crews in turn"
    own = "what this page alone says about the weather on the coast in the second week of march"
    rows = [(1, "http://h.example/a", f"<article><p>{passage}</p><p>an ending of its own for the first page</p></article>"),
            (2, "http://h.example/b", f"<body><p>{passage}</p><p>{own}</p></body>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got[1] == f"{passage} an ending of its own for the first page"
    assert got[2].endswith(own) and "turbine was opened" not in got[2]
