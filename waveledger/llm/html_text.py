"""Main text of web pages: repeated substrings of a host are boilerplate, markup settles the rest.

The token streams of a host's pages are searched for long substrings that distinct pages share.
A block that such substrings cover is boilerplate: outside articles if two pages share it, inside
an article only if that part of it stands in the articles of at least half of the host's pages,
as two articles may quote the same passage. Of the unique blocks markup tells which are text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from waveledger.llm.shared import checked, id_or_least, text_or_empty
from waveledger.llm.suffix_dedup import least_grams, merged, repeated_spans, text_tags
from waveledger.sources.tables import staged

#: Bytes from which a substring that pages of one host share counts as boilerplate.
REPEAT = 64
#: A block inside an article is boilerplate if it is in the articles of so many distinct pages of the
#: host, and of this share of them, and repeated substrings cover this share of it.
MIN_PAGES, PAGES_SHARE, COVER = 3, 0.5, 0.8
#: Blocks of a page whose least grams are taken together, in bytes.
GRAM_BYTES = 1 << 18

#: Elements whose content is no text, and those that are not part of an article.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
CHROME = frozenset("head nav aside footer form menu dialog select button svg math object audio video canvas "
                   "fieldset datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark what is not the article; HEADS do so outside articles only.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
                  "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
                  "subscription paywall sidebar menu navbar nav navigation breadcrumb breadcrumbs footer comment comments "
                  "commentlist disqus respond reply replies share sharing social related recommended widget toolbar login "
                  "signup signin register search searchbox pagination pager complementary contentinfo skip skiplink "
                  "copyright legal disclaimer form".split())
HEADS = frozenset("header masthead topbar".split())
BODY = re.compile(r"\b(?:article-?body|post-?(?:content|body)|entry-?content|story-?body|main-?content)\b", re.I)
#: Elements that are left alone whatever their class says.
NEVER = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = re.compile(r"class|id\s*=|role|hidden|style|itemprop", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _naming(attributes: str) -> tuple[str, bool]:
    """The names an element gives itself, in lower case, and whether it is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role", "itemprop"):
            names.append(value)
        hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (
            key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
    return " ".join(names), hidden


ARTICLE, MAIN, CHROME_ZONE, OPEN = range(4)


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page, in order; white space is one space, empty blocks are left out.

    Unclosed elements end with the element around them, an unclosed tag at the end is dropped.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, zones around it: chrome depth, article, main
    opened: Counter[str] = Counter()  # how many elements of a name are open
    outer: list[int] = []  # places in the stack of elements that are not inline
    chrome, article, main = 0, False, False
    at, n = 0, len(html)

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                zone = CHROME_ZONE if chrome else ARTICLE if article else MAIN if main else OPEN
                out.append((zone, words))

    def close(k: int) -> None:
        nonlocal chrome, article, main
        flush()
        _, chrome, article, main = stack[k]
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        while outer and outer[-1] >= k:
            outer.pop()

    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            piece = html[at:end]
            text.append(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name not in INLINE:
                flush()
            if opened[name] > 0:  # what is passed on the way is closed as well, so no element is passed twice
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name not in INLINE:
            flush()
            inner = stack[outer[-1]][0] if outer else ""
            if inner == "p" or inner in CLOSES.get(name, ()):
                close(outer[-1])
        if name in RAW:
            found = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(html, at)
            at = found.end() if found else n
            continue
        attributes = m[3] if m[2] else m[6]
        names, hidden = _naming(attributes) if attributes and _NAMING.search(attributes) else ("", False)
        if name in VOID or (attributes and attributes.rstrip().endswith("/") and name in ("svg", "path")):
            continue
        words = set(_WORD.findall(names)) if names else frozenset()
        inside = article or main
        off = name in CHROME or hidden or (name == "header" and not inside) or (name not in NEVER and (
            bool(words & HINTS) or (not inside and bool(words & HEADS)))) or (
            name == "article" and bool(words & {"comment", "comments", "ad", "sponsored", "related"}))
        if name in INLINE and not off:
            continue  # says nothing about zones; its end tag finds nothing to close
        opened[name] += 1
        if name not in INLINE:
            outer.append(len(stack))
        stack.append((name, chrome, article, main))
        if off:
            if name in INLINE:
                flush()
            chrome += 1
        elif not chrome:
            article |= name == "article" or (bool(names) and BODY.search(names) is not None)
            main |= name == "main" or "main" in names.split()
    flush()
    return out


def article_blocks(found: list[tuple[int, str]]) -> tuple[list[str], list[str], list[str]]:
    """(article blocks, blocks that markup leaves open, blocks of the page's frame).

    With an article (or else a main part) everything outside belongs to the frame.
    """
    for zone in (ARTICLE, MAIN):
        if any(z == zone for z, _ in found):
            return [t for z, t in found if z == zone], [], [t for z, t in found if z != zone]
    return [], [t for z, t in found if z == OPEN], [t for z, t in found if z != OPEN]


def uncovered(block: str, runs: list[tuple[int, int]], offset: int) -> str:
    """What is left of a block when the words that runs of bytes cover whole are taken out."""
    data = block.encode()
    kept, at = [], offset
    for word in data.split(b" "):
        if not any(a <= at and at + len(word) <= b for a, b in runs if a < at + len(word) and b > at):
            kept.append(word.decode())
        at += len(word) + 1
    return " ".join(kept)


def host(url: Column) -> Column:
    """Lower-case host without user, port and www; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))),
                            r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)


def _grams(pages: list[list[str]]) -> list[list[list[int]]]:
    """For each block of each page its least grams, none if it is shorter than a repeat."""
    out: list[list[list[int]]] = [[[] for _ in page] for page in pages]
    todo, places, size = [], [], 0

    def flush() -> None:
        nonlocal size
        for (p, b), grams in zip(places, least_grams(todo), strict=True):
            out[p][b] = grams
        todo.clear()
        places.clear()
        size = 0

    for p, page in enumerate(pages):
        for b, block in enumerate(page):
            data = block.encode()
            if len(data) >= REPEAT:
                todo.append(data)
                places.append((p, b))
                size += len(data)
                if size > GRAM_BYTES:
                    flush()
    flush()
    return out


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """row, doc, tag, seed (names the host), name (of the content), article, open and frame (blocks), grams (of article blocks)."""
    blank = text_or_empty(html_col)
    site = host(F.col(url_col).cast("string"))
    rows = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("row"),
                        id_or_least(id_col).alias("doc"), text_tags(pages, id_col, blank).alias("tag"),
                        # a page without host shares it with no other
                        F.when(site != "", F.xxhash64(site)).otherwise(F.xxhash64(F.col(id_col).cast("string"), blank)).alias("seed"),
                        F.xxhash64(blank).alias("name"), blank.alias("html"))
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, strings) for c in ("article", "open", "frame")),
                           T.StructField("grams", T.ArrayType(T.ArrayType(T.LongType())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [article_blocks(blocks(h.as_py())) for h in batch.column(5)]
            kind = pa.list_(pa.string())
            grams = pa.array(_grams([a for a, _, _ in parts]), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array([p[k] for p in parts], kind) for k in range(3)), grams], schema.names)

    return rows.mapInArrow(work, schema)


def _popular(parsed: DataFrame) -> DataFrame:
    """seed, popular: the grams that stand in the articles of many distinct pages of a host.

    Pages of equal content count once. A host's list is short: each of its grams is on half of
    the pages, and a page has two for each block.
    """
    sizes = parsed.groupBy("seed").agg(F.count_distinct("name").alias("pages"))
    votes = (parsed.select("seed", "name", F.explode(F.flatten("grams")).alias("gram"))
             .groupBy("seed", "gram").agg(F.count_distinct("name").alias("n")).filter(F.col("n") >= MIN_PAGES))
    return (votes.join(sizes, "seed").filter(F.col("n") >= F.col("pages") * PAGES_SHARE)
            .groupBy("seed").agg(F.collect_list("gram").alias("popular")))


def _with_candidates(parsed: DataFrame) -> DataFrame:
    """Add asked: places of the article blocks that hold a gram which is popular on their host."""
    popular = staged(_popular(parsed), "popular")
    asked = F.transform("grams", lambda g, i: F.when(F.arrays_overlap(g, "popular"), i))
    return (parsed.join(popular, "seed", "left")
            .withColumn("asked", F.when(F.col("popular").isNull(), F.expr("cast(array() as array<int>)"))
                        .otherwise(F.filter(asked, lambda i: i.isNotNull()))).drop("popular"))


def _streams(marked: DataFrame) -> DataFrame:
    """doc, tag, seed, text: the whole token stream of a page, block by block."""
    return marked.select("doc", "tag", "seed", F.array_join(F.concat("open", "article", "frame"), "\n").alias("text"))


def _covered(runs: list[tuple[int, int]], start: int, end: int) -> int:
    return sum(max(min(b, end) - max(a, start), 0) for a, b in runs)


def voted_out(article: list[str], asked: list[int], runs: list[tuple[int, int]], at: int) -> set[int]:
    """Of the candidates among the blocks, which lie end to end from `at` on: those that repeated substrings cover.

    An article that would lose more than half of its bytes is a copy of another: nothing goes.
    """
    gone, lost, total, wanted = set(), 0, 0, set(asked)
    for i, block in enumerate(article):
        size = len(block.encode())
        if i in wanted and _covered(runs, at, at + size) >= COVER * size:
            gone.add(i)
            lost += size
        total += size
        at += size + 1
    return gone if 2 * lost <= total else set()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              repeat: int = REPEAT) -> DataFrame:
    """page_id, url, text, n_chars: one row per page.

    The token streams of a host's pages are searched for substrings of `repeat` bytes or more
    that two pages share. Blocks in the article are boilerplate if they stand in the articles of
    MIN_PAGES pages and PAGES_SHARE of the host's pages with different content, and such
    substrings cover them; not if the article would lose more than half of its text. Of pages
    without an article or main element the words that are covered go. What is unique is kept
    if markup allows: scripts, styles, navigation, forms, asides, footers, and elements whose
    class, id or role names an advert, notice, menu or comments are no article text, nor is
    what lies outside an article or main element where there is one.

    A null or empty page has an empty text. Pages of equal rows have equal texts. A null url has
    no host, and pages without host are not compared. A page that repeats in several rows under
    one id counts as one page where its html is equal.
    """
    checked(pages, id_col, url_col, html_col)
    marked = _with_candidates(staged(_parsed(pages, id_col, url_col, html_col), "pages"))
    asks = (F.size("open") > 0) | (F.size("asked") > 0)
    settled = marked.filter(~asks).select("row", F.array_join("article", " ").alias("text"))
    spans = repeated_spans(_streams(marked).filter("text <> ''"), repeat, shared=True)
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    asked = marked.filter(asks).join(spans, ["doc", "tag"], "left").select("row", "article", "open", "asked", "found")
    schema = T.StructType([marked.schema["row"], T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for article, open_blocks, asked, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), batch.column(4), strict=True):
                runs = []
                if found.is_valid and len(found.values):
                    flat = found.values.flatten()
                    runs = merged(flat[0].to_numpy(), flat[1].to_numpy())
                kept, at = [], 0
                for b in open_blocks:
                    size = len(b.encode())
                    near = [r for r in runs if r[0] < at + size and r[1] > at]
                    kept.append(uncovered(b, near, at) if near else b)
                    at += size + 1
                gone = voted_out(article, asked, runs, at)
                kept += [b for i, b in enumerate(article) if i not in gone]
                texts.append(" ".join(k for k in kept if k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    out = settled.union(asked.mapInArrow(work, schema))
    return out.select("row.*", "text", F.char_length("text").cast("long").alias("n_chars"))


def evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             repeat: int = REPEAT) -> DataFrame:
    """pages, frame_bytes, covered_bytes, article_blocks, asked_blocks: what the host search tells, in one row.

    `covered_bytes` is how much of the blocks outside articles the search finds without markup.
    """
    checked(pages, id_col, url_col, html_col)
    marked = _with_candidates(staged(_parsed(pages, id_col, url_col, html_col), "pages"))
    spans = repeated_spans(_streams(marked).filter("text <> ''"), repeat, shared=True)
    order = Window.partitionBy("doc", "tag").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    frame = F.octet_length(F.array_join(F.concat("open", "frame"), "\n"))
    # the article lies between the open blocks and the frame, with a byte after every block
    ends = [F.aggregate(b, F.lit(0), lambda n, t: n + F.octet_length(t) + 1) for b in ("open", F.concat("open", "article"))]
    places = marked.select("doc", "tag", ends[0].alias("first"), ends[1].alias("last")).distinct()
    start = F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0)))
    inside = F.greatest(F.least("end", "last") - F.greatest("fresh", "first"), F.lit(0))
    fresh = spans.distinct().select("doc", "tag", "end", start.alias("fresh")).where("end > fresh").join(places, ["doc", "tag"])
    covered = fresh.select((F.col("end") - F.col("fresh") - inside).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered_bytes"))
    totals = marked.agg(F.count(F.lit(1)).alias("pages"), F.sum(frame).alias("frame_bytes"), F.sum(F.size("article")).alias("article_blocks"),
                        F.sum(F.size("asked")).alias("asked_blocks"))
    one = F.lit(1).alias("one")
    return totals.select("*", one).join(covered.select("*", one), "one").select("pages", "frame_bytes", "covered_bytes", "article_blocks", "asked_blocks")
