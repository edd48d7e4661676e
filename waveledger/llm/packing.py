"""Packing documents into token sequences: window fillings by non-negative least squares."""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from waveledger.llm.bpe import byte_letters
from waveledger.llm.shared import Recent, checked, id_or_least, ranked, real_id, text_or_empty
from waveledger.sources.tables import staged

#: Tokens of a sequence, and the id that ends a document.
WINDOW = 4096
END = 2
#: Lengths are packed in classes of so many tokens, by their upper end.
STEP = 16
#: Pieces of one enumerated combination.
DEPTH = 3
#: Entries of one generation of a worker's word cache.
CACHE = 400_000
_MARKS = frozenset(".,;:!?")


class WordTokens:
    """Token ids of white-space separated words of a word BPE file of the tokenizers library.

    The file drops white space and lower-cases, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Recent(self._word, CACHE)

    def _letters(self, text: str) -> list[int] | None:
        """Ids of a run of letters: one pre-token, which the model merges; None for other texts."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # a sigma's lower case depends on its neighbours in Python only
            text = text if "Σ" in text else text.lower()
            if not text.isalpha() or "Σ" in text:
                return None
            text = "".join([self.letters[b] for b in text.encode()])
        elif not text.isalpha():
            return None
        return [t.id for t in self.model.tokenize(text)]

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        ids = self._letters(text)
        if ids is None and text[-1] in _MARKS and (ids := self._letters(text[:-1])) is not None:
            ids = ids + [t.id for t in self.model.tokenize(text[-1])]
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids of the whole text."""
        if "<|" in text:  # may hold a special token, whose case matters
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, text.encode().lower().split()))


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """One per Python worker."""
    return WordTokens(path)


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
        end: int = END) -> DataFrame:
    """Pieces of whole documents: id, start, length, ids_crc32, doc_tokens.

    A document's ids (and `end`) are cut into full windows and one shorter rest, so a piece's
    checksum is known at once and texts are read and tokenized a single time.
    """
    checked(docs, id_col, text_col)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tail, step = word_tokens(path), array("I", [end]).tobytes(), 4 * window
        for batch in batches:
            out: list[array] = [array("q") for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode(text.as_py()) + tail
                for at in range(0, len(ids), step):
                    piece = ids[at:at + step]
                    for col, value in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, np.int64)) for c in out], names)

    return docs.select(id_or_least(id_col), text_or_empty(text_col)).mapInArrow(rows, schema)


def combinations(classes: list[int], window: int, slack: int, depth: int) -> list[tuple[int, ...]]:
    """Class sizes, largest first, of up to `depth` pieces that leave less than `slack` of a window."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if chosen and left < slack:
            found.append(chosen)
        elif len(chosen) < depth:
            top = min(left, chosen[-1] if chosen else left)
            # the last piece has to close the window
            low = left - slack if len(chosen) == depth - 1 else 0
            for c in classes:
                if low < c <= top:
                    extend((*chosen, c), left - c)

    extend((), window)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets; more than `rounds` changes of the set are an error.

    Products are formed for active columns only, so memory follows the rows of `a`.
    """
    right = a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    enough = 1e-7 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = 0
        best = int(gradient.argmax())
        if gradient[best] <= enough:
            return x
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            own = a[:, at]
            try:
                s = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(at)), right[at])
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(own, b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            falling = s <= 0
            ratio = np.min(x[at][falling] / np.maximum(x[at][falling] - s[falling], 1e-300))
            x[at] += ratio * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    raise RuntimeError(f"non-negative least squares has not settled after {rounds} rounds")


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = STEP,
         depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(class sizes of a sequence, repeats) that use up a histogram of class sizes.

    Shallow combinations that fill a window are solved for repeat counts by least squares and
    rounded down; what is left is packed greedily, largest size first, each filling repeated
    as often as its sizes last. The work depends on the number of classes, not of pieces.
    """
    left = {c: n for c, n in histogram.items() if n > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(sizes: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((sizes, times))
            for c in sizes:
                left[c] -= times

    classes = sorted(left, reverse=True)
    combos = combinations(classes, window, slack, depth)
    if combos:
        row = {c: k for k, c in enumerate(classes)}
        a = np.zeros((len(classes), len(combos)))
        for j, sizes in enumerate(combos):
            for c in sizes:
                a[row[c], j] += 1
        counts = np.array([left[c] for c in classes], float)
        # relative errors count, so rare sizes are fitted as well
        weight = 1 / np.sqrt(counts)
        x = nnls(a * weight[:, None], counts * weight, 30 * len(classes) + 100)
        for j in np.argsort(-x, kind="stable"):
            sizes = combos[j]
            use(sizes, min([int(x[j] + 1e-6), *(left[c] // sizes.count(c) for c in set(sizes))]))
    while any(left.values()):
        sizes, room = [], window
        spare = dict(left)
        for c in classes:
            while spare[c] > 0 and c <= room:
                n = min(spare[c], room // c)
                sizes += [c] * n
                spare[c] -= n
                room -= n * c
        sizes = tuple(sizes)
        use(sizes, min(left[c] // sizes.count(c) for c in set(sizes)))
    return out


def pack(pieces: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Add sequence_id and offset to staged pieces (id, start, length, ...; length from 1 to window).

    The driver sees the histogram of length classes only (window / step rows) and plans on it.
    Pieces get exact ranks within their class, spread over tasks; each filling takes a range of
    ranks, and the pieces of a sequence are laid out largest class first.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_class", (F.ceil(F.col("length") / step) * step).cast("long"))
    histogram = {r["_class"]: r["n"] for r in
                 pieces.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).orderBy("_class").collect()}
    rows, taken, first = [], dict.fromkeys(histogram, 0), 0
    for sizes, times in plan(histogram, window, step):
        for c in sorted(set(sizes), reverse=True):
            each = sizes.count(c)
            rows.append((c, taken[c], taken[c] + each * times, each, first))
            taken[c] += each * times
        first += times
    ranges = spark.createDataFrame(rows, "_class long, _from long, _to long, _each long, _first long")
    n = sum(histogram.values())
    pieces = pieces.withColumn("_mix", F.xxhash64("id", "start", "ids_crc32"))
    placed = ranked(pieces, ["_class"], "_mix", ["id", "start", "ids_crc32"], n, "_rank")
    # a few ranges for each class: small, whatever the number of pieces
    placed = placed.join(F.broadcast(ranges.withColumnRenamed("_class", "_size")),
                         (F.col("_class") == F.col("_size")) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to")))
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each"))
    before = (Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    keep = [c for c in pieces.columns if c not in ("_class", "_mix")]
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        *keep, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Every document has at least one piece, as a null or empty text still has the closing id.
    Rows that repeat a document are packed once each; a null id stays null. Sequence ids count
    from 0 without gaps, and sequences are meant to be padded to the window.
    """
    pieces = staged(cut(docs, path, id_col, text_col), "pieces")
    return pack(pieces).select(real_id(F.col("id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
                               "sequence_id", "offset")
