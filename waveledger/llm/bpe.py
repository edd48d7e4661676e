"""Byte-pair encoding and decoding by scanning a contiguous array of ranks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from waveledger.llm.shared import Recent, checked, text_or_empty

#: Fixed values of the byte-level format: the pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of one generation of the per-worker word caches.
CACHE = 300_000
#: One of these after letters is a pre-token of its own.
MARKS = frozenset(".,;:!?")
#: Longer words (in bytes) use a heap in place of repeated scans.
SHORT = 64
#: Words whose rank arrays are scanned together, and texts that are encoded together.
ROWS = 4_096
TEXTS = 1_024
NONE = 1 << 40


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, ids and merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}

        def raw(token: str) -> bytes:
            return bytes(back[c] for c in token)

        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes[i] = token
        #: Id of each byte; rank and id by pair of ids, sorted by pair for look-up.
        self.byte_id = np.array([ids.get(bytes([b]), 0) for b in range(256)], np.int64)
        pair = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        self.rank_id = np.array([ids[a + b] for a, b in merges], np.int64)
        rank = np.argsort(pair, kind="stable")
        self.pairs, self.pair_rank = pair[rank], rank
        self.first = self.rank(*np.meshgrid(self.byte_id, self.byte_id, indexing="ij"))
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pattern = regex.compile(PATTERN)
        #: White space and the run after it, as bytes of 32-bit ids.
        self.chunks = Recent(None, CACHE)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of merging ids a and b, NONE where they are not merged."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)


def merge_short(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of each word: merge the pair of least rank, leftmost first, until none can be merged.

    A row holds the parts of a word, one column for each boundary, and beside it the ranks of
    merging neighbours, contiguous. Each step finds the least rank of every row, deletes the
    boundary there, and looks up the ranks of the two pairs the new part belongs to.
    """
    out = [b""] * len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    # rows of like length together, some at a time
    for some in np.array_split(order, len(words) // ROWS + 1):
        width = int(sizes[some[-1]]) if len(some) else 0
        if not width:
            continue
        text = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in some]), np.uint8).reshape(-1, width)
        parts, size, row = vocab.byte_id[text], sizes[some], some
        ranks = np.where(np.arange(1, width) < size[:, None], vocab.first[text[:, :-1], text[:, 1:]], NONE)
        # a column that never merges, so that words of one byte have a rank as well
        ranks = np.concatenate([ranks, np.full((len(some), 1), NONE)], 1)
        while len(row):
            at = ranks.argmin(1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            done = least == NONE
            if done.any():
                ended = size[done]
                flat = parts[done][np.arange(parts.shape[1]) < ended[:, None]].astype(np.int32).tobytes()
                ends = (4 * np.cumsum(ended)).tolist()
                for i, a, b in zip(row[done].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                parts, ranks, size, row, at, least = (x[~done] for x in (parts, ranks, size, row, at, least))
                if not len(row):
                    break
            here, size = np.arange(len(row)), size - 1
            parts[here, at] = vocab.rank_id[least]
            columns = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            left = np.maximum(at - 1, 0)
            ranks[here, left] = np.where(at > 0, vocab.rank(parts[here, left], parts[here, at]), ranks[here, left])
            right = np.minimum(at + 1, parts.shape[1] - 1)
            ranks[here, at] = np.where(at + 1 < size, vocab.rank(parts[here, at], parts[here, right]), NONE)
    return out


def merge_long(word: bytes, vocab: Vocabulary) -> bytes:
    """As `merge_short` for one long word: parts in a linked list, candidate pairs in a heap."""
    n = len(word)
    ids = vocab.byte_id[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int) -> int:
        b = after[a]
        if b >= n:
            return NONE
        pair = (ids[a], ids[b])
        if pair not in known:
            known[pair] = int(vocab.rank(np.int64(pair[0]), np.int64(pair[1])))
        return known[pair]

    heap = [(r, a) for a in range(n) if (r := rank(a)) != NONE]
    heapify(heap)
    while heap:
        r, a = heappop(heap)
        # a part that is gone has no id; a pair that changed has another rank
        if ids[a] < 0 or rank(a) != r:
            continue
        b = after[a]
        ids[a], ids[b] = int(vocab.rank_id[r]), -1
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
        for start in (before[a], a):
            if start >= 0 and (r := rank(start)) != NONE:
                heappush(heap, (r, start))
    return np.array([i for i in ids if i >= 0], np.int32).tobytes()


#: White space of ASCII and the run up to the next; a pre-token never crosses the end of a run.
_CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: Other white space, of the pattern's or of Python's view; texts with it are cut by the pattern alone.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def pre_tokens(chunk: str, vocab: Vocabulary) -> list[str]:
    """The pre-tokens of a text without special tokens."""
    body = chunk[:-1]
    if chunk[-1:] in MARKS and (body[1:] if body[:1] == " " else body).isalpha():
        return [body, chunk[-1:]]
    if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
        return [chunk]
    return vocab.pattern.findall(chunk)


def encode_texts(texts: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each text as 32-bit integers; special tokens in it get their own ids.

    A text is cut into chunks that pre-tokens do not cross. Chunks that are not known yet are
    cut into pre-tokens, and those are merged together, each distinct one once.
    """
    cut: list[list[str] | int] = []  # chunks, or a special token's id
    owner: list[int] = []
    for i, text in enumerate(texts):
        parts = vocab.specials.split(text) if vocab.specials and "<" in text else [text]
        for k, part in enumerate(parts):
            owner.append(i)
            cut.append(vocab.special[part] if k % 2 else [part] if _ODD.search(part) else _CHUNK.findall(part))
    known = vocab.chunks
    known.renew()
    fresh = set().union(*[c for c in cut if isinstance(c, list)]).difference(known)
    back = fresh.intersection(known.old)
    known.update([(c, known.old[c]) for c in back])
    fresh -= back
    split = [(c, pre_tokens(c, vocab)) for c in fresh]
    words = list({w for _, ws in split for w in ws})
    data = [w.encode() for w in words]
    long = {w: merge_long(d, vocab) for w, d in zip(words, data) if len(d) > SHORT}
    ids_of = dict(zip(words, merge_short([d if len(d) <= SHORT else b"" for d in data], vocab))) | long
    known.update([(c, ids_of[ws[0]] if len(ws) == 1 else b"".join([ids_of[w] for w in ws])) for c, ws in split])
    out: list[list[bytes]] = [[] for _ in texts]
    for i, c in zip(owner, cut):
        out[i].append(np.int32(c).tobytes() if isinstance(c, int) else b"".join(map(known.__getitem__, c)))
    for c, _ in split:
        if len(c) > SHORT:
            del known[c]
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids; bytes that are not UTF-8 become replacement characters. Unknown ids give nothing."""
    size, table = len(vocab.bytes), vocab.bytes
    return b"".join([table[i] for i in ids.tolist() if 0 <= i < size]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def _added(df: DataFrame, names: list[str], kinds: list[T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in names]
                        + [T.StructField(n, k) for n, k in zip(names, kinds)])


def _unused(names: list[str]) -> str:
    return max(names, key=len, default="") + "_input"


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Add `ids_col`, the token ids of every whole text, as the tokenizers library gives them.

    `path` is a byte-level BPE vocabulary file that every executor can read. Null texts count
    as empty and have no ids. `decoded_col`, if named, receives the text the ids decode to, as
    `decode` gives it, without another pass. Columns of these names are replaced. Rows stay in
    place: nothing is shuffled.
    """
    checked(df, text_col)
    names = [ids_col] + [decoded_col] * (decoded_col is not None)
    schema = _added(df, names, [T.ArrayType(T.IntegerType()), T.StringType()][:len(names)])
    kept = [f.name for f in schema.fields[:-len(names)]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                parts = encode_texts(some.column(len(kept)).to_pylist(), vocab)
                new = [_lists(parts)]
                if decoded_col is not None:
                    new.append(pa.array([decode_ids(np.frombuffer(p, np.int32), vocab) for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *new], schema.names)

    return df.select(*kept, text_or_empty(text_col).alias(_unused(kept))).mapInArrow(rows, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add `text_col`, the text of each row's ids, special tokens included; null ids give an empty text."""
    checked(df, ids_col)
    schema = _added(df, [text_col], [T.StringType()])
    kept = [f.name for f in schema.fields[:-1]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                texts = [decode_ids(x.values.to_numpy(zero_copy_only=False), vocab) if x.is_valid else ""
                         for x in some.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return df.select(*kept, F.col(ids_col).cast("array<int>").alias(_unused(kept))).mapInArrow(rows, schema)
