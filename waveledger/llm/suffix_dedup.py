"""Exact substring dedup with distributed suffix sorting, shallow then deep.

Every string of `length` bytes contains one anchor: the 24-byte gram of least hash. Equal
strings have equal anchors at equal places, so only strings with a common anchor have to be
compared, and of each anchor only the suffixes that start there (and the reversed prefixes that
end there) have to be sorted:

1. Each document is cut into pieces, one for each anchor: the strings that anchor serves, as one
   run of bytes. Pieces that occur earlier as a whole are settled by their hash.
2. Anchors with different pieces are contested. The text of one occurrence of each such piece is
   fetched, and the suffixes at the anchors are sorted: by multikey quicksort to a shallow depth,
   where groups with long common prefixes remain that blind tries put in order.
3. From the two orders and their common prefix lengths follows, for each distance to the anchor,
   which strings are equal. All but the first are removed.
4. Of anchors with very many different pieces the strings are named by hashes instead; a task
   reduces equal ones before they travel, and they are compared as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from waveledger.llm.shared import checked, id_or_least, text_or_empty
from waveledger.sources.tables import staged

#: Bytes of a gram.
GRAM = 24
#: Bytes a task hashes at a time; longer documents are cut, with overlap.
BLOCK = 1 << 18
#: Bytes that multikey quicksort looks at; beyond them groups go to blind tries.
SHALLOW = 16
#: Anchors with more different pieces than this are split into their strings, named by hashes.
CROWD = 2_000
#: Strings that are reduced together.
STRINGS = 1 << 18
#: Rows that are sorted together (whole anchors).
SORT_ROWS = 20_000
#: Bits of `place` below the start of the piece: strings in it, the anchor's distance from the start.
_BITS = 7
_U = np.uint64


def _level_up(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * size bytes from hashes of `size` bytes, at all starts."""
    return h[:-size] * _U(pow(0xBF58476D1CE4E5B9, size, 1 << 64)) + h[size:]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
    h = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


_BYTE = _scramble(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def least_grams(texts: list[bytes], k: int = 2) -> list[list[int]]:
    """The `k` least hashes of the grams of each text; all texts are at least a gram long."""
    if not texts:
        return []
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    level = _BYTE[buf]
    for j in range(3):
        level = _level_up(level, 1 << j)
    n = len(buf) - GRAM + 1
    gram = _scramble(_level_up(level, 8)[:n] * _U(pow(0xBF58476D1CE4E5B9, 8, 1 << 64)) + level[16:16 + n])
    gram = np.concatenate([gram, np.zeros(GRAM - 1, np.uint64)])
    ends = np.cumsum(sizes)
    most = _U(2**64 - 1)
    for d in range(1, GRAM):  # grams that run over the end of a text
        gram[ends - d] = most
    found = []
    for _ in range(k):
        least = np.minimum.reduceat(gram, ends - sizes)
        found.append(least)
        gram = np.where(gram == np.repeat(least, sizes), most, gram)
    return [[x for x in row if x != -1] for row in np.stack(found, 1).view(np.int64).tolist()]


def pieces(buf: np.ndarray, ends: np.ndarray, seeds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts that lie end to end in `buf`: (text, start, strings, anchor, gram, piece hash).

    `start` and `anchor` are positions in `buf`. `seeds` sets texts apart: pieces of different
    seeds are never equal.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < length:
        return none
    levels = [_BYTE[buf]]
    for j in range(6):
        levels.append(_level_up(levels[-1], 1 << j))
    h8, h16, h64 = levels[3], levels[4], levels[6]
    n = len(buf) - GRAM + 1
    gram = _scramble(h16[:n] * _U(pow(0xBF58476D1CE4E5B9, 8, 1 << 64)) + h8[16:16 + n])
    bits = max(len(buf).bit_length(), 1)
    low = _U((1 << bits) - 1)
    # least hash of each window; equal hashes: the first, as the position fills the low bits
    least, width, size = (gram & ~low) | np.arange(n, dtype=np.uint64), length - GRAM + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    anchor = (least & low).astype(np.int64)
    room = np.diff(np.concatenate([[0], ends])) - length + 1
    real = np.flatnonzero(room > 0)
    if not len(real):
        return none
    room, base = room[real], (ends - np.diff(np.concatenate([[0], ends])))[real]
    # starts of all strings that lie inside a text
    first_of = np.concatenate([[0], np.cumsum(room)])
    starts = np.arange(first_of[-1]) + np.repeat(base - first_of[:-1], room)
    text = np.repeat(real, room)
    at = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    strings = np.diff(np.concatenate([new, [len(at)]]))
    start, text, at = starts[new], text[new], at[new]
    span = strings - 1 + length
    own = _scramble(seeds[text] + gram[at])
    whole = own + _U(3) * h64[start] + _scramble(h64[start + (span - 64) // 2] + own) + _scramble(
        h64[start + span - 64] ^ ((at - start) * 256 + strings).astype(np.uint64))
    return text, start, strings, at, own, _scramble(whole)


def _place(start, strings, distance):
    return (start << 2 * _BITS) | (strings << _BITS) | distance


def _records(length: int, shared: bool):
    """Arrow batches of (doc, tag, seed, text) -> (key, piece, doc, tag, place), copies inside a batch settled."""
    names = ["key", "piece", "doc", "tag", "place"]

    def block(todo: list[tuple[int, int, int, int, bytes]]) -> list[np.ndarray]:
        buf = np.frombuffer(b"".join([t[4] for t in todo]), np.uint8)
        ends = np.cumsum([len(t[4]) for t in todo])
        doc, tag, seed, offset = (np.array([t[k] for t in todo], np.int64) for k in range(4))
        text, start, strings, at, own, whole = pieces(buf, ends, seed.view(np.uint64), length)
        local = start - (np.concatenate([[0], ends[:-1]]))[text] + offset[text]
        return [own.view(np.int64), whole.view(np.int64), doc[text], tag[text], _place(local, strings, at - start)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, todo, size = [], [], 0
            for doc, tag, seed, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                data = text.as_py().encode()
                for a in range(0, max(len(data) - length + 1, 0), BLOCK):
                    todo.append((doc, tag, seed, a, data[a:a + BLOCK + length - 1]))
                    size += len(todo[-1][4])
                    if size >= BLOCK:
                        parts.append(block(todo))
                        todo, size = [], 0
            if todo:
                parts.append(block(todo))
            if not parts:
                continue
            key, piece, doc, tag, place = (np.concatenate([p[k] for p in parts]) for k in range(5))
            if not shared:
                # later copies of a piece in this batch are settled; they spread by place
                order = np.lexsort((tag, place, doc, piece))
                key, piece, doc, tag, place = (x[order] for x in (key, piece, doc, tag, place))
                head = np.concatenate([[True], piece[1:] != piece[:-1]])[:len(piece)]
                first = np.maximum.accumulate(np.where(head, np.arange(len(piece)), 0))
                later = (doc != doc[first]) | (place != place[first]) | (tag != tag[first])
                mixed = _scramble((doc * 1_000_003 + tag).view(np.uint64) ^ place.view(np.uint64)).view(np.int64)
                key, piece = np.where(later, mixed, key), np.where(later, 0, piece)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, piece, doc, tag, place)], names)

    return rows, T.StructType([T.StructField(n, T.LongType()) for n in names])


SETTLED, CONTESTED = 0, 1


def _settle(shared: bool):
    """Streams sorted (key, piece, doc, place, tag): rows that are repeats, and rows of each contested piece.

    A key with several pieces is contested. One row stands for a piece there; with `shared`, all
    rows of a piece that a single text has, as it may share strings with other pieces wherever
    it is. With `shared`, a piece counts as repeated when two texts have it, and then everywhere.
    Between batches only rows that still matter are kept: one of a piece, or those of one text.
    """
    names = ["kind", "key", "doc", "tag", "place"]

    def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        key = rows[0] if kind == CONTESTED else rows[0] * 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(key), kind, np.int64), key, *rows[2:])], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((5, 0), np.int64)
        held, spread = none, False      # rows of the current piece; whether several texts have it
        waiting, crowded = none, None   # rows of the only piece so far of the current key; a key known to be contested

        def contested(stand: np.ndarray) -> np.ndarray:
            """Of rows that stand for whole pieces, in order: those of keys with several pieces."""
            nonlocal waiting, crowded
            stand = np.concatenate([waiting, stand], 1)
            if not stand.shape[1]:
                return stand
            key, piece = stand[:2]
            edge = np.concatenate([[True], key[1:] != key[:-1]])
            starts = edge | np.concatenate([[True], piece[1:] != piece[:-1]])
            group = np.cumsum(edge) - 1
            many = (np.bincount(group, starts) > 1)[group]
            if crowded is not None:
                many |= key == crowded
            last = group == group[-1]
            waiting, crowded = (none, key[-1]) if many[-1] else (stand[:, last], None)
            return stand[:, many]

        for batch in batches:
            data = np.stack([batch.column(k).to_numpy() for k in range(5)]) if batch.num_rows else none
            settled = data[1] == 0
            if settled.any():
                yield out(SETTLED, data[:, settled])
                data = data[:, ~settled]
            if not data.shape[1]:
                continue
            told = 1 if spread else 0  # the held row of a piece in several texts has been passed on
            data = np.concatenate([held, data], 1)
            key, piece, doc, tag, place = data
            head = np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])])
            at = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            run = np.cumsum(head) - 1
            other = (doc != doc[at]) | (tag != tag[at])
            if shared:
                several = np.bincount(run, other) > 0
                several[0] |= spread
                several = several[run]
                repeat = several.copy()
                repeat[:told] = False
                stand = head | ~several
                spread = bool(several[-1])
            else:
                repeat = other | (place != place[at])
                stand = head
            yield out(SETTLED, data[:, repeat])
            unfinished = run == run[-1]
            yield out(CONTESTED, contested(data[:, stand & ~unfinished]))
            held = data[:, stand & unfinished]
        yield out(CONTESTED, contested(held))

    return rows, T.StructType([T.StructField(n, T.LongType()) for n in names])


#: In the column `near`: a string of a crowded anchor, and a span already known to be repeated.
STRING, SPAN = -1, -2


def _compared(rows: np.ndarray, shared: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted strings (name, name, doc, start, tag): which are repeated, which stand for the others of a name.

    The first of a name stands for all; with `shared` the first two of different texts do, or all of its only text.
    """
    n = rows.shape[1]
    head = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])[:n]
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    other = (rows[[2, 4]] != rows[[2, 4]][:, at]).any(0)
    if not shared:
        return other | (rows[3] != rows[3, at]), head
    run = np.cumsum(head) - 1
    before = np.cumsum(other) - other
    repeated = (np.bincount(run, other) > 0)[run]
    return repeated, ~repeated | head | (other & (before == before[at]))


def _strings(rows: np.ndarray, length: int, shared: bool) -> list[tuple]:
    """Rows of slices for strings (name, name, doc, start, tag): one of each name, and spans of the others."""
    rows = rows[:, np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))]
    repeated, needed = _compared(rows, shared)
    out = [(h1, doc, tag, start, STRING, h2, b"") for h1, h2, doc, start, tag in rows[:, needed].T.tolist()]
    doc, start, tag = rows[2:, repeated]
    if not len(doc):
        return out
    order = np.lexsort((start, tag, doc))
    doc, start, tag = doc[order], start[order], tag[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] - start[:-1] > length)])
    heads = np.flatnonzero(new)
    ends = start[np.concatenate([heads[1:], [len(start)]]) - 1] + length
    doc, start, tag = doc[heads], start[heads], tag[heads]
    spread = _scramble((doc * 1_000_003).view(np.uint64) ^ start.view(np.uint64)).view(np.int64)
    return out + [(*x, SPAN, end, b"") for *x, end in zip(*(c.tolist() for c in (spread, doc, tag, start, ends)))]


def _slices(length: int, shared: bool):
    """(doc, tag, text, wanted pieces) -> one row per piece or, of crowded anchors, per string."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "doc", "tag", "anchor", "near", "far")]
                          + [T.StructField("data", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd: list[np.ndarray] = []
        held = 0
        for batch in batches:
            out: list[tuple] = []
            docs, tags, texts, wanted = (batch.column(k) for k in range(4))
            for doc, tag, text, want in zip(docs.to_pylist(), tags.to_pylist(), texts, wanted):
                data = text.as_py().encode()
                for w in want.as_py():
                    place = w["place"]
                    start, strings, far = place >> 2 * _BITS, place >> _BITS & 127, place & 127
                    anchor, near = start + far, far - strings + 1
                    if not w["crowded"]:
                        out.append((w["key"], doc, tag, anchor, near, far, data[start:anchor - near + length]))
                    else:
                        # equal strings have the same anchor, so its key keeps the names of seeds apart
                        seed, starts = w["key"] % (1 << 64), range(start, start + strings)
                        names = b"".join([xxhash.xxh3_128_digest(data[a:a + length], seed) for a in starts])
                        part = np.empty((5, strings), np.int64)
                        part[:2] = np.frombuffer(names, np.int64).reshape(-1, 2).T
                        part[2], part[3], part[4] = doc, starts, tag
                        crowd.append(part)
                        held += strings
                    if held > STRINGS:
                        out += _strings(np.concatenate(crowd, 1), length, shared)
                        crowd, held = [], 0
                    if len(out) > SORT_ROWS:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)
        if crowd:
            yield _batch(_strings(np.concatenate(crowd, 1), length, shared), schema)

    return rows, schema


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)


class BlindTrie:
    """Orders strings that share a long prefix, comparing each with one other string only.

    Inner nodes hold the position where their strings differ and a child for each byte there
    (-1: the string ends). To add a string, descend blindly by these bytes, compare with the
    leaf found, and branch at the first difference.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [0]  # a leaf is the list of the equal strings' numbers
        for i in range(1, len(strings)):
            self.add(i)

    def add(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            child = children.get(s[depth] if depth < len(s) else -1)
            node = child if child is not None else next(iter(children.values()))
        other = self.strings[node[0]]
        common = common_prefix(s, other)
        if common == len(s) == len(other):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            edge = s[node[0]]
            parent, node = (node, edge), node[1][edge]
        mine = s[common] if common < len(s) else -1
        if isinstance(node, tuple) and node[0] == common:
            node[1][mine] = [i]
            return
        theirs = other[common] if common < len(other) else -1
        branch = (common, {mine: [i], theirs: node})
        if parent is None:
            self.root = branch
        else:
            parent[0][1][parent[1]] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def multikey_quicksort(group: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): rows sorted by group and then keys; where a segment of equal rows begins.

    Three-way partition of all segments at once: what is less than the segment's pivot, equal
    to it (which goes on with the next key) or greater. Rows that agree in all keys stay a segment.
    """
    n, table = len(group), np.stack(keys)
    order = np.argsort(group, kind="stable")
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]])[:n]
    depth = np.zeros(n, np.int64)
    while True:
        begin = np.flatnonzero(head)
        size = np.diff(np.concatenate([begin, [n]]))
        live = (size > 1) & (depth[begin] < len(keys))
        if not live.any():
            return order, head
        begin, size = begin[live], size[live]
        segment, ahead = np.repeat(np.arange(len(begin)), size), np.cumsum(size) - size
        place = np.arange(len(segment)) + np.repeat(begin - ahead, size)
        row, level = order[place], depth[place]
        value = table[level, row]
        pivot = value[ahead + size // 2][segment]
        side = segment * 3 + (value >= pivot) + (value > pivot)
        dealt = np.argsort(side, kind="stable")
        order[place], depth[place] = row[dealt], (level + (value == pivot))[dealt]
        side = side[dealt]
        head[place] = np.concatenate([[True], side[1:] != side[:-1]])


def sort_suffixes(group: np.ndarray, strings: list[bytes], known: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings sorted inside their groups; common prefix with the one before.

    The strings of a group share their first `known` bytes. `common` is -1 where a group begins.
    A string that ends sorts before those that go on.
    """
    n, lengths = len(strings), np.array([len(s) for s in strings])
    width = max(int(lengths.max(initial=0)), known + SHALLOW)
    table = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(n, width)
    # shallow: all groups at once, eight bytes to a key
    keys = [np.ascontiguousarray(table[:, d:d + 8]).view(">u8").ravel().astype(np.uint64)
            for d in range(known, known + SHALLOW, 8)]
    order, head = multikey_quicksort(group, keys)
    # deep: runs that agree so far
    cuts = np.concatenate([np.flatnonzero(head), [n]])
    for a, b in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist()):
        members = order[a:b]
        order[a:b] = members[BlindTrie([strings[i] for i in members.tolist()]).order()]
    common = np.full(n, -1)
    if n > 1:
        a, b = order[:-1], order[1:]
        unlike = table[a] != table[b]
        same = np.where(unlike.any(1), unlike.argmax(1), width)
        same = np.minimum(same, np.minimum(lengths[a], lengths[b]))
        common[1:] = np.where(group[a] == group[b], same, -1)
    return order, common


def repeats(group, doc, tag, anchor, near, far, data: list[bytes], length: int, shared: bool):
    """For each piece the first and last start of a repeated string, or (0, -1).

    A piece has the strings that start `near` to `far` bytes before its anchor. Strings of one
    group are equal if their suffixes at the anchor and their reversed prefixes agree as far as
    the string goes: two neighbours in both sorted orders.
    """
    n = len(data)
    left = [d[:f][::-1] for d, f in zip(data, far.tolist())]
    right = [d[f:] for d, f in zip(data, far.tolist())]
    order_r, common_r = sort_suffixes(group, right, GRAM)
    order_l, common_l = sort_suffixes(group, left, 0)
    by_age = np.lexsort((anchor, tag, doc)) if shared else np.lexsort((tag, anchor, doc))
    first, last = np.full(n, -1), np.full(n, -1)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):
        member = by_age[(near[by_age] <= r) & (r <= far[by_age])]
        if len(member) < 2:
            continue
        run_r[order_r] = np.cumsum(common_r < length - r)
        run_l[order_l] = np.cumsum(common_l < r)
        name = run_r[member] * (n + 1) + run_l[member]
        _, head, at = np.unique(name, return_index=True, return_inverse=True)
        if shared:
            owner = np.stack([doc[member], tag[member]])
            other = (owner != owner[:, head[at]]).any(0)
            repeated = (np.bincount(at, other) > 0)[at]
        else:
            oldest = member[head[at]]
            repeated = (doc[member] != doc[oldest]) | (anchor[member] != anchor[oldest])
        hit = member[repeated]
        last[hit] = np.where(last[hit] < 0, anchor[hit] - r, last[hit])  # r rises, so starts fall
        first[hit] = anchor[hit] - r
    return first, last


def _sorted_repeats(length: int, shared: bool):
    """Streams slices sorted by key, far, doc, anchor and tag: the spans of repeated strings, as (doc, tag, start, end).

    No anchor has more than CROWD rows here. Of strings, those that stand for a name are kept between batches.
    """
    names = ["doc", "tag", "start", "end"]

    def work(rows: pa.Table) -> pa.RecordBatch:
        key, doc, tag, anchor, near, far = (rows.column(k).to_numpy() for k in range(6))
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        first, last = repeats(group, doc, tag, anchor, near, far, rows.column(6).to_pylist(), length, shared)
        hit = first >= 0
        found = (doc[hit], tag[hit], first[hit], last[hit] + length)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        last = np.zeros((5, 0), np.int64)  # what stands for the current name
        for batch in batches:
            kind = batch.column(4).to_numpy()
            if (kind < 0).any():
                h1, doc, tag, start, _, far = (batch.column(k).to_numpy() for k in range(6))
                span, string = kind == SPAN, kind == STRING
                yield pa.RecordBatch.from_arrays([pa.array(x[span]) for x in (doc, tag, start, far)], names)
                if string.any():
                    found = np.concatenate([last, np.stack([h1, far, doc, start, tag])[:, string]], 1)
                    repeated, needed = _compared(found, shared)
                    last = found[:, needed & (found[:2] == found[:2, -1:]).all(0)]
                    doc, start, tag = found[2:, repeated]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tag, start, start + length)], names)
                batch = batch.filter(pa.array(kind >= 0))
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            if kept.num_rows >= SORT_ROWS:
                key = kept.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
                if cut:
                    yield work(kept.slice(0, cut))
                    kept = kept.slice(cut)
        if kept is not None:
            yield work(kept)

    return rows, T.StructType([T.StructField(n, T.LongType()) for n in names])


def text_tags(docs: DataFrame, id_col: str, text: Column) -> Column:
    """What tells rows of one id and different texts apart: a hash of the text, or 0 where every id is unique.

    The rows are counted by id first. Most tables have unique ids; a column of zeros costs
    nothing when it is shuffled.
    """
    ids = docs.select(id_or_least(id_col).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return F.lit(0).cast("long") if ids.filter("n > 1").isEmpty() else F.xxhash64(text)


def repeated_spans(texts: DataFrame, length: int, shared: bool = False) -> DataFrame:
    """(doc, tag, start, end): byte spans of the texts that repeated strings of `length` bytes cover.

    `texts` has doc and tag (longs that name a text), seed (strings repeat only among texts of
    one seed) and text (not null). Spans overlap and touch. A string counts as repeated where
    an equal one starts earlier: in a text of smaller doc, or earlier in the same; with
    `shared`, wherever it is, if two texts have it.

    Shuffled are five numbers for each anchor (one in about 38 bytes), then the texts once, and
    the bytes around contested anchors. A piece that many documents share is reduced to one row
    for each batch that has it; an anchor with many different pieces is split into its strings,
    of which a task passes on one row each (with `shared`, two).
    """
    if not 64 <= length <= 108:
        raise ValueError("length must be 64 to 108")
    texts = texts.select("doc", "tag", "seed", "text")
    found = texts.mapInArrow(*_records(length, shared))
    found = found.repartition("key").sortWithinPartitions("key", "piece", "doc", "place", "tag")
    found = staged(found.mapInArrow(*_settle(shared)), "anchors")
    place = F.col("place")
    start = F.shiftright(place, 2 * _BITS)
    strings = F.shiftright(place, _BITS).bitwiseAND(F.lit(127))
    settled = found.filter(F.col("kind") == SETTLED).select(
        "doc", "tag", start.alias("start"), (start + strings - 1 + length).alias("end"))
    contested = found.filter(F.col("kind") == CONTESTED).select("key", "doc", "tag", "place")
    crowds = staged(contested.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
                    .select(F.col("key").alias("_key")), "crowds")
    contested = contested.join(crowds, F.col("key") == F.col("_key"), "left").select(
        "key", "doc", "tag", "place", F.col("_key").isNotNull().alias("crowded"))
    wanted = contested.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "place", "crowded")).alias("wanted"))
    fetched = texts.select("doc", "tag", "text").join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted")
    slices = fetched.mapInArrow(*_slices(length, shared)).repartition("key").sortWithinPartitions(
        "key", "far", "doc", "anchor", "tag")
    return settled.union(slices.mapInArrow(*_sorted_repeats(length, shared)))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans as maximal runs; touching spans are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(starts) - 1]])].tolist()))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _cut_out(as_text: bool):
    """(row, text, found) -> row, n_bytes, removed spans, kept bytes (or the whole characters among them)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                runs = []
                if found.is_valid and len(found.values):
                    flat = found.values.flatten()
                    runs = merged(flat[0].to_numpy(), flat[1].to_numpy())
                at = [0, *(e for _, e in runs)]
                left = b"".join([data[a:b] for a, b in zip(at, [*(s for s, _ in runs), len(data)])])
                kept.append(left.decode("utf-8", errors="ignore") if as_text else left)
                spans.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind),
                 pa.array(kept, pa.string() if as_text else pa.binary())],
                ["row", "n_bytes", "removed", "kept"])

    return rows


def dedup_substrings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                     as_text: bool = False) -> DataFrame:
    """All columns of `docs` but the text, and n_bytes, removed (maximal byte runs), kept (bytes).

    Texts are UTF-8 bytes; a null text counts as empty. Each byte goes that a string of `length`
    bytes covers which also starts earlier: in a document of smaller id, or earlier in the same.
    Strings are compared in the input and never cross documents. A missing id is the smallest.
    Rows that agree in id and text are one document and get the same result; rows of one id and
    different texts are documents whose order is that of the positions in them. Columns named
    n_bytes, removed or kept are replaced. An empty table gives an empty result. With `as_text`,
    kept is a string: bytes of characters that were cut apart go as well.
    """
    checked(docs, id_col, text_col)
    text = text_or_empty(text_col)
    others = [c for c in docs.columns if c not in (text_col, "n_bytes", "removed", "kept")]
    tag = text_tags(docs, id_col, text)
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), id_or_least(id_col).alias("doc"),
                       tag.alias("tag"), text.alias("text"))
    texts = docs.select(id_or_least(id_col).alias("doc"), tag.alias("tag"),
                        F.lit(0).cast("long").alias("seed"), text.alias("text"))
    spans = repeated_spans(texts, length).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    rows = rows.join(spans, ["doc", "tag"], "left").select("row", "text", "found")
    schema = T.StructType([rows.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", _SPANS),
                           T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return rows.mapInArrow(_cut_out(as_text), schema).select("row.*", "n_bytes", "removed", "kept")


def deduped_texts(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, the text without its repeated strings; null texts become empty."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("_others"),
                       F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = dedup_substrings(rows, length, "_id", "_text", as_text=True)
    return cut.select(*[F.col("kept").alias(c) if c == text_col else F.col("_others").getField(c).alias(c)
                        for c in docs.columns])
