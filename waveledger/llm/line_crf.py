"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from waveledger.llm.shared import checked, text_or_empty

#: Labelled documents the field is fitted on at most: those of least hash. All rows are scored.
SAMPLE = 4_000
#: Lines of one sampled document that enter the fit at most (all lines are scored).
SAMPLE_LINES = 200
#: Runs of lines that stand for a longer document.
SAMPLE_RUNS = 8
#: Steps of the fit, weight decay.
STEPS = 150
DECAY = 1e-3

#: Kinds of bytes that are counted in each line.
_KINDS = ("symbol", "mark", "capital", "letter", "digit", "high", "space")
#: Features of the line itself; those of NEAR are also taken from the lines before and after it.
OWN = ("bias", "symbols", "marks", "capitals", "digits", "repeats", "word length", "log length", "blank", "as before",
       "sentence end", "first", "last")
NEAR = ("symbols", "marks", "capitals", "repeats", "word length")
N_FEATURES = len(OWN) + 2 * len(NEAR)


def _kind_table() -> np.ndarray:
    table = np.full(256, -1, np.int8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            k = "high"
        elif c in " \t\n\v\f\r":
            k = "space"
        elif c.isupper():
            k = "capital"
        elif c.islower():
            k = "letter"
        elif c.isdigit():
            k = "digit"
        elif c in ".,;:'\"?()-":
            k = "mark"
        elif b > 32:
            k = "symbol"
        else:
            continue
        table[b] = _KINDS.index(k)
    return table


_TABLE = _kind_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths in bytes, first line of each text and the end).

    Every text has at least one line, which may be empty.
    """
    lines = [t.encode().split(b"\n") for t in texts]
    first = np.cumsum([0] + [len(x) for x in lines])
    flat = [x for doc in lines for x in doc]
    n = len(flat)
    size = np.array([len(x) for x in flat], np.int64)
    buf = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kinds = _TABLE[buf]
    count = {k: np.add.reduceat((kinds == i).view(np.uint8), start, dtype=np.int64) for i, k in enumerate(_KINDS)}
    count["space"] -= 1  # the line's end
    words, repeats = np.zeros(n), np.zeros(n)
    for i, line in enumerate(flat):
        w = line.split()
        words[i] = len(w)
        repeats[i] = len(w) - len(set(w))
    ink = np.maximum(size - count["space"], 1).astype(float)
    tokens = np.maximum(words, 1)
    x = np.zeros((n, N_FEATURES))
    # a high byte is part of a letter
    letters = np.maximum(count["letter"] + count["capital"] + count["high"], 1)
    column = {
        "bias": np.ones(n), "symbols": np.minimum(4 * count["symbol"] / ink, 2), "marks": 4 * count["mark"] / ink,
        "capitals": 2 * count["capital"] / letters, "digits": 2 * count["digit"] / ink,
        "repeats": 2 * repeats / tokens * (words > 5), "word length": np.minimum(ink / tokens / 8, 4),
        "log length": np.log1p(size) / 6, "blank": (words == 0).astype(float),
        "as before": np.array([0.0] + [float(a == b and len(a) > 0) for a, b in zip(flat, flat[1:])]),
        "sentence end": np.isin(buf[start + np.maximum(size - 1, 0)], np.frombuffer(b".!?", np.uint8)).astype(float),
        "first": np.zeros(n), "last": np.zeros(n)}
    column["as before"][first[:-1]] = 0
    column["first"][first[:-1]] = 1
    column["last"][first[1:] - 1] = 1
    for j, name in enumerate(OWN):
        x[:, j] = column[name]
    inner, outer = column["first"] == 0, column["last"] == 0
    for j, name in enumerate(NEAR):
        v = column[name]
        x[1:, len(OWN) + 2 * j] = v[:-1]
        x[:-1, len(OWN) + 2 * j + 1] = v[1:]
        x[:, len(OWN) + 2 * j] *= inner
        x[:, len(OWN) + 2 * j + 1] *= outer
    return x, size, first


@dataclass
class LineField:
    """Weights of the state good (bad has none) and the log weights of state changes, [from, to]."""

    weights: np.ndarray
    moves: np.ndarray


@dataclass
class Chains:
    """Lines of many documents ordered by step: `rows[at[t]:at[t + 1]]` are the t-th lines.

    Documents are ordered by length, longest first, so those with a t-th line come first.
    """

    rows: np.ndarray
    at: np.ndarray
    order: np.ndarray


def chains(first: np.ndarray) -> Chains:
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    # documents with more than t lines
    live = np.searchsorted(-length[order], -np.arange(longest), side="left")
    at = np.concatenate([[0], np.cumsum(live)])
    step = np.repeat(np.arange(longest), live)
    rows = first[:-1][order][np.arange(at[-1]) - at[step]] + step
    return Chains(rows, at, order)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))


def forward_backward(score: np.ndarray, moves: np.ndarray, c: Chains):
    """Forward and backward log sums of every line (in chain order) and each document's log sum.

    `score` is the good state's potential in chain order; bad has 0.
    """
    n, steps = len(score), len(c.at) - 1
    own = np.stack([np.zeros(n), score], 1)
    forth, back = np.empty((n, 2)), np.zeros((n, 2))
    if not steps:
        return own, forth, back, np.zeros(0)
    forth[:c.at[1]] = own[:c.at[1]]
    for t in range(1, steps):
        a, b = c.at[t], c.at[t + 1]
        before = forth[c.at[t - 1]:c.at[t - 1] + (b - a)]
        forth[a:b] = own[a:b] + _log_sum(before[:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        a, live = c.at[t], c.at[t + 2] - c.at[t + 1]
        after = own[c.at[t + 1]:c.at[t + 2]] + back[c.at[t + 1]:c.at[t + 2]]
        back[a:a + live] = _log_sum(moves + after[:, None, :], 2)
    return own, forth, back, _log_sum(forth[:c.at[1]] + back[:c.at[1]], 1)


def good_lines(x: np.ndarray, first: np.ndarray, field: LineField) -> np.ndarray:
    """Marginal probability of good for every line."""
    c = chains(first)
    _, forth, back, total = forward_backward((x @ field.weights)[c.rows], field.moves, c)
    doc = np.arange(len(c.rows)) - np.repeat(c.at[:-1], np.diff(c.at))
    out = np.empty(len(x))
    out[c.rows] = np.exp(np.minimum(forth[:, 1] + back[:, 1] - total[doc], 0))
    return out


def fit(x: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = STEPS) -> LineField:
    """Maximise the likelihood of lines that all carry their document's label, both labels weighing alike.

    Plain gradient steps with per-weight rates; fixed start and order, so the same rows give
    the same field.
    """
    c = chains(first)
    n_docs = len(first) - 1
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    if n_docs == 0 or good.all() or not good.any():
        weights[0] = 4.0 if n_docs == 0 or good.all() else -4.0
        return LineField(weights, moves)
    xs = x[c.rows]
    place = np.arange(len(c.rows)) - np.repeat(c.at[:-1], np.diff(c.at))  # chain of each row
    label = good[c.order].astype(float)
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    share = share / np.diff(first)[c.order] ** 0.5  # long documents do not drown short ones
    y, weight = label[place], share[place]
    follow = np.diff(c.at)[1:]
    later = np.arange(c.at[1] if len(c.at) > 1 else 0, len(c.rows))
    prior = later - np.repeat(np.diff(c.at)[:-1], follow) if len(later) else later
    counted = np.zeros((2, 2))
    for s in (0, 1):
        counted[s, s] = weight[later][y[later] == s].sum()
    parameters = np.concatenate([weights, moves.ravel()])
    momentum, scale = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        weights, moves = parameters[:-4], parameters[-4:].reshape(2, 2)
        own, forth, back, total = forward_backward(xs @ weights, moves, c)
        p = np.exp(np.minimum(forth[:, 1] + back[:, 1] - total[place], 0))
        gradient = xs.T @ (weight * (y - p))
        pairs = (forth[prior][:, :, None] + moves + (own + back)[later][:, None, :]
                 - total[place[later]][:, None, None])
        expected = (np.exp(np.minimum(pairs, 0)) * weight[later][:, None, None]).sum(0)
        g = np.concatenate([gradient, (counted - expected).ravel()]) - DECAY * parameters
        momentum = 0.9 * momentum + 0.1 * g
        scale = 0.99 * scale + 0.01 * g * g
        parameters = parameters + 0.15 * (momentum / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    return LineField(parameters[:-4].copy(), parameters[-4:].reshape(2, 2).copy())


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def sampled_runs(n: int, most: int, seed: int) -> list[tuple[int, int]]:
    """Lines to learn from, as runs: all, or one run inside each of SAMPLE_RUNS equal parts."""
    if n <= most:
        return [(0, n)]
    parts = min(SAMPLE_RUNS, most)
    size = most // parts
    edges = [n * k // parts for k in range(parts + 1)]
    starts = [a + zlib.crc32(f"{seed}:{k}".encode()) % max(b - a - size + 1, 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return [(a, min(a + size, n)) for a in starts]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> LineField:
    """Fit on at most `sample` labelled documents that are not held out, those of least id hash.

    The driver receives the features of these documents only, at most `sample_lines` lines each:
    of longer ones SAMPLE_RUNS runs of consecutive lines from all parts of the document, each at
    a place that the text's hash chooses, and each a chain of its own. Of the rows that repeat a
    sampled id the least text stands for all. Labels other than 0 and 1 are left out; of several
    labels of one id the least is used. Without labelled rows every line counts as good.
    """
    checked(docs, id_col, text_col)
    checked(labels, id_col, label_col)
    chosen = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    # the sample is bounded by its parameter; one row of each id goes on
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
            .join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
            .withColumn("_at", F.xxhash64("_id", "_text")))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.LongType()),
                           T.StructField("x", T.BinaryType())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, y, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, _, _ = line_features([text])
                for a, b in sampled_runs(len(x), sample_lines, at):
                    for column, value in zip(out, (i, y, x[a:b].astype(np.float32).tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             ["id", "y", "x"])

    got = rows.select("_id", "_y", "_text", "_at").mapInArrow(features, schema).toArrow().sort_by([("id", "ascending")])
    xs = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"].to_pylist()]
    if not xs:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(1, np.int64), np.zeros(0, bool))
    order = sorted(range(len(xs)), key=lambda i: (got["id"][i].as_py(), xs[i].tobytes()))
    y = got["y"].to_numpy()[order]
    xs = [xs[i] for i in order]
    return fit(np.concatenate(xs).astype(float), np.cumsum([0] + [len(x) for x in xs]), y == 1)


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: mean over all lines of the marginal of good, weighted by their bytes plus one.

    Rows stay where they are. A null text counts as empty: one empty line. Equal texts have
    equal scores, as documents do not influence each other.
    """
    checked(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, todo, size = [], [], 0
            for t in [*texts, None]:
                if t is not None:
                    todo.append(t)
                    size += len(t)
                if todo and (t is None or size > 1 << 22):
                    x, length, first = line_features(todo)
                    weight = length + 1.0
                    total = np.add.reduceat(good_lines(x, first, field) * weight, first[:-1])
                    out.append(total / np.add.reduceat(weight, first[:-1]))
                    todo, size = [], 0
            scores = np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(rows, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: the field is fitted on rows that are not held out, all are scored."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
