"""Quiet runs of a live stream: samples arrive out of order and late, runs leave when they are sure.

Samples of a key wait in its state until the watermark has passed them, so what is held is bounded
by the delay that the watermark allows. Then they are taken in order of their index and extend
the open run or end it. An open run of a key that has gone silent is ended by a timeout. Keys share
a state by their hash: a batch calls Python once for each such bucket, not once for each key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waveledger.functions import ordered

#: Keys of a bucket; its waiting samples (rows of key number, index, time in ms, quiet) and open runs (rows of key
#: number, start, stop, time of the last sample) as bytes of whole numbers, so that no sample is an object of its own.
STATE = "key array<string>, waiting binary, open binary"
#: Buckets that share the keys.
BUCKETS = 256


def _text(name: str, kind: T.DataType) -> Column:
    """A key as text that `_value` turns back."""
    c = F.col(name)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)  # zeros of both signs are one key
    return c.cast("string")


def _value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unbase64(c)
    return F.timestamp_micros(c.cast("bigint")) if isinstance(kind, T.TimestampType) else c.cast(kind)


def advance(waiting: list[tuple[int, int, bool]], run: tuple[int, int, int] | None, upto: int
            ) -> tuple[list[tuple[int, int]], list[tuple[int, int, bool]], tuple[int, int, int] | None]:
    """(ended runs, samples that still wait, open run) once time `upto` has passed.

    A run is (start, stop, time of its last sample); a missing index ends it as an active sample does.
    """
    ended = []
    for i, t, quiet in sorted(w for w in waiting if w[1] <= upto):
        if run is not None and quiet and i == run[1]:
            run = (run[0], i + 1, t)
            continue
        if run is not None and i >= run[1]:
            ended.append(run[:2])
            run = None
        if quiet and run is None:
            run = (i, i + 1, t)
    return ended, [w for w in waiting if w[1] > upto], run


def advance_all(waiting: np.ndarray, runs: np.ndarray, upto: int, idle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`advance` for the rows of all keys of a bucket at once: (ended runs: key, start, stop; samples that wait; open runs).

    Open runs of keys without waiting samples end when they have been silent for `idle` ms.
    """
    late = waiting[:, 2] > upto
    rest, done = waiting[late], waiting[~late]
    done = done[np.lexsort((done[:, 3], done[:, 2], done[:, 1], done[:, 0]))]
    # an open run goes ahead of its key's samples as its last sample
    every = np.concatenate([done, np.stack([runs[:, 0], runs[:, 2] - 1, runs[:, 3], np.ones(len(runs), np.int64)], 1)])
    start = np.concatenate([done[:, 1], runs[:, 1]])
    ahead = np.arange(len(every)) < len(done)
    order = np.lexsort((ahead, every[:, 0]))
    every, start = every[order], start[order]
    same = every[1:, 0] == every[:-1, 0]
    # repeated indices and samples before the end of the open run are left to the plain form
    odd = np.unique(every[1:][same & (every[1:, 1] <= every[:-1, 1]), 0])
    ended, still = [], []
    if len(odd):
        for key in odd.tolist():
            mine = [tuple(w) for w in done[done[:, 0] == key, 1:].tolist()]
            opened = runs[runs[:, 0] == key, 1:].tolist()
            found, _, run = advance(mine, tuple(opened[0]) if opened else None, upto)
            ended += [(key, *r) for r in found]
            still += [(key, *run)] if run is not None else []
        plain = ~np.isin(every[:, 0], odd)
        every, start = every[plain], start[plain]
    last_of_key = np.append(every[1:, 0] != every[:-1, 0], True)[:len(every)]
    quiet = np.flatnonzero(every[:, 3] == 1)
    held = every[quiet]
    first = np.flatnonzero(np.append(True, (held[1:, 0] != held[:-1, 0]) | (held[1:, 1] != held[:-1, 1] + 1))[:len(held)])
    end = np.append(first[1:], len(held))[:len(first)] - 1
    found = np.stack([held[first, 0], start[quiet[first]], held[end, 1] + 1, held[end, 2]], 1)
    goes_on = last_of_key[quiet[end]]
    ended = np.concatenate([np.array(ended, np.int64).reshape(-1, 3), found[~goes_on, :3]])
    still = np.concatenate([np.array(still, np.int64).reshape(-1, 4), found[goes_on]])
    silent = ~np.isin(still[:, 0], rest[:, 0]) & (still[:, 3] + idle <= upto)
    return np.concatenate([ended, still[silent, :3]]), rest, still[~silent]


def quiet_runs(samples: DataFrame, keys: Sequence[str], limit: float, watermark: str, idle_s: float,
               least: int = 1, ts: str = "ts", index: str = "i", value: str = "value",
               buckets: int = BUCKETS) -> DataFrame:
    """keys, start, end: runs of `least` or more consecutive samples of at most `limit` in size.

    Works on tables, where all runs are found at once, and on streams: there samples may be late
    by `watermark`, and a run of a key without samples for `idle_s` seconds is ended. A null or
    NaN value is not quiet. Each index of a key is expected once. Keys of a stream are values that
    text can hold (no arrays or structs); `buckets` of them by hash share a state, which holds
    their waiting samples, and have to stay the same for a checkpoint.
    """
    flag = F.coalesce((F.abs(F.col(value)) <= limit) & ~F.isnan(F.col(value).cast("double")), F.lit(False))
    if not samples.isStreaming:
        return ordered.runs(samples, keys, index, flag).where(F.col("end") - F.col("start") >= least)
    kinds = [samples.schema[k].dataType for k in keys]
    if any(isinstance(k, (T.ArrayType, T.StructType, T.MapType)) for k in kinds):
        raise ValueError("keys of a stream have to be plain values")
    # one text for all columns of a key
    named = F.to_json(F.array(*[_text(k, t) for k, t in zip(keys, kinds)]))
    timed = samples.withWatermark(ts, watermark).select(
        named.alias("_key"), ts, F.col(index).cast("bigint").alias("_i"), F.unix_millis(ts).alias("_t"), flag.alias("_q"))
    timed = timed.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    schema = T._parse_datatype_string("key string, start bigint, end bigint")
    idle = int(idle_s * 1000)

    def work(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = pd.Index([], dtype=object)
        waiting, runs = np.zeros((0, 4), np.int64), np.zeros((0, 4), np.int64)
        if state.exists:
            key, *held = state.get
            names = pd.Index(list(key), dtype=object)
            waiting, runs = (np.frombuffer(bytes(h), np.int64).reshape(-1, 4) for h in held)
        if not state.hasTimedOut:
            some = pd.concat(list(batches), ignore_index=True)
            some = some[some["_i"].notna() & some["_t"].notna()]  # what has no place or no time is in no run
            number, new = pd.factorize(some["_key"])
            names = names.append(pd.Index(new, dtype=object).difference(names, sort=False))
            number = names.get_indexer(new)[number]
            waiting = np.concatenate([waiting, np.stack([number, *(some[c].to_numpy(np.int64) for c in ("_i", "_t", "_q"))], 1)])
        now = state.getCurrentWatermarkMs()
        ended, waiting, runs = advance_all(waiting, runs, now, idle)
        if not len(waiting) and not len(runs):
            state.remove()
        else:
            # again when all that waits of a key may be taken, or when an open run has been silent for long
            last = np.full(len(names), np.iinfo(np.int64).min)
            np.maximum.at(last, waiting[:, 0], waiting[:, 2])
            lone = runs[last[runs[:, 0]] == np.iinfo(np.int64).min]
            again = min(last[waiting[:, 0]].min(initial=np.iinfo(np.int64).max), (lone[:, 3] + idle).min(initial=np.iinfo(np.int64).max))
            kept = np.union1d(waiting[:, 0], runs[:, 0])
            state.update((names[kept].tolist(), *(np.column_stack([np.searchsorted(kept, x[:, 0]), x[:, 1:]]).tobytes() for x in (waiting, runs))))
            state.setTimeoutTimestamp(max(now + 1, int(again)))
        ended = ended[ended[:, 2] - ended[:, 1] >= least]
        if len(ended):
            yield pd.DataFrame({"key": names[ended[:, 0]], "start": ended[:, 1], "end": ended[:, 2]})

    out = timed.groupBy("_bucket").applyInPandasWithState(work, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    out = out.withColumn("key", F.from_json("key", "array<string>"))
    return out.select(*[_value(F.get("key", F.lit(n)), t).alias(k) for n, (k, t) in enumerate(zip(keys, kinds))], "start", "end")
