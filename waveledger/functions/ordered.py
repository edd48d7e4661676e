"""Ranks, running sums and exact quantiles that survive one huge group.

A plain `Window.partitionBy(key).orderBy(value)` sends a whole group to one task.
Here the order is cut into *slices* first: rows are ordered inside (key, slice),
and the few slice totals per key supply the offset.  A slice depends only on the
row's own value (or on exact aggregates), so a recomputed task gets the same slices.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waveledger.functions.scalars import col
from waveledger.sources import tables


def value_slice(value: Column | str, per_octave: int = 1024) -> Column:
    """Order-preserving slice number of a double; `per_octave` slices per factor of 2.

    Infinities lie in the slices of the largest finite values of their sign.
    """
    v = col(value).cast("double")
    size = F.least(F.greatest(F.abs(v), F.lit(1e-300)), F.lit(sys.float_info.max))
    level = F.floor((F.log2(size) + F.lit(1000.0)) * F.lit(float(per_octave))) + F.lit(1)
    return F.when(v > 0, level).when(v < 0, -level).otherwise(F.lit(0)).cast("bigint")


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], salt_on: Sequence[Column | str],
           how: str = "inner", salts: Column | int | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """Join one-row-per-key `facts` to `rows`, with each key of `rows` spread over salts.

    The number of salts follows from the rows of the largest key, counted in the same job, so
    that a key with a third of all rows is joined by as many tasks as it needs at any size; the
    facts are repeated that often, which is little because they are one row per key.  Small
    facts are broadcast instead when Spark measures them to be small enough.
    """
    if salts is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        n = sizes.agg((F.floor(F.coalesce(F.max("_n"), F.lit(0)) / F.lit(float(rows_per_task))) + 1)
                      .cast("int").alias("s")).scalar()
    else:
        n = salts if isinstance(salts, Column) else F.lit(salts)
    salt = F.pmod(F.xxhash64(*[col(c) for c in salt_on]), n).cast("int")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - F.lit(1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 slice_of: Column, sums: Mapping[str, Column | str],
                 totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums within `keys`, in `order`.

    `sums` maps output name -> summed column.  `totals` maps output name -> a name in
    `sums` whose grand total per key is wanted as well.  `slice_of` must not decrease
    along `order`; rows that tie in `order` get an arbitrary but complete order.
    """
    part = [*keys, "_slice"]
    measures = {f"_m_{name}": col(c) for name, c in sums.items()}
    sliced = df.withColumns({"_slice": slice_of, **measures})

    per_slice = sliced.groupBy(*part).agg(*[F.sum(m).alias(m) for m in measures])
    by_key = Window.partitionBy(*[F.col(k) for k in keys]) if keys else \
        Window.partitionBy(F.lit(0))
    before = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    extra = {out: F.sum(f"_m_{name}").over(by_key) for out, name in (totals or {}).items()}
    offsets = per_slice.select(
        *part,
        *[F.coalesce(F.sum(f"_m_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
          for name in sums],
        *[c.alias(out) for out, c in extra.items()])

    inside = Window.partitionBy(*part).orderBy(*[col(o) for o in order]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sliced.withColumns({f"_r_{name}": F.sum(f"_m_{name}").over(inside) for name in sums})
    out = ranked.join(offsets, part)
    out = out.withColumns({name: F.col(f"_r_{name}") + F.col(f"_o_{name}") for name in sums})
    return out.drop("_slice", *measures, *[f"_{p}_{n}" for p in "ro" for n in sums])


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key; nulls and NaN are ignored.

    A first pass counts rows per (key, slice), which combines on the map side to almost
    nothing and tells in which slices the wanted ranks lie.  Only rows of those slices (at
    most two per quantile) are then counted by value and ranked; nothing else is shuffled.
    Returns one row per key with a column per entry of `probs`.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(
        *keys, v.alias("_v"), value_slice(v).alias("_slice"))
    by_key = Window.partitionBy(*[F.col(k) for k in keys]) if keys else \
        Window.partitionBy(F.lit(0))
    before = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_m")).withColumns({
        "_before": F.coalesce(F.sum("_m").over(before), F.lit(0)),
        "_total": F.sum("_m").over(by_key)})

    def ranks(p: float) -> tuple[Column, Column, Column]:
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        return pos, F.floor(pos), F.ceil(pos)

    holds = F.lit(False)
    for p in probs.values():
        for rank in ranks(p)[1:]:
            holds = holds | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_m")))
    wanted = per_slice.where(holds).drop("_m")

    counts = rows.join(wanted, [*keys, "_slice"]).groupBy(
        *keys, "_slice", "_before", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))

    def at(rank: Column) -> Column:
        hit = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
        return F.max(F.when(hit, F.col("_v")))

    aggs = [at(rank).alias(f"_{side}_{name}") for name, p in probs.items()
            for side, rank in zip(("lo", "hi"), ranks(p)[1:])]
    out = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    cols = []
    for name, p in probs.items():
        pos, low, _ = ranks(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        # equal ends need no step, which infinite ones do not allow
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - low)).alias(name))
    return out.select(*keys, *cols)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value: how often it occurs and its tie-averaged rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    run = running_sums(counts, keys, [value], value_slice(value), {"_cum": "ties"},
                       totals={"n": "_cum"})
    return run.withColumn("avg_rank", F.col("_cum") - (F.col("ties") - 1) / F.lit(2.0)).drop("_cum")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 read off the clock fields, whatever the session time zone."""
    t = col(ts)
    seconds = F.unix_date(F.to_date(t)).cast("bigint") * 86_400 + F.hour(t) * 3600 \
        + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def index_by_time(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str,
                  target_rows: int = 200_000) -> DataFrame:
    """Add `i`, the 0-based position in time order within `keys`, and `n`, the key's count.

    Each key's own span is cut into equal slices, as many as it has `target_rows`; slices that
    hold a burst are cut once more the same way. So short, long and bursty recordings are all
    ordered about `target_rows` at a time; only equal times stay together.
    """
    timed = df.withColumn("_t", epoch_micros(ts))
    span = [F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_c")]
    parts = F.ceil(F.col("_c") / F.lit(float(target_rows)))

    def cut(t: Column) -> Column:
        return F.floor((t - F.col("_lo")).cast("double") * parts / (F.col("_hi") - F.col("_lo") + 1).cast("double"))

    # each key's own span first, then the slices that hold a burst, again by their own span
    def salts(facts: DataFrame) -> Column:
        return facts.agg((F.floor(F.coalesce(F.max("_c"), F.lit(0)) / F.lit(1e6)) + 1).cast("int").alias("s")).scalar()

    outer = tables.staged(timed.groupBy(*keys).agg(*span), "spans")
    if (outer.agg(F.max("_c")).first()[0] or 0) <= target_rows:
        # every recording fits one slice
        timed = timed.withColumns({"_s1": F.lit(0).cast("bigint"), "_s2": F.lit(0).cast("bigint")})
    else:
        keyed = attach(timed, outer, keys, ["_t"], salts=salts(outer)).withColumn("_s1", cut(F.col("_t"))).drop(
            "_lo", "_hi", "_c")
        inner = keyed.groupBy(*keys, "_s1").agg(*span)
        timed = attach(keyed, inner, [*keys, "_s1"], ["_t"], salts=salts(inner)).withColumn(
            "_s2", cut(F.col("_t"))).drop("_lo", "_hi", "_c")
    slice_of = F.col("_s1") * F.lit(1 << 32) + F.col("_s2")
    out = running_sums(timed, keys, ["_t", tiebreak], slice_of, {"_pos": F.lit(1).cast("bigint")},
                       totals={"n": "_pos"})
    return out.withColumn("i", F.col("_pos") - 1).drop("_pos", "_t", "_s1", "_s2")


def with_next(df: DataFrame, keys: Sequence[str], index: str, cols: Sequence[str],
              chunk: int = 65_536) -> DataFrame:
    """Add `next_<col>`: the value at index + 1 within `keys`, null at the end.

    Works chunk by chunk; the first row of a chunk is also sent to the chunk before it.
    """
    i = F.col(index)
    own = F.floor(i / F.lit(chunk))
    edge = (i % F.lit(chunk) == 0) & (i > 0)
    spread = df.withColumn("_chunk", F.explode(
        F.when(edge, F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(index)
    out = spread.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})
    return out.where(F.floor(i / F.lit(chunk)) == F.col("_chunk")).drop("_chunk")


def runs(df: DataFrame, keys: Sequence[str], index: str, flag: Column,
         slice_len: int = 65_536) -> DataFrame:
    """Maximal runs of consecutive indexes where `flag` holds: keys, start, end (exclusive).

    Runs are found inside index slices; only runs touching a slice edge (at most two per
    slice) are compared across slices.
    """
    i = F.col(index)
    hit = df.where(flag).select(*keys, i.alias("_i"), F.floor(i / F.lit(slice_len)).alias("_s"))
    local = Window.partitionBy(*keys, "_s").orderBy("_i")
    pieces = (hit.withColumn("_g", F.col("_i") - F.row_number().over(local))
              .groupBy(*keys, "_s", "_g")
              .agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end"))
              .withColumn("_edge", (F.col("start") % slice_len == 0)
                          | (F.col("end") % slice_len == 0))
              .drop("_g"))
    inner = pieces.where(~F.col("_edge")).select(*keys, "start", "end")
    return inner.unionByName(join_touching(pieces.where("_edge").select(*keys, "start", "end"), keys))


def join_touching(pieces: DataFrame, keys: Sequence[str], slice_len: int = 1 << 26) -> DataFrame:
    """Pieces of runs (keys, start, end) that touch, as one: first inside slices of indexes, then across.

    Merging is associative, so a key with very many pieces is not ordered by one task: after the
    first round only the first and the last of each slice can touch a piece of another slice.
    """
    def joined(df: DataFrame, by: Sequence[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start")
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (df.withColumn("_new", F.when(F.lag("end").over(order) == F.col("start"), 0).otherwise(1))
                .withColumn("_g", F.sum("_new").over(upto))
                .groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g"))

    first = joined(pieces.withColumn("_s", F.floor(F.col("start") / F.lit(slice_len))), [*keys, "_s"])
    inside = Window.partitionBy(*keys, "_s").orderBy("start")
    first = first.withColumn("_edge", F.lag("start").over(inside).isNull() | F.lead("start").over(inside).isNull()).drop("_s")
    return first.where(~F.col("_edge")).drop("_edge").unionByName(joined(first.where("_edge").drop("_edge"), keys))
