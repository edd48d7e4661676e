"""Proportional stratified interleaving: shards of equal row counts that share the source mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waveledger.llm.shared import RANK_ROWS, checked, id_or_least, ranked, text_or_empty
from waveledger.sources.tables import staged


def seeded(seed: int, *parts: Column | str) -> Column:
    """A long that shuffles rows: XXH64 of the seed and the parts, joined by colons."""
    return F.xxhash64(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p
                                                           for p in parts]))


def interleave(rows: DataFrame, source: str, shuffle: str, ties: list[str], shards: int) -> DataFrame:
    """Add `shard` (from 0) and `slot` (from 0, gapless in its shard) to staged rows.

    Rows are ranked by `shuffle` within their source; (rank + phase) / rows of the source is the
    row's place in the mixture. The phase, from 0 to 1, is a hash of the source, so that sources
    of one size do not move in step and sources of a few rows do not meet in one shard. All rows
    in the order of their places are cut into `shards` runs whose lengths differ by one at most,
    so every shard has each source's share but for rounding: the cuts are off by half a row for
    each source at most, whatever the number of rows. Equal places are ordered by source, then
    `shuffle`, then `ties`. A null source is a
    source of its own. An empty table gives an empty result; with fewer rows than shards some
    shards are empty.
    """
    n = rows.count()
    rows = (rows.withColumn("_missing", F.col(source).isNull())
            .withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit(""))))
    keys = ["_missing", "_source"]
    placed = ranked(rows, keys, shuffle, ties, n, "_rank", "_of")
    phase = F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(2**53))
    placed = placed.withColumn("_place", (F.col("_rank") + phase) / F.col("_of"))
    slices = n // RANK_ROWS + 1
    placed = placed.withColumn("_cut", F.floor(F.col("_place") * slices))
    counts = placed.groupBy("_cut").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_cut", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cut").orderBy("_place", *keys, shuffle, *ties)
    placed = (placed.join(counts, "_cut")
              .withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1))
    shard = F.expr(f"_at * {shards} div {max(n, 1)}")
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return (placed.withColumn("_shard", shard).withColumn("_first", first)
            .select(*[c for c in rows.columns if c not in keys], F.col("_shard").cast("int").alias("shard"),
                    (F.col("_at") - F.col("_first")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: shard sizes are at most one row apart. `grown_shard` is null, as only
    the law `key` has one. A null text has no bytes, a null id is allowed; rows that are equal
    in all columns are interchangeable, all others have a fixed place. Other columns are not read.
    """
    checked(docs, id_col, text_col, source_col)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("_id", id_or_least("doc_id"))
    rows = staged(rows.withColumn("_mix", seeded(seed, "_id", "text_crc32")), "shard")
    out = interleave(rows, "source", "_mix", ["_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
