"""Exact dedup: 128-bit content hashes group the texts, bytes decide inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from waveledger.llm.shared import BLANK, checked, id_or_least, real_id, text_or_empty, with_columns
from waveledger.sources.tables import staged


def one_spaced(text: Column) -> Column:
    """Every run of ASCII white space as one space; nothing is trimmed."""
    return F.regexp_replace(text, F.lit(BLANK + "+"), F.lit(" "))


def hash_128(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _groups(texts: DataFrame, key: list[str]) -> DataFrame:
    """key, keep, rows, low, high: the least and the greatest text of a hash are the same, or it has several.

    Both are combined before they travel, so a task sends one row for each hash it has seen,
    however many copies there are.
    """
    return texts.groupBy(*key).agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows"),
                                   F.min("text").alias("low"), F.max("text").alias("high"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normal: Callable[[Column], Column] = one_spaced,
                content_hash: Callable[[Column], Column] = hash_128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `docs`.

    Texts are equal when `normal` makes the same bytes of them; a null text is an empty one. Of
    equal texts the row with the smallest id stays. Rows are grouped by `content_hash`; the
    least and the greatest text of a group are compared byte by byte, and where they differ (a
    collision) the texts themselves group the rows.

    A missing id is the smallest and stays null. Rows that repeat both id and text are counted
    in `group_size` and share their verdict; `keep_first` returns one of them. An empty table
    gives an empty result; other columns are not read.
    """
    checked(docs, id_col, text_col)
    texts = docs.select(id_or_least(id_col).alias("id"), normal(text_or_empty(text_col)).alias("text"))
    texts = texts.withColumn("hash", content_hash(F.col("text")))
    named = texts.select("id", "hash", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    groups = staged(_groups(texts, ["hash"]).select(
        "hash", "keep", "rows", (F.col("low") == F.col("high")).alias("alike")), "groups")
    alike = groups.filter("alike").drop("alike")
    marked = named.join(alike, "hash")
    mixed = groups.filter("not alike").select("hash")
    if not mixed.isEmpty():
        clash = texts.join(mixed, "hash", "left_semi")
        exact = clash.groupBy("hash", "text").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows"))
        apart = clash.join(exact, ["hash", "text"]).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        marked = marked.select("id", "keep", "rows", "text_sha256").union(
            apart.select("id", "keep", "rows", "text_sha256"))
    return marked.select(real_id(F.col("id")).alias("doc_id"), real_id(F.col("keep")).alias("keep_id"),
                         F.col("rows").alias("group_size"), (F.col("id") == F.col("keep")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               normal: Callable[[Column], Column] = one_spaced,
               content_hash: Callable[[Column], Column] = hash_128) -> DataFrame:
    """The rows of `docs` that stay, unchanged: one of each class of equal texts.

    Of rows that repeat the smallest id of a class, the one whose whole row hashes least stays
    (any of them if rows are equal).
    """
    checked(docs, id_col, text_col)
    text = normal(text_or_empty(text_col))
    order = F.struct(id_or_least(id_col), F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), order.alias("order"), text.alias("text"))
    # the text is part of the key, so that a collision parts
    least = rows.groupBy(content_hash(F.col("text")).alias("hash"), "text").agg(F.min_by("row", "order").alias("row"))
    return least.select(*with_columns(docs, "row", {}))
