"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waveledger.llm.shared import WORD, checked, id_or_least, text_or_empty, with_columns

#: Lines of one window.
LINES = 3


def _windows(lines: Column) -> Column:
    """One struct for each window: k (of its first line) and two independent 64-bit hashes."""
    starts = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - (LINES - 1), F.lit(0)))

    def window(first: Column, k: Column) -> Column:
        text = F.concat_ws("\n", first, *[F.get(lines, k + j) for j in range(1, LINES)])
        return F.struct(k.alias("k"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))

    return F.transform(starts, window)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_id, _h, ks): of each document the windows whose three lines also occur earlier.

    `docs` has _id, _h (that name a document; equal ones are one document) and _lines.
    The first occurrence of a window is found by an aggregate that Spark combines before the
    shuffle; the join that marks later ones may be split by adaptive execution, so a window
    that a third of all documents share needs no task of its own.
    """
    windows = (docs.select("_id", "_h", F.explode(_windows(F.col("_lines"))).alias("w"))
               .select("_id", "_h", "w.k", "w.h1", "w.h2"))
    place = F.struct("_id", "_h", "k")
    firsts = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .filter("first <> last").select("h1", "h2", "first"))
    later = windows.join(firsts, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("_id", "_h").agg(F.collect_set("k").alias("ks"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with `text_col` stripped of repeated passages of three or more lines.

    Lines are separated by \\n. Lines without a word (white space only) are skipped when windows
    are formed and always stay. A window of three consecutive lines is removed if the same three
    lines start earlier: in a document of smaller id (a null id is the smallest; of equal ids
    the text hash decides) or earlier in this one. Removed windows are merged, so a line goes if
    any removed window covers it. Documents of fewer than three lines keep all of them. A null
    text stays null, an empty one empty; equal rows are one document and all keep what it keeps.

    Added (replacing columns of these names): n_lines, lines with a word; n_removed_lines.
    """
    checked(docs, id_col, text_col)
    text = text_or_empty(text_col)
    rows = docs.select(F.struct("*").alias("row"), id_or_least(id_col).alias("_id"),
                       F.xxhash64(text).alias("_h"))
    keyed = docs.select(id_or_least(id_col).alias("_id"), F.xxhash64(text).alias("_h"),
                        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    out = rows.join(repeated_windows(keyed), ["_id", "_h"], "left")
    out = out.withColumn("_all", F.split(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), "\n"))
    out = out.withColumn("_covered", F.array_distinct(F.flatten(F.transform(
        F.coalesce("ks", F.array().cast("array<int>")),
        lambda k: F.array(*[k + j for j in range(LINES)])))))
    real = F.filter(F.transform(F.col("_all"), lambda x, i: F.when(x.rlike(WORD), i)), F.isnotnull)
    out = out.withColumn("_real", real)
    # positions among lines with a word -> positions among all lines
    out = out.withColumn("_gone", F.transform("_covered", lambda k: F.get("_real", k)))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_gone")), lambda i: F.get("_all", i))
    out = out.withColumn("_kept", kept)
    added = {
        text_col: F.when(F.col("row").getField(text_col).isNotNull(),
                         F.when(F.size("_covered") == 0, F.col("row").getField(text_col).cast("string"))
                         .otherwise(F.array_join("_kept", "\n"))),
        "n_lines": F.size("_real").cast("long"),
        "n_removed_lines": F.size("_covered").cast("long"),
    }
    return out.select(*with_columns(docs, "row", added))
