"""What several corpus operators need: row identity, distributed ranks, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from waveledger.sources.tables import staged

#: ASCII white space, as a regular expression class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Identifier that stands for a missing one; it sorts before all others.
NO_ID = -(2**63)
#: Rows that one task ranks.
RANK_ROWS = 4_096


class Recent(dict):
    """A bounded cache in a Python worker: `self[key]` is `make(key)`, kept while it is used.

    A full generation becomes the old one; what is asked for again moves to the new one.
    Keys longer than 64 characters or bytes are not kept.
    """

    def __init__(self, make: Callable | None, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > 64:
                return got
        self.renew()
        self[key] = got
        return got

    def renew(self) -> None:
        """Begin a generation if this one is full."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_or_least(col: str) -> Column:
    """The identifier as a long; a missing one counts as the smallest."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def real_id(col: Column) -> Column:
    """Undo `id_or_least`."""
    return F.when(col != NO_ID, col)


def with_columns(original: DataFrame, row: str, added: dict[str, Column]) -> list[Column]:
    """Select list of all fields of the struct `row`, in order, with `added` replacing or following."""
    keep = [added.get(c, F.col(row).getField(c)).alias(c) for c in original.columns]
    return keep + [v.alias(k) for k, v in added.items() if k not in original.columns]


def checked(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, or an error that names the columns it lacks or has twice."""
    wrong = [c for c in columns if df.columns.count(c) != 1]
    if wrong:
        raise ValueError(f"need exactly one column of each name: {wrong}; have {df.columns}")
    return df


def ranked(df: DataFrame, keys: list[str], by: str, ties: list[str], n: int, rank: str,
           total: str | None = None) -> DataFrame:
    """Number the rows of each key from 0 in the order of `by` (a hash, spread over all longs).

    No task gets a whole key: rows are ordered inside slices of `by`, and the rows of the
    slices before come from a table with one row per key and slice. `keys` must not be null.
    `n` is the number of rows; `total`, if named, receives the rows of the key.
    """
    bits = (n // RANK_ROWS).bit_length()
    slice_of = F.shiftright(F.col(by), 64 - bits) if bits else F.lit(0).cast("long")
    df = df.withColumn("_slice", slice_of)
    counts = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    facts = [F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before")]
    if total:
        facts.append(F.sum("_rows").over(Window.partitionBy(*keys)).alias(total))
    counts = counts.select(*keys, "_slice", *facts)
    inside = Window.partitionBy(*keys, "_slice").orderBy(by, *ties)
    return (df.join(counts, [*keys, "_slice"])
            .withColumn(rank, F.col("_before") + F.row_number().over(inside) - 1)
            .drop("_slice", "_before"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge the smallest node it is connected to.

    Alternating star contraction: every node hands its larger neighbours to its smallest one,
    then its smaller neighbours, until nothing changes. Each round is written to the shared
    folder, so lineage stays short and a lost executor repeats one round at most.
    """
    tables = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = tables.union(tables.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (tables.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
                 .select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        tables = staged(small, "edges")
        now = tuple(tables.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return tables.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        tables.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def long_type(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
