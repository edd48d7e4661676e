"""Written tables: tidy results, and intermediate results that are reused."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a session without one gets a folder of its own, and only when it runs on one
    machine; a cluster has to name its folder in `spark.checkpoint.dir`.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="waveledger-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _stage_dir(spark: SparkSession) -> str:
    """One folder for all that this application stages."""
    return f"{shared_dir(spark).rstrip('/')}/waveledger/{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged.

    Tables that were built from staged ones must have been written or read before: call it when
    the results are out, at the end of a job.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_scope: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the folders that are staged inside, by this thread, in order."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)


def drop(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for folder in folders:
        where, fs = _fs(spark, folder)
        fs.delete(where, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a result once and continue from the written table (also cuts its lineage)."""
    path = f"{_stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _scope.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a finished table at `path`; build and write it first when it is not there.

    Only a write that ended (Spark's `_SUCCESS` marker) counts as finished.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# Tables that know their inputs ------------------------------------------------------
#
# Inputs are (key, length, digest). Their hashes are the leaves of a tree: a node for each bucket
# of keys holds the number and the sum of its leaves, and the nodes say whether anything changed
# without a key being compared. A run writes new folders for changed buckets only, and last the
# nodes, which name the folder of each bucket: what a lost job has written is never read.

_NODES = "bucket int, n bigint, total decimal(38,0), folder string, filled boolean"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, root: str) -> int:
    """Number of the last finished set of nodes, 0 if there is none."""
    where, fs = _fs(spark, root)
    if not fs.exists(where):
        return 0
    done = [s.getPath().getName() for s in fs.listStatus(where) if fs.exists(
        spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max([int(n.removeprefix("nodes-")) for n in done if n.startswith("nodes-")], default=0)


def _leaves(inputs: DataFrame, key: str, buckets: int) -> DataFrame:
    return inputs.select(key, F.xxhash64(key, "length", "digest").alias("_leaf"),
                         F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)).cast("int").alias("bucket"))


def _nodes(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_leaf").cast("decimal(38,0)")).alias("total"))


def changed_inputs(spark: SparkSession, root: str, inputs: DataFrame, key: str = "path", buckets: int = 64) -> DataFrame:
    """Keys whose length or digest is not what the table at `root` was built from, or that it lacks."""
    kept, leaves = _stored(spark, root), _leaves(inputs, key, buckets)
    if kept is None:
        return leaves.select(key)
    return leaves.join(_folders(spark, root, kept, "leaves", leaves), [key, "_leaf"], "left_anti").select(key)


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    at = _current(spark, root)
    return spark.read.schema(_NODES).parquet(f"{root}/nodes-{at}") if at else None


def _folders(spark: SparkSession, root: str, nodes: DataFrame, part: str, like: DataFrame | None = None) -> DataFrame:
    """Rows or leaves of the given nodes; a node is a folder, and there are `buckets` at most."""
    paths = [f"{root}/{r.folder}/{part}/bucket={r.bucket}" for r in nodes.collect() if part == "leaves" or r.filled]
    return spark.read.parquet(*paths) if paths else like.where("false")


def incremental_table(spark: SparkSession, root: str, inputs: DataFrame, build, key: str = "path",
                      buckets: int = 64) -> DataFrame:
    """A table of rows by key that follows its inputs: (key, length, digest), one row per key.

    `build` makes the rows of the keys it is given (a DataFrame with `key`); it is asked for new
    and changed keys only. Rows of keys that are gone go as well, and nothing is read or written
    if the inputs are the same. Of a changed bucket, the other rows are copied.
    """
    root = root.rstrip("/")
    leaves = staged(_leaves(inputs, key, buckets), "leaves")
    now, kept = _nodes(leaves), _stored(spark, root)
    if kept is None:
        kept = spark.createDataFrame([], _NODES)
    both = now.alias("a").join(kept.alias("b"), "bucket", "full").select(
        "bucket", F.col("a.n").alias("n"), F.col("a.total").alias("total"), F.col("b.folder").alias("folder"), F.col("b.filled").alias("filled"),
        (F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.total").eqNullSafe(F.col("b.total"))).alias("same"))
    both = staged(both, "nodes")  # one row per bucket
    if not both.where("not same").isEmpty():
        version = f"v-{uuid.uuid4().hex}"
        touched = both.where("not same and n is not null").select("bucket")
        here = leaves.join(F.broadcast(touched), "bucket")
        old = both.where("not same and folder is not null")
        before = _folders(spark, root, old, "leaves", leaves).select(key, "_leaf")
        made = build(here.join(before, [key, "_leaf"], "left_anti").select(key))
        still = here.join(before, [key, "_leaf"], "left_semi").select(key)
        rows = made.unionByName(_folders(spark, root, old, "rows", made).join(still, key, "left_semi"))
        rows = staged(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)).cast("int")), "rows")
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}/rows")
        here.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}/leaves")
        filled = rows.select("bucket", F.lit(True).alias("_has")).distinct()
        both.where("n is not null").join(filled, "bucket", "left").select(
            "bucket", "n", "total", F.when(F.col("same"), F.col("folder")).otherwise(F.lit(version)).alias("folder"),
            F.when(F.col("same"), F.col("filled")).otherwise(F.coalesce("_has", F.lit(False))).alias("filled")
        ).coalesce(1).write.parquet(f"{root}/nodes-{_current(spark, root) + 1}")
    stored = _stored(spark, root)
    none = build(leaves.select(key).where("false"))
    return none if stored is None else _folders(spark, root, stored, "rows", none)


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> None:
    """One folder per table in csv (with header), json or parquet."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(fmt).save(f"{root.rstrip('/')}/{name}")


def read_table(spark: SparkSession, root: str, name: str, like: DataFrame, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(like.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.format(fmt).load(f"{root.rstrip('/')}/{name}")


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Sorted lines as text, e.g. a checksum list: read in name order, the part files are the list."""
    lines.select(column).write.mode("overwrite").text(path)
