"""Opening files from tasks and turning decoded chunks into sample rows."""

from __future__ import annotations

import math
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from waveledger.sources.tables import staged


def open_input(path: str):
    """Seekable input for a local path or any URI that Arrow's file systems know."""
    from pyarrow import fs

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        local = unquote(parsed.path) if parsed.scheme else path
        return fs.LocalFileSystem().open_input_file(local)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


#: Bytes that one task reads, and files that one task opens for their headers.
TASK_BYTES = 32 << 20
TASK_FILES = 256


def spread(work: DataFrame, bytes_to_read: Column, *keys: str, partitions: int | None = None,
           fewest: int = 1) -> DataFrame:
    """Deal rows of work (ranges, paths) to tasks by the bytes they stand for.

    The rows themselves are tiny, so adaptive execution would put them into one task; the
    number of partitions is therefore explicit: the bytes over TASK_BYTES, or `fewest`. Each row
    opens a file, so it counts as the share of one of TASK_FILES at least.
    """
    if partitions is None:
        cost = F.greatest(F.coalesce(bytes_to_read.cast("double"), F.lit(0.0)), F.lit(TASK_BYTES / TASK_FILES))
        size = work.agg(F.sum(cost)).first()[0] or 0
        partitions = max(fewest, math.ceil(size / TASK_BYTES))
    return work.repartition(partitions, *keys)


def spread_files(listing: DataFrame) -> DataFrame:
    """Paths in as many partitions as opening them takes, TASK_FILES to a task."""
    paths = listing.select("path")
    return paths.repartition(max(1, math.ceil(paths.count() / TASK_FILES)), "path")


def frames(rows, columns: list[str], samples_at: int, budget: int = 4_000_000):
    """Pandas frames of row tuples, each holding about `budget` samples at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 0 if row[samples_at] is None else len(row[samples_at])
        if size >= budget or len(held) >= 10_000:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _children(folder: str, recursive: bool) -> list[tuple[str, int, bool]]:
    """(path, length, is_folder) below a folder, with paths in the form of `folder`."""
    from pyarrow import fs

    system, inner = (fs.FileSystem.from_uri(folder) if "://" in folder
                     else (fs.LocalFileSystem(), folder))
    scheme = folder[:len(folder) - len(inner)] if folder.endswith(inner) else ""
    found = system.get_file_info(fs.FileSelector(inner, recursive=recursive))
    return [(scheme + f.path, f.size or 0, f.type == fs.FileType.Directory) for f in found]


def listing(spark, root: str, extension: str | None = None, spread_levels: int = 2) -> DataFrame:
    """Paths and lengths of all files below a folder, listed by tasks.

    The first levels are listed folder by folder so that their subfolders spread over
    tasks.  (Spark's own file sources leave out empty files, which a catalog must show.)
    """
    schema = "path string, length bigint, is_folder boolean"

    def lister(recursive: bool):
        def run(batches):
            held = []  # of many folders with few files each, not a frame for every one
            for batch in batches:
                for folder in batch["path"]:
                    held += _children(folder, recursive)
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=["path", "length", "is_folder"])
                        held = []
            if held:
                yield pd.DataFrame(held, columns=["path", "length", "is_folder"])
        return run

    folders = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    out = None
    for level in range(spread_levels + 1):
        # written, so that no level is listed again for the next one or for each reader
        found = staged(folders.mapInPandas(lister(level == spread_levels), schema), "listed")
        here = found.where(~F.col("is_folder")).select("path", "length")
        out = here if out is None else out.unionByName(here)
        folders = found.where("is_folder").select("path")
        n = folders.count()
        if n == 0:
            break
        folders = folders.repartition(math.ceil(n / TASK_FILES), "path")
    return out if extension is None else out.where(F.col("path").endswith(extension))


def contents(spark, root: str, extension: str | None = None) -> DataFrame:
    """Whole small files: path and content.  Spark leaves out empty files here."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    return reader.load(root).select("path", "content")


def write_contents(contents: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below `root` from tasks; returns their number.

    A repeated task writes the same bytes to the same place.
    """
    def run(batches):
        from pyarrow import fs

        parsed = urlparse(root)
        system, inner = ((fs.LocalFileSystem(), unquote(parsed.path)) if parsed.scheme in ("", "file")
                         else fs.FileSystem.from_uri(root))
        made = None
        for batch in batches:
            for path, data in batch.itertuples(index=False):
                target = f"{inner.rstrip('/')}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder != made:
                    system.create_dir(folder, recursive=True)
                    made = folder
                with system.open_output_stream(target) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"n": [len(batch)]})

    return contents.select("path", "content").mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def checksums(listing: DataFrame, block: int = 1 << 20) -> DataFrame:
    """SHA-256 of files on storage, read block by block: (path, sha256, error).

    Unlike a hash of a content column this works for files of any size.
    """
    def run(batches):
        import hashlib

        for batch in batches:
            rows = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                try:
                    with open_input(path) as f:
                        while data := f.read(block):
                            digest.update(data)
                    rows.append((path, digest.hexdigest(), None))
                except OSError as exc:
                    rows.append((path, None, f"cannot read: {exc}"))
            yield pd.DataFrame(rows, columns=["path", "sha256", "error"])

    # dealt in turn: by hash of the path, two of few large files may meet in a task
    return spread(listing.select("path", "length"), F.col("length")).select("path").mapInPandas(
        run, "path string, sha256 string, error string")


def samples_long(chunks: DataFrame, key: str = "path") -> DataFrame:
    """One row per sample: key, channel, i, fs, value."""
    good = chunks.where(F.col("samples").isNotNull())
    return good.select(key, "channel", "start_sample", "fs",
                       F.posexplode("samples").alias("_k", "_v")).select(
        key, "channel", (F.col("start_sample") + F.col("_k")).alias("i"), "fs",
        F.col("_v").cast("double").alias("value"))


def centred_chunks(chunks: DataFrame, keys=("path", "channel")) -> DataFrame:
    """Remove each recording's mean from its chunks (chunk sums are combined first).

    Centred samples are doubles.
    """
    from waveledger.functions import arrays as A, ordered

    sums = chunks.where(F.col("samples").isNotNull()).groupBy(*keys).agg(
        (F.sum(A.total("samples")) / F.sum(F.size("samples"))).alias("_mean"))
    return (ordered.attach(chunks, sums, keys, ["start_sample"])
            .withColumn("samples", A.centred("samples", F.col("_mean"))).drop("_mean"))
