"""Choosing the reader of a recording by its sensor and format."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.sources import deep_memory, scope_bin, scope_csv, wav
from waveledger.sources.files import TASK_BYTES, TASK_FILES, open_input, spread
from waveledger.sources.tables import staged


def reader_of(path: str = "path"):
    """Reader name by file extension; null for formats without a reader."""
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    return (F.when(ext == "bin", "scope_bin").when(ext == "wav", "wav")
            .when(ext == "wfm", "deep_memory").when(ext == "csv", "scope_csv"))


def sniffed(listing: DataFrame, found: str = "_reader") -> DataFrame:
    """Add the reader named by a file's first bytes, null where they name none."""
    def run(batches):
        for batch in batches:
            names = []
            for path in batch["path"]:
                try:
                    with open_input(path) as f:
                        head = f.read(12)
                except OSError:
                    head = b""
                names.append("scope_bin" if head[:4] in fv.SCOPE_MAGICS else
                             "wav" if head[:4] == b"RIFF" and head[8:] == b"WAVE" else None)
            yield batch.assign(**{found: names})

    dealt = spread(listing.select("path", "length"), F.lit(TASK_BYTES // TASK_FILES), "path")
    return dealt.mapInPandas(run, f"path string, length bigint, {found} string")


def read_waveforms(listing: DataFrame, chunk: int = 65_536, offset_s: float = 0.0,
                   duration_s: float | None = None, mode: str = "all") -> DataFrame:
    """Chunks (path, channel, start_sample, fs, samples, error) of all files of a listing.

    The span holds for all formats. Readers go by file extension; where that names none, by the
    first bytes. Every listed file gives samples or an error row: files without a reader,
    unreadable ones and those without samples in the span.
    """
    named = staged(listing.select("path", "length"), "listing").withColumn("_reader", reader_of())
    tagged = named.where("_reader IS NOT NULL").unionByName(
        staged(sniffed(named.where("_reader IS NULL")), "sniffed"))

    def of(reader: str) -> DataFrame:
        return tagged.where(F.col("_reader") == reader).select("path", "length")

    scope = scope_bin.read_chunks(of("scope_bin"), chunk, offset_s, duration_s)
    audio = wav.read_chunks(of("wav"), mode, offset_s, duration_s, chunk)
    table = scope_csv.read_chunks(of("scope_csv"), chunk, offset_s, duration_s)
    deep = deep_memory.read_chunks(of("deep_memory"), chunk=chunk, offset_s=offset_s, duration_s=duration_s).select(
        "path", "channel", "start_sample", "fs",
        F.transform("codes", lambda c: (c * F.col("lsb")).cast("float")).alias("samples"), "error")
    none = tagged.where("_reader IS NULL").select("path", F.lit("no reader").alias("error"))
    out = scope
    for part in (audio, table, deep, none):
        out = out.unionByName(part, allowMissingColumns=True)
    return out
