"""Quality control: waveform integrity, quiet parts, checksums, duplicates, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import ordered
from waveledger.functions.scalars import is_finite


# Waveform rules ------------------------------------------------------------------

def waveform_violations(samples: DataFrame, headers: DataFrame, key: str, channel: str,
                        value: str = "value", padding: int = 2048) -> DataFrame:
    """One row per recording with the list of broken rules (empty list = fine).

    `headers` holds `fs` and the declared `frames` of every recording and, for compressed
    sources, `coded_frames`, which may differ by up to `padding` samples.
    """
    per_channel = samples.groupBy(key, channel).agg(
        F.count(F.lit(1)).alias("len"),
        F.sum(F.when(is_finite(value), 0).otherwise(1)).alias("bad"))
    got = per_channel.groupBy(key).agg(
        F.sum("bad").alias("bad"), F.max("len").alias("longest"), F.min("len").alias("shortest"))
    df = headers.join(got, key, "left")
    rules = {
        "empty": F.coalesce("longest", F.lit(0)) == 0,
        "non-finite": F.col("bad") > 0,
        "invalid rate": ~(is_finite("fs") & (F.col("fs") > 0)),
        "unequal channels": F.col("longest") != F.col("shortest"),
        "frame count": F.col("frames").isNotNull() & (F.col("longest") != F.col("frames")),
        "coded duration": F.abs(F.col("longest") - F.col("coded_frames")) > padding,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(key, F.coalesce("longest", F.lit(0)).alias("n_frames"),
                     found.alias("violations"))


# Quiet and flat parts ------------------------------------------------------------

def block_samples(fs: float, block_s: float = fv.QC_BLOCK_S) -> int:
    return max(1, round(block_s * fs))


def quiet_blocks(samples: DataFrame, keys: Sequence[str], block: int,
                 value: str = "value") -> DataFrame:
    """Complete blocks with their `flat` and `silent` flags.

    Silent: block RMS at most 1 % of the recording's median block RMS (or 1e-6 of its
    peak, if larger).  Flat: all samples of the block are equal.
    """
    v = F.col(value)
    complete = samples.where(F.col("i") < F.floor(F.col("n") / F.lit(block)) * block)
    blocks = (complete.groupBy(*keys, F.floor(F.col("i") / F.lit(block)).alias("block"))
              .agg(F.sqrt(F.avg(v * v)).alias("rms"), (F.max(v) == F.min(v)).alias("flat")))
    return mark_quiet(blocks, samples.groupBy(*keys).agg(F.max(F.abs(v)).alias("_peak")), keys)


def mark_quiet(blocks: DataFrame, peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `silent` to blocks (keys, block, rms), given the recordings' peaks."""
    typical = ordered.quantiles(blocks, keys, "rms", {"_median": 0.5})
    limits = typical.join(peaks, list(keys)).select(*keys, F.greatest(
        F.col("_median") * fv.QC_SILENT_SHARE,
        F.col("_peak") * fv.QC_SILENT_PEAK_SHARE).alias("_limit"))
    return (ordered.attach(blocks, limits, keys, ["block"])
            .withColumn("silent", F.col("rms") <= F.col("_limit")).drop("_limit"))


def quiet_runs(blocks: DataFrame, keys: Sequence[str], block: int, fs: float) -> DataFrame:
    """All runs of flat and of silent blocks: keys, kind, start_s, end_s."""
    kinds = F.array_compact(F.array(F.when(F.col("flat"), F.lit("flat")),
                                    F.when(F.col("silent"), F.lit("silent"))))
    spread = blocks.select(*keys, "block", F.explode(kinds).alias("kind"))
    found = ordered.runs(spread, [*keys, "kind"], "block", F.lit(True))
    scale = F.lit(block / fs)
    return found.select(*keys, "kind", (F.col("start") * scale).alias("start_s"),
                        (F.col("end") * scale).alias("end_s"),
                        (F.col("end") - F.col("start")).alias("blocks"))


def long_quiet_runs(runs: DataFrame, block: int, fs: float,
                    min_run_s: float = fv.QC_MIN_RUN_S) -> DataFrame:
    return runs.where(F.col("blocks") * F.lit(block / fs) >= F.lit(min_run_s))


def longest_quiet(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    span = F.col("end_s") - F.col("start_s")
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("kind") == "flat", span)), F.lit(0.0)).alias("flat_max_s"),
        F.coalesce(F.max(F.when(F.col("kind") == "silent", span)), F.lit(0.0)).alias("silent_max_s"))


def leading_quiet(samples: DataFrame, blocks: DataFrame, keys: Sequence[str], block: int,
                  fs: float) -> DataFrame:
    """Seconds before the first block that is neither flat nor silent.

    The whole length when no block is active; 0 when there is no complete block.
    """
    return leading_seconds(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), blocks, keys, block, fs)


def leading_seconds(sizes: DataFrame, blocks: DataFrame, keys: Sequence[str], block: int, fs: float) -> DataFrame:
    """The same from the recordings' lengths (keys, n)."""
    active = ~(F.col("flat") | F.col("silent"))
    first = blocks.groupBy(*keys).agg(F.min(F.when(active, F.col("block"))).alias("_first"),
                                      F.lit(True).alias("_has"))
    lead = (F.when(F.col("_has").isNull(), 0.0)
            .when(F.col("_first").isNull(), F.col("n") / F.lit(float(fs)))
            .otherwise(F.col("_first") * F.lit(block / fs)))
    return sizes.join(first, list(keys), "left").select(*keys, lead.alias("leading_quiet_s"))


def zero_baseline(codes: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Tell an intentional zero baseline from clipping at the lower rail.

    Baseline: more than 98 % of the zero codes form one run, and the 1st percentile of
    all other codes is at least 4.
    """
    zero = F.col(value) == 0
    longest = longest_run(ordered.runs(codes, keys, "i", zero), keys)
    counts = codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(zero).alias("clip_low"))
    rest = ordered.attach(codes.select(*keys, "i", value), longest, keys, ["i"], "left").where(
        F.col("base_start").isNull() | (F.col("i") < F.col("base_start"))
        | (F.col("i") >= F.col("base_end")))
    return baseline_verdict(counts, longest, ordered.quantiles(rest, keys, value, {"_p1": 0.01}), keys)


def longest_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base_start and base_end of the longest run of a key; of equal ones the first."""
    size = F.col("end") - F.col("start")
    return (runs.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct(size, -F.col("start"))).alias("_r"))
            .select(*keys, F.col("_r.start").alias("base_start"), F.col("_r.end").alias("base_end")))


def baseline_verdict(counts: DataFrame, longest: DataFrame, room: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The verdict from counts (n, clip_low), the longest run of zeros and the 1st percentile of other codes."""
    out = counts.join(longest, list(keys), "left").join(room, list(keys), "left")
    share = F.coalesce(F.try_divide(F.col("base_end") - F.col("base_start"), F.col("clip_low")),
                       F.lit(0.0))
    headroom = F.when(F.col("clip_low") > 0, F.floor("_p1").cast("bigint"))
    is_base = ((F.col("clip_low") > 0) & (share > fv.BASELINE_MIN_RUN_SHARE)
               & (headroom.isNull() | (headroom >= fv.BASELINE_MIN_HEADROOM_CODE)))
    return out.select(
        *keys, "n", "clip_low",
        F.coalesce(F.col("base_end") - F.col("base_start"), F.lit(0)).alias("base_run"),
        F.coalesce("base_start", F.lit(0)).alias("base_start"),
        share.alias("run_share"), headroom.alias("headroom_code"),
        is_base.alias("zero_is_baseline"))


# Files: checksums, duplicates, coverage of the listing ----------------------------

def checksums(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of whole contents; the content column is dropped."""
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).drop(content)


def checksum_manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """`digest  path` lines, sorted by path."""
    line = F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("  "), F.col(path))
    return files.select(F.col(path), line.alias("line")).orderBy(path)


def verify_checksums(recorded: DataFrame, current: DataFrame, path: str = "path",
                     digest: str = "sha256") -> DataFrame:
    """Every path of either side with status ok, changed, missing or new."""
    a = recorded.select(F.col(path), F.col(digest).alias("recorded"))
    b = current.select(F.col(path), F.col(digest).alias("current"))
    status = (F.when(F.col("current").isNull(), "missing")
              .when(F.col("recorded").isNull(), "new")
              .when(F.col("recorded") == F.col("current"), "ok").otherwise("changed"))
    return a.join(b, path, "full_outer").withColumn("status", status)


def duplicate_groups(hashed: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Digests shared by several files: how many, and the first path."""
    return (hashed.groupBy(digest).agg(F.count(F.lit(1)).alias("files"),
                                       F.min(path).alias("first_path"))
            .where(F.col("files") > 1))


def duplicate_peers(hashed: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Each duplicated file with its group: how many peers, and the name of one of them.

    The group is named by its digest instead of listing every peer on every row, so a
    group of k copies costs k rows and not k squared.  The named peer is the first path
    of the group (the last one for the first path itself).
    """
    groups = (hashed.groupBy(digest).agg(F.count(F.lit(1)).alias("_n"), F.min(path).alias("_lo"),
                                         F.max(path).alias("_hi")).where(F.col("_n") > 1))
    peer = F.when(F.col(path) == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo"))
    return ordered.attach(hashed.select(path, digest), groups, [digest], [path]).select(
        path, digest, (F.col("_n") - 1).alias("n_peers"), peer.alias("peer"))


def duplicate_summary(hashed: DataFrame, by: str, digest: str = "sha256") -> DataFrame:
    """Files, distinct contents and duplicate groups per sensor."""
    per = hashed.groupBy(by, digest).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(by).agg(F.sum("_n").alias("files"),
                               F.count(F.lit(1)).alias("unique_sha256"),
                               F.count_if(F.col("_n") > 1).alias("duplicate_groups"))


def unlisted_files(listing: DataFrame, metadata: DataFrame, path: str = "path") -> DataFrame:
    return listing.join(metadata.select(path), path, "left_anti")


# Summary -------------------------------------------------------------------------

def qc_summary(files: DataFrame, by: str, checks: Sequence[str],
               missing: DataFrame | None = None) -> DataFrame:
    """Per sensor: opened, checks passed of those checkable, clipping, quiet starts, variation.

    `files` has one row per file with `opened_ok`, the boolean `checks` (null = not
    checkable), `clipped`, `clip_fraction`, `leading_quiet_s` and `rms_variation_pct`.
    """
    passed = sum((F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in checks), F.lit(0))
    total = sum((F.col(c).isNotNull().cast("bigint") for c in checks), F.lit(0))
    out = files.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("opened_ok").alias("opened"),
        F.sum(passed).alias("meta_pass"), F.sum(total).alias("meta_total"),
        F.count_if("clipped").alias("clip_files"),
        (F.coalesce(F.max("clip_fraction"), F.lit(0.0)) * 100.0).alias("max_clip_pct"),
        F.count_if(F.col("leading_quiet_s") >= fv.QC_MIN_RUN_S).alias("quiet_start_files"),
        F.max("rms_variation_pct").alias("rms_max_pct"))
    mid = ordered.quantiles(files, [by], "rms_variation_pct", {"rms_median_pct": 0.5})
    out = out.join(mid, by, "left")
    if missing is not None:
        out = out.join(missing.groupBy(by).agg(F.count(F.lit(1)).alias("n_missing")), by, "left")
        out = out.withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    return out


def metadata_checks(files: DataFrame, rules: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """Add a three-valued check per rule: name -> (actual, expected, tolerance)."""
    from waveledger.functions.scalars import match_within

    return files.withColumns({name: match_within(a, e, tol) for name, (a, e, tol) in rules.items()})


def split_failures(decoded: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failure log)."""
    bad: Column = F.col(error).isNotNull()
    return decoded.where(~bad).drop(error), decoded.where(bad).select("path", error)
