"""The quality table: one row per recording with every check side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.operators import quality, timefeat
from waveledger.sources.tables import staged


def file_table(samples: DataFrame, keys: Sequence[str], channel: str, fs: float, low: Column | None, high: Column | None,
               block: int | None = None, variation_samples: int | None = None,
               facts: Sequence[DataFrame] = (), rules: Mapping[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """Clipping, offset, quiet parts and variation of indexed samples (keys, channel, i, n, value).

    `facts` are further tables with one row per key, such as decode errors, duplicates or the
    spread of spot readings; keys without a row there get nulls. `rules` adds three-valued
    metadata checks on the columns of the result. `samples` are gone over several times, so a
    written table is best. All joins are between tables of one row per recording.
    """
    keys = list(keys)
    block = block or quality.block_samples(fs)
    blocks = staged(quality.quiet_blocks(samples, keys, block), "quiet-blocks")
    runs = quality.quiet_runs(blocks, keys, block, fs)
    out = timefeat.clipping(samples, keys, low, high)
    for part in (timefeat.worst_dc_offset(samples, keys, channel),
                 quality.leading_quiet(samples, blocks, keys, block, fs),
                 quality.longest_quiet(runs, keys),
                 timefeat.rms_variation(samples, keys, variation_samples or max(1, round(fs))), *facts):
        out = out.join(part, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("flat_max_s", "silent_max_s")})
    out = out.withColumn("quiet_start", F.col("leading_quiet_s") >= fv.QC_MIN_RUN_S)
    return quality.metadata_checks(out, rules) if rules else out
