"""Pairing sensors by operating point, expected inventories and coverage tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import scalars as sc

POINT = ["condition", "operation", "reversal", "speed_percent"]


@dataclass(frozen=True)
class SetpointRule:
    """Which setpoints an operation should have for a sensor."""

    setpoints: Sequence[int] = field(default_factory=lambda: list(fv.SETPOINTS))
    capped_operation: str = fv.CAPPED_OPERATION
    cap: int = fv.CAP_SETPOINT
    spot_sensor: str = fv.SPOT_SENSOR
    spot_skipped: Sequence[int] = field(default_factory=lambda: list(fv.SPOT_SKIPPED_SETPOINTS))


def pair(recordings: DataFrame, modalities: Sequence[str] = fv.MODALITIES,
         keys: Sequence[str] = POINT, path: str = "path") -> DataFrame:
    """Path and duration of every modality per operating point, in one shuffle.

    Of several recordings the lowest path counts.  Missing modalities stay null.
    """
    p, d = F.col(path), F.col("duration_s")
    wide = (recordings.where(F.col("sensor").isin(*modalities)).groupBy(*keys)
            .pivot("sensor", list(modalities))
            .agg(F.min(p).alias("path"), F.min_by(d, p).alias("duration")))
    renamed = [F.col(f"{m}_{x}").alias(f"{x}_{m}") for x in ("path", "duration") for m in modalities]
    group = sc.group_key("condition", "speed_percent").alias("group_id")
    return wide.select(*keys, group, *renamed)


def complete_pairs(paired: DataFrame, modalities: Sequence[str] = fv.MODALITIES) -> DataFrame:
    return paired.dropna(subset=[f"path_{m}" for m in modalities])


def fill_durations(paired: DataFrame, probed: DataFrame, fill: Sequence[str],
                   override: Sequence[str]) -> DataFrame:
    """Use probed durations (path, probed_s): only where missing, or always if measured."""
    out = paired
    for m in [*fill, *override]:
        mine = probed.select(F.col("path").alias(f"path_{m}"), F.col("probed_s").alias("_p"))
        have, measured = F.col(f"duration_{m}"), F.col("_p")
        order = [measured, have] if m in override else [have, measured]
        out = out.join(mine, f"path_{m}", "left").withColumn(
            f"duration_{m}", F.coalesce(*order)).drop("_p")
    return out


def missing_durations(paired: DataFrame, modalities: Sequence[str] = fv.MODALITIES) -> DataFrame:
    absent = F.array_compact(F.array(*[
        F.when(sc.nan_to_null(f"duration_{m}").isNull(), F.lit(m)) for m in modalities]))
    return paired.withColumn("without_duration", absent).where(F.size("without_duration") > 0)


def with_common_span(paired: DataFrame, modalities: Sequence[str] = fv.MODALITIES,
                     gate: str = "current",
                     min_duration_s: float = fv.MIN_CURRENT_DURATION_S) -> DataFrame:
    """Keep points whose gate sensor is long enough; add the span all modalities share."""
    durations = [F.col(f"duration_{m}") for m in modalities]
    return (paired.where(F.col(f"duration_{gate}") >= min_duration_s - fv.DURATION_TOLERANCE_S)
            .withColumn("common_duration_s", F.least(*durations)))


def modality_mask(paired: DataFrame, modalities: Sequence[str] = fv.MODALITIES) -> DataFrame:
    """Add a 0/1 `has_<modality>` per modality; points without any are dropped."""
    flags = {f"has_{m}": F.col(f"path_{m}").isNotNull().cast("int") for m in modalities}
    total = sum((F.col(f"has_{m}") for m in modalities), F.lit(0))
    return paired.withColumns(flags).withColumn("n_present", total).where(F.col("n_present") > 0)


# Expected inventory -----------------------------------------------------------------

def expected_setpoints(conditions: DataFrame, sensors: Sequence[str],
                       rule: SetpointRule = SetpointRule(), per_sensor: bool = True) -> DataFrame:
    """One row per expected (condition, operation, sensor, setpoint).

    `per_sensor=False` expects the waveform setpoints of every sensor, as the QC pass
    does; `per_sensor=True` leaves out the setpoints the spot sensor skips.
    """
    plain = F.array(*[F.lit(s) for s in rule.setpoints])
    capped = F.array(*[F.lit(s) for s in [*[s for s in rule.setpoints if s < rule.cap], rule.cap]])
    grid = F.when(F.col("operation") == rule.capped_operation, capped).otherwise(plain)
    out = (conditions.select("condition", "operation").distinct()
           .withColumn("sensor", F.explode(F.array(*[F.lit(s) for s in sensors])))
           .withColumn("speed_percent", F.explode(grid)))
    if per_sensor:
        out = out.where(~((F.col("sensor") == rule.spot_sensor)
                          & F.col("speed_percent").isin(*rule.spot_skipped)))
    return out


_SLOT = ["condition", "sensor", "speed_percent"]


def missing_slots(expected: DataFrame, present: DataFrame) -> DataFrame:
    have = present.select(*_SLOT).distinct()
    return expected.join(have, _SLOT, "left_anti").select(*_SLOT)


def unexpected_slots(expected: DataFrame, present: DataFrame) -> DataFrame:
    return present.select(*_SLOT).distinct().join(expected.select(*_SLOT), _SLOT, "left_anti")


def consistency_report(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Per condition and sensor: present, expected, and the missing and extra setpoints."""
    have = present.select(*_SLOT).distinct().withColumn("_have", F.lit(1))
    want = expected.select(*_SLOT).distinct().withColumn("_want", F.lit(1))
    both = want.join(have, _SLOT, "full_outer")
    s = F.col("speed_percent")

    def listed(flag):
        return F.array_sort(F.collect_list(F.when(flag, s)))

    gone, extra = F.col("_have").isNull(), F.col("_want").isNull()
    return both.groupBy("condition", "sensor").agg(
        F.count("_have").alias("present"), F.count("_want").alias("expected"),
        listed(gone).alias("missing"), listed(extra).alias("extra"))


def coverage_grid(present: DataFrame, setpoints: Sequence[int]) -> DataFrame:
    """Condition x sensor with an `x` or `·` per setpoint and the number present."""
    marks = present.groupBy("condition", "sensor").pivot("speed_percent", list(setpoints)).agg(
        F.max(F.lit("x")))
    marks = marks.na.fill("·", [str(s) for s in setpoints])
    counts = present.groupBy("condition", "sensor").agg(
        F.count_distinct("speed_percent").alias("count"))
    return marks.join(counts, ["condition", "sensor"])


def dataset_overview(manifest: DataFrame) -> DataFrame:
    """Paired groups and setpoint range per condition."""
    return manifest.groupBy("condition", "operation", "reversal").agg(
        F.count("group_id").alias("n_groups"),
        F.format_string("%d-%d", F.min("speed_percent").cast("bigint"),
                        F.max("speed_percent").cast("bigint")).alias("speed_range_percent"))


def inventory(recordings: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Files per sensor, total, distinct setpoints and duration range per condition.

    Setpoints are whole percents, so the listed set stays small.
    """
    return recordings.groupBy("condition").agg(
        *[F.count_if(F.col("sensor") == s).alias(s) for s in sensors],
        F.count(F.lit(1)).alias("total"),
        F.array_join(F.array_sort(F.collect_set("speed_percent")), ",").alias("setpoints"),
        F.min("duration_s").alias("duration_min"), F.max("duration_s").alias("duration_max"))


# Splits by setpoint ------------------------------------------------------------------

def leave_one_setpoint_out(groups: DataFrame, setpoint: str = "speed_percent") -> DataFrame:
    """Per held-out setpoint: test and training rows (train = everything else)."""
    per = groups.groupBy(setpoint).agg(F.count(F.lit(1)).alias("n_test"))
    total = per.agg(F.sum("n_test").alias("t")).scalar()
    return per.withColumn("n_train", total - F.col("n_test"))
