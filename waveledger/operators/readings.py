"""Spot readings: cleaning and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from waveledger import fixed_values as fv
from waveledger.functions import scalars as sc


def clean(readings: DataFrame, quantities: Sequence[str] = fv.QUANTITIES,
          value: str = "value") -> DataFrame:
    """Rows of the known quantities with a numeric value; anything else is left out."""
    number = sc.nan_to_null(F.col(value).try_cast("double"))
    return (readings.withColumn("quantity", sc.trimmed("quantity"))
            .where(F.col("quantity").isin(*quantities))
            .withColumn(value, number).where(F.col(value).isNotNull()))


def rejected(readings: DataFrame, quantities: Sequence[str] = fv.QUANTITIES,
             value: str = "value") -> DataFrame:
    """Rows of the known quantities that the strict rules refuse, with the reason."""
    number = F.col(value).try_cast("double")
    problem = (F.when(number.isNull(), "not a number").when(~sc.is_finite(number), "not finite")
               .when(number < 0, "negative"))
    return (readings.withColumn("quantity", sc.trimmed("quantity"))
            .where(F.col("quantity").isin(*quantities))
            .withColumn("problem", problem).where(F.col("problem").isNotNull()))


def clean_strict(readings: DataFrame, quantities: Sequence[str] = fv.QUANTITIES,
                 value: str = "value") -> DataFrame:
    """Like `clean`, but the job fails on a refused reading."""
    number = F.col(value).try_cast("double")
    good = sc.is_finite(number) & (number >= 0)
    checked = F.when(good, number).otherwise(
        F.raise_error(F.lit("invalid spot reading")).cast("double"))
    return (readings.withColumn("quantity", sc.trimmed("quantity"))
            .where(F.col("quantity").isin(*quantities)).withColumn(value, checked))


def stats(readings: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sample SD (null for one reading), RMS, min, max and unit per quantity."""
    v = F.col(value)
    out = readings.groupBy(*keys, "quantity").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sample_sd"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))
    return out.withColumn("unit", sc.map_lookup("quantity", fv.QUANTITY_UNITS))


def vector(readings: DataFrame, keys: Sequence[str],
           quantities: Sequence[str] = fv.QUANTITIES, value: str = "value") -> DataFrame:
    """Mean, population std, min and max of every quantity side by side; 0 when absent."""
    v = F.col(value)
    wide = readings.groupBy(*keys).pivot("quantity", list(quantities)).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"))
    return wide.na.fill(0.0, [c for c in wide.columns if c not in keys])


def variation(readings: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Population std / mean in percent per quantity (0 for mean 0), and the worst of them."""
    v = F.col(value)
    per = readings.groupBy(*keys, "quantity").agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    cv = F.when(F.col("_m") == 0, 0.0).otherwise(F.try_divide(F.col("_s"), F.col("_m")) * 100.0)
    per = per.withColumn("_cv", cv)
    return per.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("quantity", "_cv")))).alias("cv_pct"),
        F.max("_cv").alias("spot_cv_pct"))


def trend_bars(readings: DataFrame, setpoint: str, value: str = "value", width: int = 40) -> DataFrame:
    """Mean per quantity and setpoint, with a text bar relative to the quantity's largest mean."""
    per = readings.groupBy("quantity", setpoint).agg(F.avg(value).alias("mean"))
    top = per.groupBy("quantity").agg(F.max("mean").alias("_top"))
    scale = F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))
    length = F.bround(F.col("mean") / scale * width).cast("int")
    return per.join(top, "quantity").withColumn("bar", F.repeat(F.lit("#"), length)).drop("_top")
