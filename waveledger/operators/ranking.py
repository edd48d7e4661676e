"""Top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows per group.

    Spark limits each group to k rows before the shuffle, so a large group stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
