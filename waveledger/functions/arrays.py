"""Sums and reshaping over sample arrays (one bounded window or chunk per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from waveledger.functions.scalars import col


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it inside `fn`.

    A plain column reference inside a lambda may be inlined by the optimiser and then be
    computed again for every array element.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(a: Column | str, fn: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + fn(x.cast("double")))


def mean(a: Column | str) -> Column:
    return F.try_divide(total(a), F.size(col(a)).cast("double"))


def centred(a: Column | str, centre: Column) -> Column:
    return let(centre, lambda c: F.transform(col(a), lambda x: x.cast("double") - c))


def peak(a: Column | str) -> Column:
    """Largest absolute value."""
    return F.greatest(F.abs(F.array_max(col(a))), F.abs(F.array_min(col(a))))


def sign_changes(a: Column | str) -> Column:
    """How many neighbouring pairs have a strictly negative product."""
    state = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        col(a), state,
        lambda acc, x: F.struct(
            x.cast("double").alias("prev"),
            (acc["n"] + F.when(acc["prev"] * x < 0, 1).otherwise(0)).cast("bigint").alias("n")),
        lambda acc: acc["n"])


def fit_length(a: Column | str, n: int) -> Column:
    """Cut or zero-pad to exactly n samples."""
    values = F.transform(F.slice(col(a), 1, n), lambda x: x.cast("double"))
    short = F.greatest(F.lit(n) - F.size(col(a)), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(0.0), short))


def mono(channels: Column | str) -> Column:
    """Sample-wise mean of an array of equally long channel arrays."""
    c = col(channels)
    first = F.transform(c[0], lambda x: x.cast("double"))
    rest = F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    summed = F.aggregate(
        rest, first,
        lambda acc, ch: F.zip_with(acc, ch, lambda x, y: x + y.cast("double")))
    return let(F.size(c).cast("double"), lambda n: F.transform(summed, lambda x: x / n))


def standardised(a: Column | str, epsilon: float = 1e-6) -> Column:
    """(x - mean) / (population std + epsilon)."""
    def scaled(ac: Column) -> Column:
        sd = F.sqrt(F.try_divide(total(ac, lambda x: x * x), F.size(ac).cast("double")))
        return let(sd + F.lit(epsilon), lambda d: F.transform(ac, lambda x: x / d))

    return let(centred(a, mean(a)), scaled)
