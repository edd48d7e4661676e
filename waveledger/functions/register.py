"""Names for SQL users: spectra, windows of an array as a table, and votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import arrow_udf

from waveledger.functions import spectra


#: SQL functions, spelled in SQL: the optimiser takes them apart, no Python runs.
SQL_FUNCTIONS = {
    # all complete windows of an array; none if it is null or shorter than a window
    "windows_of": """(samples ARRAY<DOUBLE>, size INT, hop INT)
RETURNS TABLE (segment_index BIGINT, start_sample BIGINT, segment ARRAY<DOUBLE>)
RETURN SELECT k, k * hop, slice(samples, CAST(k * hop + 1 AS INT), size)
FROM explode(CASE WHEN size(samples) >= size THEN sequence(0L, CAST((size(samples) - size) DIV hop AS BIGINT)) ELSE array() END) AS t(k)""",
    # one row for each window: what remains after its mean is removed
    "window_features": """(segment ARRAY<DOUBLE>)
RETURNS TABLE (n INT, mean DOUBLE, rms DOUBLE, peak_to_peak DOUBLE, crest DOUBLE, kurtosis DOUBLE)
RETURN SELECT n, mean, sqrt(m2), hi - lo, try_divide(greatest(hi - mean, mean - lo), sqrt(m2)), try_divide(m4, m2 * m2)
FROM (SELECT n, mean, array_max(segment) AS hi, array_min(segment) AS lo,
        try_divide(aggregate(segment, 0D, (a, x) -> a + (x - mean) * (x - mean)), n) AS m2,
        try_divide(aggregate(segment, 0D, (a, x) -> a + (x - mean) * (x - mean) * (x - mean) * (x - mean)), n) AS m4
      FROM (SELECT size(segment) AS n, try_divide(aggregate(segment, 0D, (a, x) -> a + x), size(segment)) AS mean))""",
    # the most frequent value; of equally frequent ones the lowest
    "majority": """(votes ARRAY<DOUBLE>)
RETURNS DOUBLE
RETURN try_element_at(array_sort(transform(array_distinct(array_compact(votes)), v -> named_struct(
  'n', -size(filter(votes, w -> w = v)), 'v', v))), 1).v""",
}


def register(spark: SparkSession) -> None:
    """Make functions callable from SQL.

    `amplitude_spectrum(samples)`, `power_spectrum(samples)` (squared magnitude of the centred
    samples) and `majority(votes)` give a value. `windows_of(samples, size, hop)` and
    `window_features(segment)` are tables, for lateral joins.
    """
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    doubles = T.ArrayType(T.DoubleType())

    @arrow_udf(doubles)
    def amplitude_spectrum(a: pa.Array) -> pa.Array:
        return spectra.amplitude_rows(a)

    @arrow_udf(doubles)
    def power_spectrum(a: pa.Array) -> pa.Array:
        return spectra.map_rows(a, lambda b: np.abs(np.fft.rfft(b, axis=1)) ** 2, centre=True)

    spark.udf.register("amplitude_spectrum", amplitude_spectrum)
    spark.udf.register("power_spectrum", power_spectrum)
