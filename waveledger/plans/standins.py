"""The driver tables, read in the roles of the recording tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waveledger.functions import ordered
from waveledger.sources import tables

# Stand-in: order status -> sensor.
SENSOR_OF_STATUS = {"F": "sound_phone", "O": "sound_vibrometer", "P": "current"}

# Bands for 64-sample windows taken at a notional 64 Hz (bin k = k Hz).
UNIT_BANDS = [(0, 2), (2, 5), (5, 10), (10, 20), (20, 32)]
UNIT_RATE = 64.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_samples(spark: SparkSession, sf: str) -> DataFrame:
    """events as samples in no particular order."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"),
        "event_id", "ts", "value")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """events as indexed samples: recording_id, channel, ts, value, i, n."""
    return ordered.index_by_time(raw_samples(spark, sf), ["recording_id"], "ts", "event_id")


def staged_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed samples as a written table, for jobs that go over them several times."""
    return tables.staged(samples(spark, sf), "samples")


def gated_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed samples that are zero except for three event types: a signal with gaps."""
    live = F.col("channel").isin("click", "purchase", "signup")
    return staged_samples(spark, sf).withColumn("value", F.when(live, F.col("value")).otherwise(0.0))


def chunks(indexed: DataFrame, keys: list[str], size: int = 16) -> DataFrame:
    """Indexed samples as stored chunks: keys, n, start_sample, samples. A written table, as files would be."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "value")))
    made = (indexed.groupBy(*keys, "n", F.floor(F.col("i") / size).alias("c")).agg(pairs.alias("_p"))
            .select(*keys, "n", (F.col("c") * size).alias("start_sample"), F.transform("_p", lambda p: p["value"]).alias("samples")))
    return tables.staged(made, "chunks")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as 64-sample windows with a class and a recording key."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("label"),
        F.col("embedding").alias("samples"),
        F.concat(F.col("label").cast("string"), F.lit("_"),
                 (F.col("vec_id") % 10).cast("string")).alias("group_id"))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """orders as recording metadata."""
    sensor = F.create_map(*[F.lit(x) for kv in SENSOR_OF_STATUS.items() for x in kv])
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("recording_id"),
        F.col("o_orderpriority").alias("condition"),
        F.year("o_orderdate").cast("bigint").alias("speed_percent"),
        sensor[F.col("o_orderstatus")].alias("sensor"),
        F.format_string("data/%s/%012d.bin", F.col("o_orderstatus"),
                        F.col("o_orderkey")).alias("path"),
        F.col("o_totalprice").alias("duration_s"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files: path, condition, sensor, declared size and content."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("condition"), F.col("source").alias("sensor"),
        F.col("n_chars").alias("declared_size"), F.col("text").alias("content"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as spot readings."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"), F.col("l_returnflag").alias("quantity"),
        F.col("l_quantity").alias("value"))


# The same roles in SQL, as common table expressions. ------------------------------

SIG = """sig AS (
  SELECT user_id AS recording_id, event_type AS channel, ts, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""

GATED = SIG + """, gated AS (
  SELECT recording_id, channel, ts, i, n,
         CASE WHEN channel IN ('click', 'purchase', 'signup') THEN value ELSE 0.0 END AS value
  FROM sig)"""

WIN = """win AS (
  SELECT vec_id, CAST(label AS BIGINT) AS label,
         concat(CAST(label AS VARCHAR), '_', CAST(vec_id % 10 AS VARCHAR)) AS group_id,
         generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""

META = """meta AS (
  SELECT o_orderkey AS recording_id, o_orderpriority AS condition,
         CAST(year(o_orderdate) AS BIGINT) AS speed_percent,
         CASE o_orderstatus WHEN 'F' THEN 'sound_phone' WHEN 'O' THEN 'sound_vibrometer'
              WHEN 'P' THEN 'current' END AS sensor,
         printf('data/%s/%012d.bin', o_orderstatus, o_orderkey) AS path,
         o_totalprice AS duration_s
  FROM orders)"""

FILES = """files AS (
  SELECT doc_id, concat(lang, '/', source, '/', CAST(doc_id AS VARCHAR), '.txt') AS path,
         lang AS condition, source AS sensor, n_chars AS declared_size, text AS content
  FROM documents)"""

READ = """readings AS (
  SELECT l_suppkey AS recording_id, l_returnflag AS quantity, l_quantity AS value
  FROM lineitem)"""


def dft(source: str, key: str, n: int, weight: str, name: str = "dft") -> str:
    """CTE (key, k, re, im): a literal Fourier sum over rows (key, j, x) of `source`."""
    return f"""{name} AS (
  SELECT {key}, k,
         sum(x * ({weight}) * cos(2 * pi() * k * j / {n})) AS re,
         -sum(x * ({weight}) * sin(2 * pi() * k * j / {n})) AS im
  FROM {source}, (SELECT unnest(range({n // 2 + 1})) AS k) GROUP BY {key}, k)"""


def periodic_hann(n: int) -> str:
    return f"0.5 - 0.5 * cos(2 * pi() * j / {n})"


def symmetric_hann(n: int) -> str:
    return f"0.5 - 0.5 * cos(2 * pi() * j / ({n} - 1))"

# orders again, with many small operating points: a condition per customer. ----------

FLEET = """fleet AS (
  SELECT o_orderkey AS recording_id, concat('c', CAST(o_custkey AS VARCHAR)) AS condition,
         concat('op', CAST(o_custkey % 4 AS VARCHAR)) AS operation,
         CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS reversal,
         CAST(year(o_orderdate) - 1990 AS BIGINT) AS speed_percent,
         CASE o_orderstatus WHEN 'F' THEN 'sound_phone' WHEN 'O' THEN 'sound_vibrometer'
              WHEN 'P' THEN 'current' END AS sensor,
         printf('data/%s/%012d.bin', o_orderstatus, o_orderkey) AS path,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 END AS duration_s
  FROM orders)"""


def fleet(spark: SparkSession, sf: str) -> DataFrame:
    """orders as recordings of many conditions; every fifth duration is unknown."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("recording_id"), "o_custkey",
                                          "o_orderdate", "o_orderstatus", "o_totalprice")
    sensor = F.create_map(*[F.lit(x) for kv in SENSOR_OF_STATUS.items() for x in kv])
    return o.select(
        "recording_id", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("condition"),
        F.concat(F.lit("op"), (F.col("o_custkey") % 4).cast("string")).alias("operation"),
        F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("no").alias("reversal"),
        (F.year("o_orderdate") - 1990).cast("bigint").alias("speed_percent"),
        sensor[F.col("o_orderstatus")].alias("sensor"),
        F.format_string("data/%s/%012d.bin", F.col("o_orderstatus"),
                        F.col("recording_id")).alias("path"),
        F.when(F.col("recording_id") % 5 != 0, F.col("o_totalprice") / 1000).alias("duration_s"))
