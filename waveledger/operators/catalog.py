"""From folder listings and metadata files to a checked recordings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waveledger import fixed_values as fv, schemas
from waveledger.functions import ordered, scalars as sc
from waveledger.sources import files


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata CSV with an explicit schema; blanks become nulls."""
    return spark.read.schema(schemas.METADATA).option("header", True).csv(path)


def canonical_keys(df: DataFrame, operation_dir: str, reversal_dir: str) -> DataFrame:
    """Add `operation`, `reversal` and `condition` for a pair of folder names."""
    op, rev = (F.lower(sc.trimmed(c)) for c in (operation_dir, reversal_dir))
    operation = F.coalesce(sc.map_lookup(op, fv.OPERATIONS), sc.slugify(operation_dir))
    suffix = F.coalesce(sc.map_lookup(rev, {k: v[0] for k, v in fv.REVERSALS.items()}),
                        sc.slugify(reversal_dir))
    flag = F.coalesce(sc.map_lookup(rev, {k: v[1] for k, v in fv.REVERSALS.items()}),
                      F.lit("unknown"))
    return (df.withColumn("operation", operation).withColumn("reversal", flag)
            .withColumn("condition", F.concat(operation, F.lit("_"), suffix)))


def sensor_alias(df: DataFrame, folder: str) -> DataFrame:
    """Add `sensor` and `extension` for a sensor folder name; null when unknown."""
    key = F.lower(sc.trimmed(folder))
    return (df.withColumn("sensor", sc.map_lookup(
                key, {k: v[0] for k, v in fv.SENSOR_ALIASES.items()}))
            .withColumn("extension", sc.map_lookup(
                key, {k: v[1] for k, v in fv.SENSOR_ALIASES.items()})))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths relative to `root` with their lengths; contents are not read."""
    base = root.rstrip("/") + "/"
    return files.listing(spark, root).select(
        F.substr(F.col("path"), F.lit(len(base) + 1)).alias("path"),
        F.col("length").alias("file_size_bytes"))


def catalog_tree(listing: DataFrame) -> DataFrame:
    """Canonical metadata of a raw `<operation>/<reversal>/<sensor>/<file>` listing.

    Every file keeps a row; `skipped` says why a file is left out of the catalog (wrong
    depth, unknown sensor folder, partial download, no setpoint in its name).
    """
    parts = F.split("path", "/")
    df = listing.withColumn("_p", parts).withColumns({
        "_op": F.get(F.col("_p"), F.lit(0)), "_rev": F.get(F.col("_p"), F.lit(1)),
        "_sensor": F.get(F.col("_p"), F.lit(2)),
        "original_name": F.element_at(F.col("_p"), -1), "_depth": F.size("_p")})
    df = sensor_alias(canonical_keys(df, "_op", "_rev"), "_sensor")
    df = df.withColumn("speed_percent", sc.setpoint_from_name("original_name"))
    skipped = (F.when(F.col("_depth") != 4, "outside the tree")
               .when(F.col("sensor").isNull(), F.concat(F.lit("unknown sensor folder: "), "_sensor"))
               .when(F.col("original_name").endswith(".part"), "incomplete download")
               .when(F.col("speed_percent").isNull(), "no setpoint in name"))
    name = sc.recording_file_name("speed_percent", "sensor", "extension")
    new_path = F.concat_ws("/", F.lit("data"), "condition", "sensor", name)
    return df.withColumn("skipped", skipped).select(
        "condition", "operation", "reversal", "speed_percent", "sensor",
        F.substring("extension", 2, 10).alias("format"), "file_size_bytes",
        F.when(F.col("skipped").isNull(), new_path).alias("new_path"),
        "original_name", F.col("path").alias("original_path"), "skipped")


def add_unlisted(metadata: DataFrame, listing: DataFrame, path: str = "new_path") -> DataFrame:
    """Metadata plus files on disk that it lacks, keyed by their `condition/sensor/name`."""
    extra = listing.join(metadata.select(path), path, "left_anti")
    parsed = sc.parse_recording_name(sc.file_stem(path))
    parts = F.split(path, "/")
    extra = extra.select(
        path, F.element_at(parts, -3).alias("condition"),
        parsed["speed_percent"].alias("speed_percent"), parsed["sensor"].alias("sensor"))
    return metadata.unionByName(extra, allowMissingColumns=True)


def sorted_metadata(recordings: DataFrame) -> DataFrame:
    """Condition, sensor, setpoint order; a missing setpoint counts as 0."""
    keys = [F.coalesce("condition", F.lit("")), F.coalesce("sensor", F.lit("")),
            F.coalesce("speed_percent", F.lit(0))]
    return recordings.orderBy(*keys)


def of_sensors(recordings: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Rows of the given sensors that belong to an operating point."""
    return recordings.where(F.col("sensor").isin(*sensors) & F.col("condition").isNotNull()
                            & F.col("speed_percent").isNotNull())


def reindex(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The columns of `first` in that order (null when absent), then the others sorted."""
    have = set(df.columns)
    lead = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in first]
    return df.select(*lead, *sorted(have - set(first)))


def contract_violations(recordings: DataFrame, conditions: Sequence[str], path: str = "path",
                        min_common: int = 5, lo: int = 1, hi: int = 100,
                        required: Sequence[str] = ("sensor", "condition", "speed_percent")
                        ) -> DataFrame:
    """One row per rule with how often it is broken: (rule, violations)."""
    spark = recordings.sparkSession
    absent = [c for c in [*required, path] if c not in recordings.columns]
    if absent:
        return spark.createDataFrame([(f"missing column: {c}", 1) for c in absent],
                                     "rule string, violations bigint")
    used = recordings.where(F.col("condition").isin(*conditions))
    speed = F.col("speed_percent").cast("double")
    bad_speed = speed.isNull() | (speed != F.floor(speed)) | (speed < lo) | (speed > hi)
    classes = F.lit(len(set(conditions))) - F.count_distinct("condition")

    def surplus(by: list[str], rule: str) -> DataFrame:
        counts = used.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("_x"))
        return counts.agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("violations")).select(
            F.lit(rule).alias("rule"), "violations")

    common = common_setpoints(used, conditions).agg(
        F.greatest(F.lit(min_common) - F.count(F.lit(1)), F.lit(0)).alias("violations"))
    rules = [
        used.agg(classes.alias("violations")).select(F.lit("absent condition").alias("rule"),
                                                     "violations"),
        used.agg(F.count_if(bad_speed).alias("violations")).select(
            F.lit("setpoint not an integer in range").alias("rule"), "violations"),
        surplus(["condition", "speed_percent"], "repeated operating point"),
        surplus([path], "repeated path"),
        common.select(F.lit("too few common setpoints").alias("rule"), "violations"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.withColumn("violations", F.col("violations").cast("bigint"))


def require(violations: DataFrame) -> DataFrame:
    """Fail the job on the first broken rule; pass the table through otherwise."""
    return violations.withColumn("violations", F.when(
        F.col("violations") > 0, F.raise_error(F.concat(F.lit("contract broken: "), "rule"))
        .cast("bigint")).otherwise(F.col("violations")))


def common_setpoints(recordings: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Setpoints that every one of the given conditions has."""
    pairs = (recordings.where(F.col("condition").isin(*conditions))
             .select("speed_percent", "condition").distinct())
    return (pairs.groupBy("speed_percent").agg(F.count(F.lit(1)).alias("_c"))
            .where(F.col("_c") == len(set(conditions))).select("speed_percent"))


def keep_common_setpoints(recordings: DataFrame, conditions: Sequence[str]) -> DataFrame:
    return ordered.attach(recordings.where(F.col("condition").isin(*conditions)),
                          common_setpoints(recordings, conditions), ["speed_percent"],
                          recordings.columns)


def not_exactly_one(recordings: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Wanted keys that match no recording or several, with the count."""
    found = recordings.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return (wanted.join(found, list(keys), "left")
            .withColumn("matches", F.coalesce("matches", F.lit(0)))
            .where(F.col("matches") != 1))


def unsafe_paths(recordings: DataFrame, path: str, extensions: Sequence[str] = ()) -> DataFrame:
    return recordings.withColumn("problem", sc.path_problem(path, extensions))


def markdown_table_row(*cells: Column | str) -> Column:
    parts = [F.coalesce(sc.col(c).cast("string"), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def latex_table_row(*cells: Column | str) -> Column:
    parts = [F.coalesce(sc.col(c).cast("string"), F.lit("")) for c in cells]
    return F.concat(F.concat_ws(" & ", *parts), F.lit(r" \\"))


def class_index(labels: DataFrame, label: str, out: str = "class_index") -> DataFrame:
    """0-based rank of each label in sorted order.

    Ranks are computed over the distinct labels only and joined back.
    """
    from pyspark.sql import Window

    distinct = labels.select(label).distinct()
    ranked = distinct.withColumn(out, F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(label)) - 1)
    others = [c for c in labels.columns if c != label]
    return ordered.attach(labels, ranked, [label], others or [label])
