"""Catalog, manifest, set and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waveledger import fixed_values as fv, schemas
from waveledger.functions import scalars as sc
from waveledger.functions.scalars import rounded
from waveledger.operators import catalog, manifest
from waveledger.plans import standins as S
from waveledger.plans.registry import query
from waveledger.sources import tables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sql_map(column: str, table: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} END"


_SINGLE = {k: v for k, v in fv.TRANSLITERATION.items() if len(v) == 1}


def _sql_slug(column: str) -> str:
    out = f"lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'))"
    for k, v in fv.TRANSLITERATION.items():
        if len(v) != 1:
            out = f"replace({out}, '{k}', '{v}')"
    out = f"translate({out}, '{''.join(_SINGLE)}', '{''.join(_SINGLE.values())}')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9]+', '_', 'g'), '_')"
    return f"coalesce(nullif({out}, ''), 'unknown')"


# Listing and metadata ---------------------------------------------------------------

_OPS = {"en": "Нормална работа", "de": "разхлабен фундамент", "fr": "Неоптимално управление ",
        "es": "Нов щанд: юг"}
_FOLDERS = {"0": "вибрации", "1": "звук", "2": "ТОК", "3": "ток - кр2=0.1", "4": "непознат"}

_TREE = f"""tree AS (
  SELECT concat({_sql_map('lang', _OPS)}, '/',
      CASE WHEN n_chars % 3 = 0 THEN 'без реверсиране' WHEN n_chars % 3 = 1 THEN 'С реверсиране' ELSE 'друго' END, '/',
      {_sql_map("CAST(CAST(substr(source, 4) AS INT) % 5 AS VARCHAR)", _FOLDERS)}, '/',
      CASE WHEN doc_id % 11 = 0 THEN 'бележка' ELSE concat(' ', CAST(doc_id % 101 AS VARCHAR), ' проц') END,
      '_', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 7 = 0 THEN '.part' ELSE '.dat' END) AS path,
    n_chars AS file_size_bytes
  FROM documents)"""


def _tree(spark, sf):
    d = S.table(spark, sf, "documents")
    n = F.col("doc_id")
    return d.select(
        F.concat(
            sc.map_lookup("lang", _OPS), F.lit("/"),
            F.when(F.col("n_chars") % 3 == 0, "без реверсиране")
            .when(F.col("n_chars") % 3 == 1, "С реверсиране").otherwise("друго"), F.lit("/"),
            sc.map_lookup((F.substring("source", 4, 10).cast("int") % 5).cast("string"), _FOLDERS),
            F.lit("/"),
            F.when(n % 11 == 0, "бележка").otherwise(
                F.concat(F.lit(" "), (n % 101).cast("string"), F.lit(" проц"))),
            F.lit("_"), n.cast("string"), F.when(n % 7 == 0, ".part").otherwise(".dat"),
        ).alias("path"), F.col("n_chars").alias("file_size_bytes"))


_REV_SUFFIX = {k: v[0] for k, v in fv.REVERSALS.items()}
_REV_FLAG = {k: v[1] for k, v in fv.REVERSALS.items()}
_ALIAS = {k: v[0] for k, v in fv.SENSOR_ALIASES.items()}
_EXT = {k: v[1] for k, v in fv.SENSOR_ALIASES.items()}

_CATALOG_SQL = f"""
WITH {_TREE}, p AS (
  SELECT *, split_part(path, '/', 1) AS op, split_part(path, '/', 2) AS rev,
         split_part(path, '/', 3) AS folder, split_part(path, '/', 4) AS original_name FROM tree),
k AS (
  SELECT *, coalesce({_sql_map("lower(trim(op))", fv.OPERATIONS)}, {_sql_slug("op")}) AS operation,
    coalesce({_sql_map("lower(trim(rev))", _REV_SUFFIX)}, {_sql_slug("rev")}) AS suffix,
    coalesce({_sql_map("lower(trim(rev))", _REV_FLAG)}, 'unknown') AS reversal,
    {_sql_map("lower(trim(folder))", _ALIAS)} AS sensor, {_sql_map("lower(trim(folder))", _EXT)} AS ext,
    CAST(nullif(regexp_extract(original_name, '^\\s*(\\d+)', 1), '') AS INT) AS speed_percent
  FROM p),
s AS (
  SELECT *, concat(operation, '_', suffix) AS condition,
    CASE WHEN sensor IS NULL THEN concat('unknown sensor folder: ', folder)
         WHEN original_name LIKE '%.part' THEN 'incomplete download'
         WHEN speed_percent IS NULL THEN 'no setpoint in name' END AS skipped FROM k)
SELECT condition, operation, reversal, speed_percent, sensor, substr(ext, 2) AS format, file_size_bytes,
  CASE WHEN skipped IS NULL THEN concat('data/', condition, '/', sensor, '/',
       printf('speed%03d_%s%s', speed_percent, sensor, ext)) END AS new_path,
  original_name, path AS original_path, skipped
FROM s"""


@query("catalog_scan", _CATALOG_SQL)
def catalog_scan(spark, sf):
    return catalog.catalog_tree(_tree(spark, sf))


@query("scan_metadata", f"""
WITH {S.META}
SELECT * FROM meta WHERE sensor IN ('sound_phone', 'sound_vibrometer')
  AND condition IS NOT NULL AND speed_percent IS NOT NULL""")
def scan_metadata(spark, sf):
    return catalog.of_sensors(S.recordings(spark, sf), ["sound_phone", "sound_vibrometer"])


@query("metadata_csv", """
SELECT o_orderpriority AS condition, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('run, ', o_orderstatus) END AS operation,
  CAST(year(o_orderdate) AS INT) AS speed_percent, CASE o_orderstatus WHEN 'F' THEN 'sound_phone' WHEN 'O' THEN 'sound_vibrometer' END AS sensor,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS duration_s,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS file_size_bytes,
  printf('data/%s/%012d.bin', o_orderstatus, o_orderkey) AS new_path
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def metadata_csv(spark, sf):
    """The metadata file written as CSV, with blanks and commas, read back with its schema and cut to two sensors."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    known = {
        "condition": F.col("o_orderpriority"), "operation": F.when(key % 3 != 0, F.concat(F.lit("run, "), status)),
        "speed_percent": F.year("o_orderdate"),
        "sensor": F.create_map(*[F.lit(x) for kv in S.SENSOR_OF_STATUS.items() for x in kv])[status],
        "duration_s": F.when(key % 5 != 0, F.round("o_totalprice", 2)), "file_size_bytes": F.when(key % 7 != 0, key),
        "new_path": F.format_string("data/%s/%012d.bin", status, key)}
    rows = S.table(spark, sf, "orders").select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.METADATA])
    path = f"{tables.shared_dir(spark).rstrip('/')}/waveledger/metadata-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    read = catalog.of_sensors(catalog.read_metadata(spark, path), ["sound_phone", "sound_vibrometer"])
    return read.select("condition", "operation", "speed_percent", "sensor", "duration_s", "file_size_bytes", "new_path")


@query("metadata_sorted", f"""
WITH {S.META}
SELECT condition, sensor, speed_percent, recording_id FROM meta ORDER BY condition, sensor, speed_percent""")
def metadata_sorted(spark, sf):
    return catalog.sorted_metadata(S.recordings(spark, sf)).select(
        "condition", "sensor", "speed_percent", "recording_id")


@query("unlisted_files", f"""
WITH {S.FILES}
SELECT path, condition, sensor, declared_size FROM files
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unlisted_files(spark, sf):
    from waveledger.operators import quality

    listing = S.files(spark, sf)
    listed = S.table(spark, sf, "labels").select("doc_id")
    known = listing.join(listed, "doc_id", "left_semi")
    return quality.unlisted_files(listing, known, "path").select(
        "path", "condition", "sensor", "declared_size")


# Scalars ------------------------------------------------------------------------------

@query("slugify", f"""
WITH s AS (SELECT doc_id, {_sql_slug('text')} AS slug FROM documents)
SELECT doc_id, length(slug) AS slug_length, md5(slug) AS slug_md5 FROM s""")
def slugify(spark, sf):
    slug = S.table(spark, sf, "documents").select("doc_id", sc.slugify("text").alias("slug"))
    return slug.select("doc_id", F.length("slug").cast("bigint").alias("slug_length"),
                       F.md5("slug").alias("slug_md5"))


@query("slugify_names", f"""
WITH n AS (SELECT unnest(['Щъркел Юг', ' ', 'ток - КР2=0.1', 'Жълта чаша']) AS suffix)
SELECT p_partkey, suffix, {_sql_slug("concat(p_name, ' ', suffix)")} AS slug FROM part, n""")
def slugify_names(spark, sf):
    names = ["Щъркел Юг", " ", "ток - КР2=0.1", "Жълта чаша"]
    p = S.table(spark, sf, "part").select("p_partkey", "p_name", F.explode(
        F.array(*[F.lit(n) for n in names])).alias("suffix"))
    return p.select("p_partkey", "suffix",
                    sc.slugify(F.concat("p_name", F.lit(" "), "suffix")).alias("slug"))


@query("canonical_keys", f"""
WITH {_TREE}, p AS (SELECT path, split_part(path, '/', 1) AS op, split_part(path, '/', 2) AS rev FROM tree),
k AS (SELECT path, coalesce({_sql_map("lower(trim(op))", fv.OPERATIONS)}, {_sql_slug("op")}) AS operation,
  coalesce({_sql_map("lower(trim(rev))", _REV_SUFFIX)}, {_sql_slug("rev")}) AS suffix,
  coalesce({_sql_map("lower(trim(rev))", _REV_FLAG)}, 'unknown') AS reversal FROM p)
SELECT path, operation, reversal, concat(operation, '_', suffix) AS condition FROM k""")
def canonical_keys(spark, sf):
    parts = _tree(spark, sf).withColumns({
        "op": F.split_part("path", F.lit("/"), F.lit(1)),
        "rev": F.split_part("path", F.lit("/"), F.lit(2))})
    return catalog.canonical_keys(parts, "op", "rev").select(
        "path", "operation", "reversal", "condition")


@query("alias_lookup", f"""
WITH {_TREE}, f AS (SELECT split_part(path, '/', 3) AS folder FROM tree)
SELECT folder, {_sql_map("lower(trim(folder))", _ALIAS)} AS sensor,
       {_sql_map("lower(trim(folder))", _EXT)} AS extension, count(*) AS files
FROM f GROUP BY ALL""")
def alias_lookup(spark, sf):
    f = _tree(spark, sf).select(F.split_part("path", F.lit("/"), F.lit(3)).alias("folder"))
    return (catalog.sensor_alias(f, "folder").groupBy("folder", "sensor", "extension")
            .agg(F.count(F.lit(1)).alias("files")))


@query("parse_setpoint", """
WITH n AS (
  SELECT p_partkey, concat('/raw/9 dir/', CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_brand END,
         ' ', CAST(p_size AS VARCHAR), '% ', p_name, '.v2.wav') AS file_name FROM part)
SELECT p_partkey, file_name,
  CAST(nullif(regexp_extract(regexp_replace(file_name, '^.*/', ''), '^\\s*(\\d+)', 1), '') AS INT) AS setpoint
FROM n""")
def parse_setpoint(spark, sf):
    brand = F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_brand"))
    name = F.concat(F.lit("/raw/9 dir/"), brand, F.lit(" "), F.col("p_size").cast("string"),
                    F.lit("% "), F.col("p_name"), F.lit(".v2.wav"))
    p = S.table(spark, sf, "part").select("p_partkey", name.alias("file_name"))
    return p.withColumn("setpoint", sc.setpoint_from_name("file_name"))


@query("padded_names", f"""
WITH {S.FLEET}
SELECT recording_id, printf('speed%03d_%s%s', speed_percent, sensor, '.bin') AS file_name,
  printf('%s__seg%03d', concat(condition, '__', CAST(speed_percent AS VARCHAR)), recording_id % 2000) AS segment_id
FROM fleet""")
def padded_names(spark, sf):
    f = S.fleet(spark, sf)
    return f.select(
        "recording_id",
        sc.recording_file_name("speed_percent", "sensor", F.lit(".bin")).alias("file_name"),
        sc.segment_key(sc.group_key("condition", "speed_percent"),
                       F.col("recording_id") % 2000).alias("segment_id"))


@query("name_parse", """
WITH n AS (
  SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN concat('spd', p_size, '_', p_name)
         ELSE printf('speed%03d_%s', p_size, replace(p_name, ' ', '_')) END AS stem FROM part)
SELECT p_partkey, stem, CAST(nullif(regexp_extract(stem, '^speed(\\d+)_(.+)$', 1), '') AS INT) AS speed_percent,
       nullif(regexp_extract(stem, '^speed(\\d+)_(.+)$', 2), '') AS sensor FROM n""")
def name_parse(spark, sf):
    stem = F.when(F.col("p_type") == "ECONOMY",
                  F.concat(F.lit("spd"), F.col("p_size").cast("string"), F.lit("_"), "p_name")
                  ).otherwise(F.format_string("speed%03d_%s", "p_size",
                                              F.replace("p_name", F.lit(" "), F.lit("_"))))
    p = S.table(spark, sf, "part").select("p_partkey", stem.alias("stem"))
    parsed = sc.parse_recording_name("stem")
    return p.select("p_partkey", "stem", parsed["speed_percent"].alias("speed_percent"),
                    parsed["sensor"].alias("sensor"))


@query("filter_common", """
SELECT l_orderkey, l_linenumber, l_returnflag, round(l_quantity, 2) + 0.0 AS l_quantity FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL AND l_linestatus = 'F' AND l_quantity >= 25""")
def filter_common(spark, sf):
    rows = S.table(spark, sf, "lineitem").where(
        F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").isNotNull()
        & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 25))
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag",
                       rounded("l_quantity", 2).alias("l_quantity"))


@query("fill_features", """
SELECT event_id, CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.0 ELSE value END::DOUBLE AS feature,
  CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.0 WHEN 'click' THEN 0.0 ELSE value END::DOUBLE AS finite_feature
FROM events""")
def fill_features(spark, sf):
    e = S.table(spark, sf, "events")
    kind = F.col("event_type")
    raw = F.when(kind == "view", float("nan")).when(kind != "error", F.col("value"))
    odd = F.when(kind == "click", float("inf")).otherwise(raw)
    return e.select("event_id", sc.fill_missing(raw).alias("feature"),
                    sc.finite_or_zero(odd).alias("finite_feature"))


@query("cap_duration", f"""
WITH {S.META} SELECT recording_id, least(duration_s, 200000.0)::DOUBLE AS analysis_s FROM meta""")
def cap_duration(spark, sf):
    return S.recordings(spark, sf).select(
        "recording_id", F.least("duration_s", F.lit(200000.0)).alias("analysis_s"))


@query("meta_match", """
SELECT d.doc_id,
  CASE WHEN l.quality IS NULL THEN NULL ELSE abs(length(text) - n_chars) <= 0 END AS size_match,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN lang <> 'en' THEN false
       ELSE abs(length(text) - 1000.0 * (1 + quality)) <= 500.5 END AS duration_match
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def meta_match(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    size = F.length("text")
    expected = F.when(F.col("quality").isNotNull(), F.col("n_chars"))
    target = F.when(F.col("quality").isNull(), float("nan")).otherwise(1000.0 * (1 + F.col("quality")))
    actual = F.when(F.col("lang") == "en", size)
    return d.select("doc_id", sc.match_within(size, expected).alias("size_match"),
                    sc.match_within(actual, target, 500.5).alias("duration_match"))


@query("label_map", f"""
WITH {S.META}
SELECT recording_id, CASE sensor WHEN 'sound_phone' THEN 'Smartphone audio'
   WHEN 'sound_vibrometer' THEN 'Vibrometer waveform' WHEN 'current' THEN 'Armature current' END AS sensor_label,
  condition AS condition_label FROM meta""")
def label_map(spark, sf):
    return S.recordings(spark, sf).select(
        "recording_id", sc.label_or_self("sensor", fv.MODALITY_LABELS).alias("sensor_label"),
        sc.label_or_self("condition", fv.MODALITY_LABELS).alias("condition_label"))


@query("si_format", """
WITH v AS (
  SELECT l_orderkey, l_linenumber, (l_extendedprice - 40000.004) * pow(10.0, l_linenumber * 3 - 15) AS v FROM lineitem),
e AS (SELECT *, greatest(least(CAST(floor(log10(abs(v)) / 3) * 3 AS INT), 12), -15) AS e FROM v)
SELECT l_orderkey, l_linenumber, concat(printf('%.4g', v / pow(10.0, e)), ' ',
   CASE e WHEN -15 THEN 'f' WHEN -12 THEN 'p' WHEN -9 THEN 'n' WHEN -6 THEN 'u' WHEN -3 THEN 'm' WHEN 0 THEN ''
          WHEN 3 THEN 'k' WHEN 6 THEN 'M' WHEN 9 THEN 'G' ELSE 'T' END, 'V') AS label FROM e""")
def si_format(spark, sf):
    li = S.table(spark, sf, "lineitem")
    v = (F.col("l_extendedprice") - 40000.004) * F.pow(F.lit(10.0), F.col("l_linenumber") * 3 - 15)
    return li.select("l_orderkey", "l_linenumber", sc.si_format(v, "V").alias("label"))


@query("si_parse", """
WITH t AS (
  SELECT l_orderkey, l_linenumber, concat(' ', CAST(CAST(l_quantity AS INT) AS VARCHAR),
    CASE l_returnflag WHEN 'A' THEN 'us' WHEN 'N' THEN 'ms ' ELSE CASE l_linestatus WHEN 'F' THEN 'e-06s' ELSE ' k' END END) AS t
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN t LIKE '%us' THEN CAST(regexp_extract(t, '\\d+') AS DOUBLE) * 1e-6
     WHEN t LIKE '%ms ' THEN CAST(regexp_extract(t, '\\d+') AS DOUBLE) * 1e-3
     WHEN t LIKE '%e-06s' THEN CAST(regexp_extract(t, '\\d+') AS DOUBLE) * 1e-6
     ELSE CAST(regexp_extract(t, '\\d+') AS DOUBLE) * 1e3 END, 9) + 0.0 AS seconds FROM t""")
def si_parse(spark, sf):
    suffix = (F.when(F.col("l_returnflag") == "A", "us").when(F.col("l_returnflag") == "N", "ms ")
              .when(F.col("l_linestatus") == "F", "e-06s").otherwise(" k"))
    text = F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), suffix)
    return S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(sc.si_parse_seconds(text), 9).alias("seconds"))


@query("path_safety", """
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE 'https://%' THEN regexp_replace(url, '^https?://[^/]*/', '')
    WHEN url LIKE '%.com/%' THEN regexp_replace(url, '^https?://[^/]*', '')
    WHEN url LIKE '%.org/%' THEN concat('data/../', regexp_replace(url, '^https?://[^/]*/', ''))
    ELSE url END AS path FROM pages)
SELECT page_id, path, CASE WHEN trim(path) = '' THEN 'empty'
   WHEN path LIKE '/%' OR regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'absolute'
   WHEN list_contains(string_split(path, '/'), '..') THEN 'escapes root'
   WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) <> '.html' THEN 'extension' END AS problem FROM p""")
def path_safety(spark, sf):
    u = F.col("url")
    rel = F.regexp_replace(u, "^https?://[^/]*/", "")
    path = (F.when(u.startswith("https://"), rel)
            .when(u.contains(".com/"), F.regexp_replace(u, "^https?://[^/]*", ""))
            .when(u.contains(".org/"), F.concat(F.lit("data/../"), rel)).otherwise(u))
    pages = S.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return catalog.unsafe_paths(pages, "path", [".html"])


@query("task_targets", f"""
WITH {S.FLEET}, t AS (
  SELECT 'condition' AS task, condition AS target FROM fleet
  UNION ALL SELECT 'operation', operation FROM fleet
  UNION ALL SELECT 'reversal', reversal FROM fleet
  UNION ALL SELECT 'binary', operation FROM fleet WHERE operation IN ('op0', 'op1'))
SELECT task, target, count(*) AS n FROM t GROUP BY ALL""")
def task_targets(spark, sf):
    from waveledger.operators import splits

    return (splits.task_targets(S.fleet(spark, sf), ["op0", "op1"])
            .groupBy("task", "target").agg(F.count(F.lit(1)).alias("n")))


@query("class_index", """
SELECT o_orderpriority AS condition, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS class_index, count(*) AS n
FROM orders GROUP BY o_orderpriority""")
def class_index(spark, sf):
    out = catalog.class_index(S.recordings(spark, sf), "condition")
    return out.groupBy("condition", F.col("class_index").cast("bigint").alias("class_index")).agg(
        F.count(F.lit(1)).alias("n"))


@query("scale_target", f"""
WITH {S.FLEET}
SELECT recording_id, round((speed_percent - 1) / 99.0, 9) + 0.0 AS scaled, round(speed_percent, 9) + 0.0 AS restored
FROM fleet""")
def scale_target(spark, sf):
    s = S.fleet(spark, sf).withColumn("scaled", sc.scale_setpoint("speed_percent"))
    return s.select("recording_id", rounded("scaled", 9).alias("scaled"),
                    rounded(sc.unscale_setpoint("scaled"), 9).alias("restored"))


@query("reindex_cols", f"""
WITH {S.META} SELECT sensor, condition, CAST(NULL AS VARCHAR) AS error, duration_s, path, recording_id, speed_percent
FROM meta""")
def reindex_cols(spark, sf):
    return catalog.reindex(S.recordings(spark, sf), ["sensor", "condition", "error"])


_GRID = list(range(4, 13))


@query("markdown_rows", f"""
WITH {S.META}, g AS (
  SELECT condition, sensor, count(*) AS n, count(DISTINCT speed_percent) AS points FROM meta GROUP BY ALL)
SELECT concat('| ', condition, ' | ', sensor, ' | ', n, ' | ', points, ' |') AS markdown,
       concat(condition, ' & ', sensor, ' & ', n, ' \\\\') AS latex FROM g""")
def markdown_rows(spark, sf):
    g = S.recordings(spark, sf).groupBy("condition", "sensor").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("speed_percent").alias("points"))
    return g.select(catalog.markdown_table_row("condition", "sensor", "n", "points").alias("markdown"),
                    catalog.latex_table_row("condition", "sensor", "n").alias("latex"))


@query("json_detail", """
SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k,
  concat('{"k":', props ->> 'k', ',"kind":"', event_type, '"}') AS detail_json FROM events""")
def json_detail(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    return S.table(spark, sf, "events").select(
        "event_id", k.alias("k"),
        F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("detail_json"))


@query("contract_violations", f"""
WITH {S.META}, used AS (SELECT * FROM meta),
common AS (SELECT speed_percent FROM used GROUP BY 1 HAVING count(DISTINCT condition) = 6)
SELECT 'absent condition' AS rule, 6 - count(DISTINCT condition) AS violations FROM used
UNION ALL SELECT 'setpoint not an integer in range', count(*) FILTER (WHERE speed_percent > 1999) FROM used
UNION ALL SELECT 'repeated operating point', CAST(sum(c) AS BIGINT)
  FROM (SELECT count(*) - 1 AS c FROM used GROUP BY condition, speed_percent)
UNION ALL SELECT 'repeated path', CAST(sum(c) AS BIGINT) FROM (SELECT count(*) - 1 AS c FROM used GROUP BY path)
UNION ALL SELECT 'too few common setpoints', greatest(5 - count(*), 0) FROM common""")
def contract_violations(spark, sf):
    return catalog.contract_violations(S.recordings(spark, sf), [*PRIORITIES, "6-ABSENT"], hi=1999)


# Pairing and inventories --------------------------------------------------------------

_PAIR = S.FLEET + """, paired AS (
  SELECT condition, operation, reversal, speed_percent,
    concat(condition, '__', CAST(speed_percent AS VARCHAR)) AS group_id,
    min(path) FILTER (WHERE sensor = 'sound_phone') AS path_sound_phone,
    min(path) FILTER (WHERE sensor = 'sound_vibrometer') AS path_sound_vibrometer,
    min(path) FILTER (WHERE sensor = 'current') AS path_current,
    arg_min_null(duration_s, path) FILTER (WHERE sensor = 'sound_phone') AS duration_sound_phone,
    arg_min_null(duration_s, path) FILTER (WHERE sensor = 'sound_vibrometer') AS duration_sound_vibrometer,
    arg_min_null(duration_s, path) FILTER (WHERE sensor = 'current') AS duration_current
  FROM fleet GROUP BY ALL),
complete AS (SELECT * FROM paired WHERE path_sound_phone IS NOT NULL AND path_sound_vibrometer IS NOT NULL
  AND path_current IS NOT NULL),
probe AS (SELECT path, o_totalprice / 1000 AS probed_s
          FROM fleet JOIN orders ON recording_id = o_orderkey WHERE o_orderpriority <> '5-LOW'),
filled AS (
  SELECT c.* EXCLUDE (duration_sound_phone, duration_sound_vibrometer, duration_current),
    coalesce(duration_sound_phone, a.probed_s) AS duration_sound_phone,
    coalesce(duration_sound_vibrometer, b.probed_s) AS duration_sound_vibrometer,
    coalesce(x.probed_s, duration_current) AS duration_current
  FROM complete c LEFT JOIN probe a ON a.path = path_sound_phone
    LEFT JOIN probe b ON b.path = path_sound_vibrometer LEFT JOIN probe x ON x.path = path_current)"""


def _complete(spark, sf):
    return manifest.complete_pairs(manifest.pair(S.fleet(spark, sf)))


def _filled(spark, sf):
    probe = S.table(spark, sf, "orders").where(F.col("o_orderpriority") != "5-LOW").select(
        F.format_string("data/%s/%012d.bin", "o_orderstatus", "o_orderkey").alias("path"),
        (F.col("o_totalprice") / 1000).alias("probed_s"))
    return manifest.fill_durations(_complete(spark, sf), probe,
                                   fill=["sound_phone", "sound_vibrometer"], override=["current"])


@query("paired_manifest", f"""
WITH {_PAIR} SELECT group_id, condition, operation, reversal, speed_percent, path_sound_phone,
  path_sound_vibrometer, path_current FROM complete""")
def paired_manifest(spark, sf):
    return _complete(spark, sf).select(
        "group_id", "condition", "operation", "reversal", "speed_percent", "path_sound_phone",
        "path_sound_vibrometer", "path_current")


_DURS = ["duration_sound_phone", "duration_sound_vibrometer", "duration_current"]
_DUR_SQL = ", ".join(f"round({d}, 6) + 0.0 AS {d}" for d in _DURS)


@query("paired_durations", f"WITH {_PAIR} SELECT group_id, {_DUR_SQL} FROM complete")
def paired_durations(spark, sf):
    return _complete(spark, sf).select("group_id", *[rounded(d).alias(d) for d in _DURS])


@query("duration_fill", f"WITH {_PAIR} SELECT group_id, {_DUR_SQL} FROM filled")
def duration_fill(spark, sf):
    return _filled(spark, sf).select("group_id", *[rounded(d).alias(d) for d in _DURS])


@query("missing_durations", f"""
WITH {_PAIR}
SELECT group_id, concat_ws(',', CASE WHEN duration_sound_phone IS NULL THEN 'sound_phone' END,
  CASE WHEN duration_sound_vibrometer IS NULL THEN 'sound_vibrometer' END,
  CASE WHEN duration_current IS NULL THEN 'current' END) AS without_duration
FROM filled WHERE duration_sound_phone IS NULL OR duration_sound_vibrometer IS NULL OR duration_current IS NULL""")
def missing_durations(spark, sf):
    return manifest.missing_durations(_filled(spark, sf)).select(
        "group_id", F.array_join("without_duration", ",").alias("without_duration"))


_SPAN = """, span AS (SELECT *, least(duration_sound_phone, duration_sound_vibrometer, duration_current)
  AS common_duration_s FROM filled WHERE duration_current >= 100 - 0.001)"""


@query("common_span", f"""
WITH {_PAIR}{_SPAN} SELECT group_id, round(common_duration_s, 6) + 0.0 AS common_duration_s FROM span""")
def common_span(spark, sf):
    out = manifest.with_common_span(_filled(spark, sf), min_duration_s=100.0)
    return out.select("group_id", rounded("common_duration_s").alias("common_duration_s"))


@query("common_windows", f"""
WITH {_PAIR}{_SPAN}
SELECT group_id, CASE WHEN least(common_duration_s - 1, 200) >= 2
  THEN CAST(floor((least(common_duration_s - 1, 200) - 2 + 0.001) / 1.0) + 1 AS BIGINT) ELSE 0 END AS common_windows
FROM span""")
def common_windows(spark, sf):
    from waveledger.operators import windows

    span = manifest.with_common_span(_filled(spark, sf), min_duration_s=100.0)
    usable = F.least(F.col("common_duration_s") - 1.0, F.lit(200.0))
    return span.select("group_id", windows.common_window_count(usable, 2.0, 0.5)
                       .alias("common_windows"))


@query("modality_mask", f"""
WITH {_PAIR}
SELECT group_id, (path_sound_phone IS NOT NULL)::INT AS has_sound_phone,
  (path_sound_vibrometer IS NOT NULL)::INT AS has_sound_vibrometer, (path_current IS NOT NULL)::INT AS has_current
FROM paired""")
def modality_mask(spark, sf):
    return manifest.modality_mask(manifest.pair(S.fleet(spark, sf))).select(
        "group_id", *[f"has_{m}" for m in fv.MODALITIES])


@query("common_setpoints", """
WITH d AS (SELECT o_orderkey, o_orderpriority AS condition, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)
  AS BIGINT) AS speed_percent FROM orders),
c AS (SELECT speed_percent FROM d GROUP BY 1 HAVING count(DISTINCT condition) = 5)
SELECT o_orderkey, condition, speed_percent FROM d WHERE speed_percent IN (SELECT speed_percent FROM c)""")
def common_setpoints(spark, sf):
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    d = S.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("condition"),
        day.cast("bigint").alias("speed_percent"))
    return catalog.keep_common_setpoints(d, PRIORITIES).select(
        "o_orderkey", "condition", "speed_percent")


_RULE = manifest.SetpointRule(setpoints=_GRID, capped_operation="op1", cap=9,
                              spot_sensor="current", spot_skipped=[4, 5])
_EXPECTED = S.FLEET + """, cond AS (SELECT DISTINCT condition, operation FROM fleet),
expected AS (
  SELECT condition, sensor, g AS speed_percent FROM cond,
    (SELECT unnest(['sound_phone', 'sound_vibrometer', 'current']) AS sensor), range(4, 13) t(g)
  WHERE (operation <> 'op1' OR g <= 9) AND NOT (sensor = 'current' AND g IN (4, 5))),
present AS (SELECT DISTINCT condition, sensor, speed_percent FROM fleet)"""


def _grid(spark, sf):
    fleet = S.fleet(spark, sf)
    return manifest.expected_setpoints(fleet, fv.MODALITIES, _RULE), fleet


@query("missing_grid", f"WITH {_EXPECTED} SELECT condition, sensor, speed_percent FROM expected EXCEPT SELECT * FROM present")
def missing_grid(spark, sf):
    expected, fleet = _grid(spark, sf)
    return manifest.missing_slots(expected, fleet).withColumn(
        "speed_percent", F.col("speed_percent").cast("bigint"))


@query("missing_grid_qc", f"""
WITH {S.FLEET}, cond AS (SELECT DISTINCT condition, operation FROM fleet),
expected AS (SELECT condition, sensor, g AS speed_percent FROM cond,
  (SELECT unnest(['sound_phone', 'sound_vibrometer', 'current']) AS sensor), range(4, 13) t(g)
  WHERE operation <> 'op1' OR g <= 9)
SELECT condition, sensor, speed_percent FROM expected EXCEPT SELECT condition, sensor, speed_percent FROM fleet""")
def missing_grid_qc(spark, sf):
    """The same inventory, with the waveform setpoints expected of every sensor."""
    fleet = S.fleet(spark, sf)
    expected = manifest.expected_setpoints(fleet, fv.MODALITIES, _RULE, per_sensor=False)
    return manifest.missing_slots(expected, fleet).withColumn(
        "speed_percent", F.col("speed_percent").cast("bigint"))


@query("unexpected_grid", f"WITH {_EXPECTED} SELECT * FROM present EXCEPT SELECT condition, sensor, speed_percent FROM expected")
def unexpected_grid(spark, sf):
    expected, fleet = _grid(spark, sf)
    return manifest.unexpected_slots(expected, fleet)


@query("consistency_report", f"""
WITH {_EXPECTED}, b AS (
  SELECT coalesce(e.condition, p.condition) AS condition, coalesce(e.sensor, p.sensor) AS sensor,
    coalesce(e.speed_percent, p.speed_percent) AS s, e.condition IS NOT NULL AS want, p.condition IS NOT NULL AS have
  FROM expected e FULL JOIN present p ON e.condition = p.condition AND e.sensor = p.sensor
    AND e.speed_percent = p.speed_percent)
SELECT condition, sensor, count(*) FILTER (WHERE have) AS present, count(*) FILTER (WHERE want) AS expected,
  coalesce(string_agg(s, ',' ORDER BY s) FILTER (WHERE want AND NOT have), '') AS missing,
  coalesce(string_agg(s, ',' ORDER BY s) FILTER (WHERE have AND NOT want), '') AS extra
FROM b GROUP BY condition, sensor""")
def consistency_report(spark, sf):
    out = manifest.consistency_report(*_grid(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


@query("coverage_grid", f"""
WITH {S.FLEET} SELECT condition, sensor, {", ".join(
    f"coalesce(max('x') FILTER (WHERE speed_percent = {s}), '·') AS \"{s}\"" for s in _GRID)},
  count(DISTINCT speed_percent) AS count FROM fleet GROUP BY condition, sensor""")
def coverage_grid(spark, sf):
    return manifest.coverage_grid(S.fleet(spark, sf), _GRID)


@query("dataset_overview", f"""
WITH {_PAIR} SELECT condition, operation, reversal, count(group_id) AS n_groups,
  concat(min(speed_percent), '-', max(speed_percent)) AS speed_range_percent FROM complete GROUP BY ALL""")
def dataset_overview(spark, sf):
    return manifest.dataset_overview(_complete(spark, sf))


@query("inventory", f"""
WITH {S.META} SELECT condition, count(*) FILTER (WHERE sensor = 'sound_phone') AS sound_phone,
  count(*) FILTER (WHERE sensor = 'sound_vibrometer') AS sound_vibrometer,
  count(*) FILTER (WHERE sensor = 'current') AS current, count(*) AS total,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT speed_percent AS s FROM meta m WHERE m.condition = meta.condition)) AS setpoints,
  min(duration_s) AS duration_min, max(duration_s) AS duration_max FROM meta GROUP BY condition""")
def inventory(spark, sf):
    return manifest.inventory(S.recordings(spark, sf), fv.MODALITIES)


@query("exactly_one", f"""
WITH {S.FLEET}, wanted AS (SELECT DISTINCT condition, speed_percent FROM fleet WHERE sensor = 'current'),
f AS (SELECT condition, speed_percent, count(*) AS matches FROM fleet WHERE sensor = 'sound_phone' GROUP BY ALL)
SELECT condition, speed_percent, coalesce(matches, 0) AS matches FROM wanted LEFT JOIN f USING (condition, speed_percent)
WHERE coalesce(matches, 0) <> 1""")
def exactly_one(spark, sf):
    fleet, keys = S.fleet(spark, sf), ["condition", "speed_percent"]
    wanted = fleet.where(F.col("sensor") == "current").select(*keys).distinct()
    return catalog.not_exactly_one(fleet.where(F.col("sensor") == "sound_phone"), keys, wanted)


@query("loso_split", f"""
WITH {S.FLEET} SELECT speed_percent, count(*) AS n_test, (SELECT count(*) FROM fleet) - count(*) AS n_train
FROM fleet GROUP BY speed_percent""")
def loso_split(spark, sf):
    return manifest.leave_one_setpoint_out(S.fleet(spark, sf))


# Set operations -------------------------------------------------------------------------

@query("union_missing", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_missing(spark, sf):
    c = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = S.table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def set_intersect(spark, sf):
    a = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT l_suppkey FROM lineitem")
def set_except(spark, sf):
    a = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return a.subtract(S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")))


@query("distinct_groups", f"""
WITH {S.FLEET} SELECT condition, speed_percent, min(recording_id) AS recording_id FROM fleet GROUP BY ALL""")
def distinct_groups(spark, sf):
    """One row per operating point; the lowest id instead of an arbitrary row."""
    return S.fleet(spark, sf).groupBy("condition", "speed_percent").agg(
        F.min("recording_id").alias("recording_id"))
