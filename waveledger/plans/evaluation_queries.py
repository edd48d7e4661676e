"""Readings, quality control, splits, votes, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveledger import fixed_values as fv
from waveledger.functions import ordered
from waveledger.functions.scalars import match_within, rounded
from waveledger.operators import (manifest, metrics, quality, readings, scaling, splits, stats,
                                  timefeat, voting)
from waveledger.plans import standins as S
from waveledger.plans.registry import query
from waveledger.sources import tables

FLAGS = ["A", "N", "R"]
CLASSES = list(range(10))


def _r(df, keep, cols, digits=6):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in cols])


def _rs(cols, digits=6, prefix=""):
    return ", ".join(f"round({prefix}{c}, {digits}) + 0.0 AS {c}" for c in cols)


# Spot readings --------------------------------------------------------------------------

_RAW = """raw AS (
  SELECT l_suppkey AS recording_id, concat(' ', l_returnflag, ' ') AS quantity,
    CASE WHEN l_discount = 0.1 THEN 'n/a' WHEN l_discount = 0.09 THEN 'NaN'
         WHEN l_discount = 0.08 THEN concat('-', CAST(l_quantity AS BIGINT)) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value
  FROM lineitem)"""


def _raw_readings(spark, sf):
    q = F.col("l_quantity").cast("bigint").cast("string")
    d = F.col("l_discount")
    return S.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"),
        F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("quantity"),
        F.when(d == 0.1, "n/a").when(d == 0.09, "NaN").when(d == 0.08, F.concat(F.lit("-"), q))
        .otherwise(q).alias("value"))


@query("spot_clean", f"""
WITH {_RAW} SELECT recording_id, trim(quantity) AS quantity, CAST(value AS DOUBLE) AS value FROM raw
WHERE trim(quantity) IN ('A', 'R') AND value NOT IN ('n/a', 'NaN')""")
def spot_clean(spark, sf):
    return readings.clean(_raw_readings(spark, sf), ["A", "R"])


@query("spot_rejected", f"""
WITH {_RAW}, p AS (SELECT recording_id, trim(quantity) AS quantity,
  CASE WHEN value = 'n/a' THEN 'not a number' WHEN value = 'NaN' THEN 'not finite'
       WHEN value LIKE '-%' THEN 'negative' END AS problem FROM raw)
SELECT recording_id, quantity, problem, count(*) AS n FROM p WHERE problem IS NOT NULL AND quantity IN ('A', 'R') GROUP BY ALL""")
def spot_rejected(spark, sf):
    return readings.rejected(_raw_readings(spark, sf), ["A", "R"]).groupBy(
        "recording_id", "quantity", "problem").agg(F.count(F.lit(1)).alias("n"))


_STAT = ["mean", "sample_sd", "rms", "vmin", "vmax"]


@query("spot_stats", f"""
WITH {S.READ}, s AS (
  SELECT recording_id, quantity, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sample_sd,
    sqrt(avg(value * value)) AS rms, min(value) AS vmin, max(value) AS vmax FROM readings GROUP BY ALL)
SELECT recording_id, quantity, n, {_rs(_STAT)}, CAST(NULL AS VARCHAR) AS unit FROM s""")
def spot_stats(spark, sf):
    return _r(readings.stats(S.readings(spark, sf), ["recording_id"]),
              ["recording_id", "quantity", "n", "unit"], _STAT)


@query("spot_rms", f"""
WITH {S.READ}, s AS (SELECT quantity, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sample_sd,
    sqrt(avg(value * value)) AS rms, min(value) AS vmin, max(value) AS vmax FROM readings GROUP BY ALL)
SELECT quantity, n, {_rs(_STAT)} FROM s""")
def spot_rms(spark, sf):
    return _r(readings.stats(S.readings(spark, sf), []), ["quantity", "n"], _STAT)


_VEC = [f"{q}_{a}" for q in ["A", "N", "Z"] for a in ("mean", "std", "min", "max")]


@query("spot_vector", f"""
WITH {S.READ}, v AS (SELECT recording_id, {", ".join(
    f'''coalesce({fn}(value) FILTER (WHERE quantity = '{q}'), 0) AS "{q}_{a}"'''
    for q in ["A", "N", "Z"]
    for a, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))}
  FROM readings GROUP BY recording_id)
SELECT recording_id, {", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in _VEC)} FROM v""")
def spot_vector(spark, sf):
    return _r(readings.vector(S.readings(spark, sf), ["recording_id"], ["A", "N", "Z"]),
              ["recording_id"], _VEC)


@query("spot_cv", f"""
WITH {S.READ}, c AS (
  SELECT recording_id, quantity, CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) * 100 END AS cv
  FROM readings GROUP BY ALL)
SELECT recording_id, round(max(cv) FILTER (WHERE quantity = 'A'), 6) + 0.0 AS cv_a, round(max(cv), 6) + 0.0 AS spot_cv_pct
FROM c GROUP BY recording_id""")
def spot_cv(spark, sf):
    out = readings.variation(S.readings(spark, sf), ["recording_id"])
    return out.select("recording_id", rounded(F.col("cv_pct")[F.lit("A")]).alias("cv_a"),
                      rounded("spot_cv_pct").alias("spot_cv_pct"))


@query("trend_bars", """
WITH m AS (SELECT l_returnflag AS quantity, l_linenumber AS speed_percent, avg(l_extendedprice) AS mean
           FROM lineitem GROUP BY ALL)
SELECT quantity, speed_percent, round(mean, 4) + 0.0 AS mean,
  repeat('#', CAST(round_even(mean / max(mean) OVER (PARTITION BY quantity) * 40, 0) AS INT)) AS bar FROM m""")
def trend_bars(spark, sf):
    r = S.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("quantity"), F.col("l_linenumber").alias("speed_percent"),
        F.col("l_extendedprice").alias("value"))
    return _r(readings.trend_bars(r, "speed_percent"), ["quantity", "speed_percent", "bar"], ["mean"], 4)


# Files under quality control --------------------------------------------------------------

def _hashed(spark, sf):
    return quality.checksums(S.files(spark, sf).select("path", "sensor", "condition", "content"))


_HASHED = S.FILES + ", hashed AS (SELECT path, sensor, condition, sha256(content) AS sha256 FROM files)"


@query("checksum_manifest", f"WITH {S.FILES} SELECT path, concat(sha256(content), '  ', path) AS line FROM files")
def checksum_manifest(spark, sf):
    return quality.checksum_manifest(S.files(spark, sf))


@query("verify_checksums", f"""
WITH {S.FILES}, rec AS (
  SELECT path, CASE WHEN quality = 0 THEN sha256(concat(content, '!')) ELSE sha256(content) END AS recorded
  FROM files JOIN labels USING (doc_id)),
cur AS (SELECT path, sha256(content) AS current FROM files WHERE condition <> 'fr')
SELECT coalesce(rec.path, cur.path) AS path, recorded, current,
  CASE WHEN current IS NULL THEN 'missing' WHEN recorded IS NULL THEN 'new' WHEN recorded = current THEN 'ok'
       ELSE 'changed' END AS status
FROM rec FULL JOIN cur ON rec.path = cur.path""")
def verify_checksums(spark, sf):
    files = S.files(spark, sf)
    listed = files.join(S.table(spark, sf, "labels"), "doc_id")
    content = F.when(F.col("quality") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    recorded = quality.checksums(listed.select("path", content.alias("content")))
    current = quality.checksums(files.where(F.col("condition") != "fr").select("path", "content"))
    return quality.verify_checksums(recorded, current)


@query("duplicate_groups", f"""
WITH {_HASHED} SELECT sha256, count(*) AS files, min(path) AS first_path FROM hashed GROUP BY sha256 HAVING count(*) > 1""")
def duplicate_groups(spark, sf):
    return quality.duplicate_groups(_hashed(spark, sf))


@query("duplicate_peers", f"""
WITH {_HASHED}
SELECT a.path, a.sha256, count(*) AS n_peers, CASE WHEN min(b.path) > a.path THEN max(b.path) ELSE min(b.path) END AS peer
FROM hashed a JOIN hashed b ON a.sha256 = b.sha256 AND a.path <> b.path GROUP BY a.path, a.sha256""")
def duplicate_peers(spark, sf):
    """Contents are hashed once, into a written checksum table."""
    return quality.duplicate_peers(tables.staged(_hashed(spark, sf), "checksums"))


@query("duplicate_summary", f"""
WITH {_HASHED}, c AS (SELECT condition, sha256, count(*) AS n FROM hashed GROUP BY ALL)
SELECT condition, CAST(sum(n) AS BIGINT) AS files, count(*) AS unique_sha256, count(*) FILTER (WHERE n > 1) AS duplicate_groups
FROM c GROUP BY condition""")
def duplicate_summary(spark, sf):
    return quality.duplicate_summary(_hashed(spark, sf), "condition")


_QC_NUM = ["max_clip_pct", "rms_max_pct", "rms_median_pct"]


@query("qc_summary", f"""
WITH f AS (
  SELECT source AS sensor, n_chars > 0 AND lang <> 'es' AS opened_ok, abs(length(text) - n_chars) <= 0 AS size_match,
    CASE WHEN quality IS NULL THEN NULL ELSE abs(toxic - quality) <= 0 END AS label_match,
    (length(text) - length(replace(text, '!', ''))) / greatest(length(text), 1) AS clip_fraction,
    (length(text) - length(ltrim(text, ' '))) * 0.1 AS leading_quiet_s,
    CASE WHEN lang <> 'de' THEN sqrt(n_chars) END AS rms_variation_pct
  FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT source AS sensor, count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1),
s AS (
  SELECT sensor, count(*) AS n_files, count(*) FILTER (WHERE opened_ok) AS opened,
    CAST(sum(coalesce(size_match::INT, 0) + coalesce(label_match::INT, 0)) AS BIGINT) AS meta_pass,
    CAST(sum((size_match IS NOT NULL)::INT + (label_match IS NOT NULL)::INT) AS BIGINT) AS meta_total,
    count(*) FILTER (WHERE clip_fraction > 0) AS clip_files, max(clip_fraction) * 100 AS max_clip_pct,
    count(*) FILTER (WHERE leading_quiet_s >= 0.1) AS quiet_start_files, max(rms_variation_pct) AS rms_max_pct,
    median(rms_variation_pct) AS rms_median_pct FROM f GROUP BY sensor)
SELECT sensor, n_files, opened, meta_pass, meta_total, clip_files, quiet_start_files, coalesce(n_missing, 0) AS n_missing,
  {_rs(_QC_NUM)} FROM s LEFT JOIN m USING (sensor)""")
def qc_summary(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    size = F.length("text")
    share = (size - F.length(F.replace("text", F.lit("!"), F.lit("")))) / F.greatest(size, F.lit(1))
    files = d.select(
        F.col("source").alias("sensor"),
        ((F.col("n_chars") > 0) & (F.col("lang") != "es")).alias("opened_ok"),
        match_within(size, "n_chars").alias("size_match"),
        match_within("toxic", "quality").alias("label_match"),
        share.alias("clip_fraction"), (share > 0).alias("clipped"),
        ((size - F.length(F.ltrim("text"))) * 0.1).alias("leading_quiet_s"),
        F.when(F.col("lang") != "de", F.sqrt("n_chars")).alias("rms_variation_pct"))
    missing = S.table(spark, sf, "documents").join(
        S.table(spark, sf, "labels"), "doc_id", "left_anti").select(F.col("source").alias("sensor"))
    out = quality.qc_summary(files, "sensor", ["size_match", "label_match"], missing)
    return _r(out, ["sensor", "n_files", "opened", "meta_pass", "meta_total", "clip_files",
                    "quiet_start_files", "n_missing"], _QC_NUM)


# Splits and weights -----------------------------------------------------------------------

_GROUPS = S.WIN + """,
groups AS (SELECT DISTINCT group_id, label FROM win)"""

_FOLDS = _GROUPS + """, folds AS (
  SELECT group_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', group_id))) - 1
    + CAST(concat('0x', substr(md5(concat('42:', label)), 1, 8)) AS BIGINT) % 5) % 5 AS fold FROM groups)"""


def _groups(spark, sf):
    return S.windows(spark, sf).select("group_id", "label").distinct()


def _folds(spark, sf):
    return splits.stratified_group_folds(_groups(spark, sf), "group_id", "label", 5)


@query("group_kfold", f"WITH {_FOLDS} SELECT group_id, label, fold FROM folds")
def group_kfold(spark, sf):
    return _folds(spark, sf)


_MIXED = """rows AS (SELECT vec_id, vec_id % 37 AS group_id, CAST(label AS BIGINT) AS label FROM embeddings),
classes AS (SELECT label, row_number() OVER (ORDER BY label) AS c, count(*) AS total FROM rows GROUP BY label),
totals AS (SELECT list(total ORDER BY c) AS t FROM classes),
counts AS (SELECT group_id, label, count(*) AS n FROM rows GROUP BY ALL),
vectors AS (
  SELECT g.group_id, list((coalesce(n, 0) >> greatest(length(bin(coalesce(n, 0))) - 4, 0)) << greatest(length(bin(coalesce(n, 0))) - 4, 0)
    ORDER BY c) AS v
  FROM (SELECT DISTINCT group_id FROM rows) g CROSS JOIN classes LEFT JOIN counts ON counts.group_id = g.group_id AND counts.label = classes.label
  GROUP BY g.group_id),
kinds AS (SELECT v, count(*) AS n, row_number() OVER (ORDER BY list_sum(v) DESC, v DESC) AS place FROM vectors GROUP BY v),
steps AS (SELECT row_number() OVER (ORDER BY place, r) AS step, place, r, v FROM (SELECT place, v, unnest(range(n % 5)) AS r FROM kinds)),
deal AS (
  SELECT 0::BIGINT AS step, [[0::BIGINT FOR x IN t] FOR f IN range(5)] AS have, NULL::BIGINT AS fold FROM totals
  UNION ALL
  SELECT step, [CASE WHEN f - 1 = fold THEN [have[f][c] + v[c] FOR c IN range(1, len(v) + 1)] ELSE have[f] END FOR f IN range(1, 6)], fold
  FROM (
    SELECT s.step, s.v, d.have, list_sort([{'cost': list_reduce([0.0::DOUBLE] || [(d.have[f][c] * s.v[c])::DOUBLE / (t[c] * t[c])::DOUBLE
        FOR c IN range(1, len(t) + 1)], lambda a, x: a + x), 'size': list_sum(d.have[f]), 'f': f - 1} FOR f IN range(1, 6)])[1].f AS fold
    FROM deal d JOIN steps s ON s.step = d.step + 1, totals)),
ranked AS (
  SELECT group_id, place, n, row_number() OVER (PARTITION BY place ORDER BY md5(concat('42:', CAST(group_id AS VARCHAR)))) - 1 AS rank
  FROM vectors JOIN kinds USING (v)),
folds AS (
  SELECT group_id, CASE WHEN rank < n // 5 * 5 THEN rank % 5 ELSE fold END AS fold
  FROM ranked LEFT JOIN (SELECT place, r, fold FROM steps JOIN deal USING (step)) s ON s.place = ranked.place AND s.r = rank - n // 5 * 5)"""


def _mixed(spark, sf):
    rows = S.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 37).alias("group_id"), F.col("label").cast("bigint").alias("label"))
    return rows, splits.mixed_group_folds(rows, "group_id", "label", 5)


@query("mixed_group_kfold", f"""
WITH RECURSIVE {_MIXED}
SELECT rows.group_id, label, fold, count(*) AS n_rows FROM rows JOIN folds USING (group_id) GROUP BY ALL""")
def mixed_group_kfold(spark, sf):
    """Folds of groups that have rows of several classes; every row stays in its group's one fold."""
    rows, folds = _mixed(spark, sf)
    return rows.join(folds, "group_id").groupBy("group_id", "label", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("mixed_fold_coverage", f"""
WITH RECURSIVE {_MIXED},
m AS (SELECT group_id, f AS fold, f = fold AS test, count(*) AS n FROM rows JOIN folds USING (group_id), range(5) t(f) GROUP BY ALL)
SELECT fold, CAST(sum(n) FILTER (WHERE NOT test) AS BIGINT) AS train_rows, CAST(sum(n) FILTER (WHERE test) AS BIGINT) AS test_rows,
  count(DISTINCT group_id) FILTER (WHERE NOT test) AS train_groups, count(DISTINCT group_id) FILTER (WHERE test) AS test_groups,
  count(*) - count(DISTINCT group_id) AS leaked_groups
FROM m GROUP BY fold""")
def mixed_fold_coverage(spark, sf):
    rows, folds = _mixed(spark, sf)
    return splits.fold_coverage(splits.fold_membership(rows, folds, "group_id", 5), "group_id")


@query("group_shuffle_split", f"""
WITH {_GROUPS}, a AS (
  SELECT group_id, row_number() OVER (ORDER BY md5(concat('1337:', group_id))) <= ceil((SELECT count(*) FROM groups) * 0.25) AS test
  FROM groups),
b AS (SELECT group_id, row_number() OVER (ORDER BY md5(concat('1338:', group_id)))
        <= ceil((SELECT count(*) FROM a WHERE NOT test) * 0.15) AS val FROM a WHERE NOT test)
SELECT group_id, 'test' AS split FROM a WHERE test
UNION ALL SELECT group_id, CASE WHEN val THEN 'val' ELSE 'train' END FROM b""")
def group_shuffle_split(spark, sf):
    return splits.group_shuffle_split(_groups(spark, sf), "group_id", 0.25, 0.15)


@query("fold_membership", f"""
WITH {_FOLDS}, rows AS (SELECT vec_id, concat(label, '_', vec_id % 10) AS group_id FROM embeddings)
SELECT vec_id, r.group_id, f AS fold, CASE WHEN f = fold THEN 'test' ELSE 'train' END AS role
FROM rows r JOIN folds USING (group_id), range(5) t(f)""")
def fold_membership(spark, sf):
    rows = S.windows(spark, sf).select("vec_id", "group_id")
    return splits.fold_membership(rows, _folds(spark, sf), "group_id", 5)


@query("oof_leakage_check", f"""
WITH {_FOLDS}, rows AS (SELECT vec_id, concat(label, '_', vec_id % 10) AS group_id FROM embeddings),
m AS (SELECT group_id, f AS fold, f = fold AS test, count(*) AS n FROM rows JOIN folds USING (group_id), range(5) t(f)
      GROUP BY ALL)
SELECT fold, CAST(sum(n) FILTER (WHERE NOT test) AS BIGINT) AS train_rows, CAST(sum(n) FILTER (WHERE test) AS BIGINT) AS test_rows,
  count(DISTINCT group_id) FILTER (WHERE NOT test) AS train_groups, count(DISTINCT group_id) FILTER (WHERE test) AS test_groups,
  count(*) - count(DISTINCT group_id) AS leaked_groups
FROM m GROUP BY fold""")
def oof_leakage_check(spark, sf):
    rows = S.windows(spark, sf).select("vec_id", "group_id")
    member = splits.fold_membership(rows, _folds(spark, sf), "group_id", 5)
    return splits.fold_coverage(member, "group_id")


@query("group_weights", f"""
WITH {S.WIN}, r AS (SELECT DISTINCT vec_id, group_id FROM win),
w AS (SELECT vec_id, group_id, 1.0 / count(*) OVER (PARTITION BY group_id) AS w FROM r)
SELECT vec_id, group_id, round(w * count(*) OVER () / sum(w) OVER (), 6) + 0.0 AS group_weight FROM w""")
def group_weights(spark, sf):
    rows = S.windows(spark, sf).select("vec_id", "group_id")
    return _r(splits.group_weights(rows, "group_id"), ["vec_id", "group_id"], ["group_weight"])


@query("class_weights", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT vec_id, CAST(e.label AS BIGINT) AS label,
  round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) + 0.0 AS class_weight
FROM embeddings e JOIN c ON e.label = c.label""")
def class_weights(spark, sf):
    rows = S.windows(spark, sf).select("vec_id", "label")
    return _r(splits.class_weights(rows, "label"), ["vec_id", "label"], ["class_weight"])


@query("min_class_folds", f"""
WITH {_GROUPS}, c AS (SELECT label, count(*) AS n FROM groups GROUP BY label)
SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_groups, min(n) AS min_class, least(5, min(n)) AS n_folds FROM c""")
def min_class_folds(spark, sf):
    return splits.min_class_folds(_groups(spark, sf), "group_id", "label")


_MASK = S.FLEET + """, mask AS (
  SELECT concat(condition, '__', CAST(speed_percent AS VARCHAR)) AS group_id,
    max((sensor = 'sound_phone')::INT) AS p, max((sensor = 'sound_vibrometer')::INT) AS v, max((sensor = 'current')::INT) AS c
  FROM fleet GROUP BY condition, speed_percent),
u AS (SELECT *, """ + ", ".join(
    f"CAST(concat('0x', substr(md5(concat('7:', group_id, ':{m}')), 1, 8)) AS BIGINT) / 4294967296.0 < 0.4 AS d{x}"
    for m, x in zip(fv.MODALITIES, "pvc")) + """ FROM mask),
k AS (SELECT *, CASE WHEN dp THEN 0 ELSE p END AS kp, CASE WHEN dv THEN 0 ELSE v END AS kv, CASE WHEN dc THEN 0 ELSE c END AS kc FROM u)"""


@query("modality_dropout", f"""
WITH {_MASK}
SELECT group_id, CASE WHEN kp + kv + kc = 0 THEN p ELSE kp END AS kept_sound_phone,
  CASE WHEN kp + kv + kc = 0 THEN v ELSE kv END AS kept_sound_vibrometer,
  CASE WHEN kp + kv + kc = 0 THEN c ELSE kc END AS kept_current FROM k""")
def modality_dropout(spark, sf):
    masks = manifest.modality_mask(manifest.pair(S.fleet(spark, sf)))
    out = splits.modality_dropout(masks, "group_id", fv.MODALITIES, 0.4, seed=7)
    return out.select("group_id", *[f"kept_{m}" for m in fv.MODALITIES])


_SPLIT_OF = """split AS (
  SELECT vec_id, CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, any_value(x) FILTER (WHERE j = 0) > 0 AS present
  FROM win GROUP BY vec_id)"""


@query("train_stats", f"""
WITH {S.WIN}, {_SPLIT_OF}
SELECT j AS dim, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x) + 1e-6, 6) + 0.0 AS std
FROM win JOIN split USING (vec_id) WHERE split = 'train' AND present GROUP BY j""")
def train_stats(spark, sf):
    w = S.windows(spark, sf).select(
        "samples", F.when(F.col("vec_id") % 10 < 7, "train").otherwise("test").alias("split"),
        (F.get(F.col("samples"), F.lit(0)) > 0).alias("present"))
    out = scaling.train_stats(w, "samples", present="present")
    return out.select(F.col("dim").cast("bigint").alias("dim"), rounded("mean").alias("mean"),
                      rounded("std").alias("std"))


_RAW_FEATURES = [f"f{i}" for i in range(64)]


def fold_features(spark, sf):
    """Windows with their fold and all samples as plain features."""
    w = S.windows(spark, sf).join(_folds(spark, sf).select("group_id", "fold"), "group_id")
    return w.select("vec_id", "group_id", "label", "fold", *[
        F.get(F.col("samples"), F.lit(i)).cast("double").alias(f) for i, f in enumerate(_RAW_FEATURES)])


_FOLD_LONG = _FOLDS + """, long AS (
  SELECT vec_id, w.label, fold AS own, concat('f', CAST(j AS VARCHAR)) AS feature, x FROM win w JOIN folds USING (group_id)),
stats AS (
  SELECT f AS fold, feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM long, range(5) t(f) WHERE f <> own GROUP BY ALL)"""


@query("fold_scaler", f"""
WITH {_FOLD_LONG} SELECT fold, feature, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM stats""")
def fold_scaler(spark, sf):
    out = scaling.fold_scaler(fold_features(spark, sf), _RAW_FEATURES, 5)
    return _r(out, ["fold", "feature", "n"], ["mean", "std"])


@query("knn_oof", f"""
WITH {_FOLD_LONG}, z AS (
  SELECT s.fold, vec_id, label, own, feature, (x - mean) / std AS z FROM long JOIN stats s USING (feature)),
d AS (
  SELECT a.fold, a.vec_id, b.vec_id AS nb, any_value(b.label) AS nl, sum((a.z - b.z) * (a.z - b.z)) AS d2
  FROM z a JOIN z b ON a.fold = b.fold AND a.feature = b.feature
  WHERE a.own = a.fold AND b.own <> b.fold GROUP BY a.fold, a.vec_id, b.vec_id),
top AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, nb) <= 5),
v AS (SELECT fold, vec_id, nl, count(*) AS c FROM top GROUP BY ALL)
SELECT fold, vec_id, CAST(nl AS VARCHAR) AS predicted FROM v
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, nl) = 1""")
def knn_oof(spark, sf):
    from waveledger.operators import models

    rows = tables.staged(fold_features(spark, sf), "knn-rows")
    return models.knn_oof(rows, _RAW_FEATURES, 5, "vec_id", "label")


# Votes and softmax ------------------------------------------------------------------------

def _logits(spark, sf):
    """Ten class scores from the whole window: sums of every tenth sample."""
    def score(k):
        mine = F.filter("samples", lambda x, i: i % 10 == k)
        return F.aggregate(mine, F.lit(0.0), lambda a, x: a + x.cast("double") * 10)

    return S.windows(spark, sf).withColumn("logits", F.transform(F.sequence(F.lit(0), F.lit(9)), score))


_LOGITS = S.WIN + """, logits AS (
  SELECT vec_id, label, group_id, CAST(j % 10 AS BIGINT) AS class, sum(x * 10 ORDER BY j) AS logit FROM win GROUP BY ALL),
probs AS (SELECT vec_id, label, group_id, class, logit, exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w AS p
  FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM logits) WINDOW w AS (PARTITION BY vec_id))"""


@query("softmax_argmax", f"""
WITH {_LOGITS}
SELECT vec_id, label, class AS predicted, round(p, 6) + 0.0 AS probability FROM probs
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) = 1""")
def softmax_argmax(spark, sf):
    p = _logits(spark, sf).withColumn("probs", voting.softmax("logits"))
    return p.select("vec_id", "label", voting.first_argmax("probs").cast("bigint").alias("predicted"),
                    rounded(F.array_max("probs")).alias("probability"))


@query("soft_vote", f"""
WITH {_LOGITS}, m AS (SELECT group_id, label, class, avg(p) AS p, count(*) AS n FROM probs GROUP BY ALL),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY p DESC, class) = 1),
med AS (SELECT group_id, median(x * 100) AS load_pred FROM win WHERE j = 11 GROUP BY group_id)
SELECT group_id, label, n AS n_segments, class AS predicted, round(p, 6) + 0.0 AS mean_probability,
       round(load_pred, 5) + 0.0 AS load_pred
FROM best JOIN med USING (group_id)""")
def soft_vote(spark, sf):
    p = _logits(spark, sf).withColumn("probs", voting.softmax("logits")).withColumn(
        "load", F.get(F.col("samples"), F.lit(11)).cast("double") * 100)
    voted = voting.soft_vote(p, ["group_id", "label"], "probs", CLASSES)
    loads = voting.median_vote(p, ["group_id"], "load")
    return voted.join(loads, "group_id").select(
        "group_id", "label", "n_segments", F.col("predicted").cast("bigint").alias("predicted"),
        rounded(F.array_max("mean_prob")).alias("mean_probability"),
        rounded("load_pred", 5).alias("load_pred"))


@query("majority_vote", """
WITH c AS (SELECT user_id AS recording_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, event_type) AS rn,
  sum(n) OVER (PARTITION BY recording_id) AS total FROM c)
SELECT recording_id, event_type AS predicted, CAST(total AS BIGINT) AS n_segments FROM r WHERE rn = 1""")
def majority_vote(spark, sf):
    return voting.majority_vote(S.raw_samples(spark, sf), ["recording_id"], "channel")


_QUARTERS = ["q0", "q1", "q2", "q3"]
_TOKENS = S.WIN + """, tok AS (
  SELECT vec_id, label, j // 16 AS m, j % 16 AS dim, x,
    max(x) FILTER (WHERE j % 16 = 0) OVER (PARTITION BY vec_id, j // 16) * 10 AS logit,
    max(x) FILTER (WHERE j % 16 = 1) OVER (PARTITION BY vec_id, j // 16) > 0 AS present FROM win),
e AS (SELECT *, CASE WHEN present THEN exp(logit) ELSE 0.0 END AS e FROM tok),
wts AS (SELECT vec_id, label, m, present, CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE 0.0 END AS weight
        FROM e WHERE dim = 0 WINDOW w AS (PARTITION BY vec_id))"""


def _tokens(spark, sf):
    parts = F.array(*[F.struct(
        F.lit(q).alias("modality"), F.slice("samples", i * 16 + 1, 16).alias("vector"))
        for i, q in enumerate(_QUARTERS)])
    t = S.windows(spark, sf).select("vec_id", "label", F.explode(parts).alias("_t")).select(
        "vec_id", "label", "_t.modality", "_t.vector")
    first = F.get(F.col("vector"), F.lit(0)).cast("double") * 10
    return t.withColumn("logit", first).withColumn(
        "present", F.get(F.col("vector"), F.lit(1)) > 0)


@query("masked_softmax_pool", f"""
WITH {_TOKENS} SELECT vec_id, dim, round(sum(weight * x), 6) + 0.0 AS value
FROM tok JOIN wts USING (vec_id, m) GROUP BY vec_id, dim""")
def masked_softmax_pool(spark, sf):
    _, pooled = voting.masked_softmax_pool(_tokens(spark, sf), "vec_id")
    return pooled.select("vec_id", F.col("dim").cast("bigint").alias("dim"),
                         rounded("value").alias("value"))


def _weights(spark, sf):
    tokens = _tokens(spark, sf)
    weights, _ = voting.masked_softmax_pool(tokens, "vec_id")
    return weights.join(tokens.select("vec_id", "modality", "label", "present"),
                        ["vec_id", "modality"])


@query("modality_summary", f"""
WITH {_TOKENS} SELECT concat('q', m) AS modality, round(coalesce(avg(weight) FILTER (WHERE present), 0), 6) + 0.0 AS mean_weight,
  round(coalesce(stddev_pop(weight) FILTER (WHERE present), 0), 6) + 0.0 AS std_weight,
  round(avg(present::INT), 6) + 0.0 AS availability FROM wts GROUP BY m""")
def modality_summary(spark, sf):
    return _r(voting.attention_summary(_weights(spark, sf)), ["modality"],
              ["mean_weight", "std_weight", "availability"])


@query("modality_by_class", f"""
WITH {_TOKENS} SELECT label, {", ".join(f"round(avg(weight) FILTER (WHERE m = {i}), 6) + 0.0 AS q{i}" for i in range(4))}
FROM wts GROUP BY label""")
def modality_by_class(spark, sf):
    return _r(voting.attention_by_class(_weights(spark, sf), "label", _QUARTERS), ["label"], _QUARTERS)


# Classification metrics -------------------------------------------------------------------

_PRED = """pred AS (
  SELECT doc_id, lang AS t, CASE WHEN n_chars % 3 = 0 THEN lang WHEN n_chars < 500 THEN 'en'
         WHEN n_chars < 1500 THEN 'fr' ELSE 'xx' END AS p FROM documents),
lab AS (SELECT t AS label FROM pred UNION SELECT p FROM pred),
rep AS (
  SELECT label, (SELECT count(*) FROM pred WHERE t = label AND p = label) AS tp,
    (SELECT count(*) FROM pred WHERE t = label) AS support, (SELECT count(*) FROM pred WHERE p = label) AS predicted FROM lab),
sc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM rep)"""


def _predictions(spark, sf):
    n = F.col("n_chars")
    p = (F.when(n % 3 == 0, F.col("lang")).when(n < 500, "en").when(n < 1500, "fr").otherwise("xx"))
    return S.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("t"), p.alias("p"))


@query("class_report", f"WITH {_PRED} SELECT label, tp, support, predicted, {_rs(['precision', 'recall', 'f1'])} FROM sc")
def class_report(spark, sf):
    return _r(metrics.class_report(_predictions(spark, sf), "t", "p"),
              ["label", "tp", "support", "predicted"], ["precision", "recall", "f1"])


@query("class_metrics", f"""
WITH {_PRED} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) + 0.0 AS accuracy,
  round(avg(recall) FILTER (WHERE support > 0), 6) + 0.0 AS balanced_accuracy, round(avg(f1), 6) + 0.0 AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) + 0.0 AS weighted_f1 FROM sc""")
def class_metrics(spark, sf):
    return _r(metrics.class_metrics(_predictions(spark, sf), "t", "p"), ["n"],
              ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"])


@query("confusion", f"""
WITH {_PRED}, l AS (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS v),
g AS (SELECT a.v AS true, b.v AS predicted, (SELECT count(*) FROM pred WHERE t = a.v AND p = b.v) AS n FROM l a, l b)
SELECT "true", predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY "true") > 0 THEN n / sum(n) OVER (PARTITION BY "true") ELSE 0 END, 6)
  + 0.0 AS share FROM g""")
def confusion(spark, sf):
    out = metrics.confusion_matrix(_predictions(spark, sf), "t", "p", ["de", "en", "es", "fr", "xx"])
    return _r(out, ["true", "predicted", "n"], ["share"])


_ANATOMY = """an AS (
  SELECT lang AS ft, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS fp, quality = 1 AS rt, toxic = 1 OR quality = 1 AS rp
  FROM documents JOIN labels USING (doc_id))"""


@query("error_anatomy", f"""
WITH {_ANATOMY} SELECT round(avg((ft = fp)::INT), 6) + 0.0 AS family_accuracy, round(avg((rt = rp)::INT), 6) + 0.0 AS reversal_accuracy,
  count(*) FILTER (WHERE ft = fp AND rt <> rp) AS errors_within_family, count(*) FILTER (WHERE ft <> fp OR rt <> rp) AS errors_total FROM an""")
def error_anatomy(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id")

    def suffix(flag):
        return F.when(flag, "_with_reversal").otherwise("_no_reversal")

    good = F.col("quality") == 1
    rows = d.select(
        F.concat("lang", suffix(good)).alias("t"),
        F.concat(F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")),
                 suffix((F.col("toxic") == 1) | good)).alias("p"))
    return _r(metrics.error_anatomy(rows, "t", "p"), ["errors_within_family", "errors_total"],
              ["family_accuracy", "reversal_accuracy"])


# Regression metrics -----------------------------------------------------------------------

_REG = """reg AS (
  SELECT l_returnflag AS modality, l_extendedprice AS t, l_quantity * p_retailprice AS p, l_quantity AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_REG_COLS = ["mae", "rmse", "median_abs_err", "mean_residual"]


def _regression(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", "l_quantity")
    part = S.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.col("l_returnflag").alias("modality"), F.col("l_extendedprice").alias("t"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("p"), F.col("l_quantity").alias("q"))


_REG_SQL = f"""m AS (SELECT modality, count(*) AS n, avg(abs(p - t)) AS mae, sqrt(avg((p - t) * (p - t))) AS rmse,
  median(abs(p - t)) AS median_abs_err, avg(p - t) AS mean_residual, 1 - avg((p - t) * (p - t)) / var_pop(t) AS r2 FROM x GROUP BY modality)
SELECT modality, n, {_rs(_REG_COLS, 4)}, round(r2, 6) + 0.0 AS r2 FROM m"""


@query("reg_metrics", f"WITH {_REG}, x AS (SELECT * FROM reg), {_REG_SQL}")
def reg_metrics(spark, sf):
    out = metrics.regression_metrics(_regression(spark, sf), "t", "p", ["modality"])
    return out.select("modality", "n", *[rounded(c, 4).alias(c) for c in _REG_COLS],
                      rounded("r2").alias("r2"))


@query("reg_metrics_all", f"WITH {_REG}, x AS (SELECT 'all' AS modality, t, p FROM reg), {_REG_SQL}")
def reg_metrics_all(spark, sf):
    out = metrics.regression_metrics(_regression(spark, sf), "t", "p")
    return out.select(F.lit("all").alias("modality"), "n", *[rounded(c, 4).alias(c) for c in _REG_COLS],
                      rounded("r2").alias("r2"))


@query("split_mae", f"""
WITH {_REG} SELECT round(avg(abs(t / 1000 - q)) FILTER (WHERE q <= 10), 6) + 0.0 AS mae_low,
  round(avg(abs(t / 1000 - q)) FILTER (WHERE q > 10), 6) + 0.0 AS mae_high FROM reg""")
def split_mae(spark, sf):
    rows = _regression(spark, sf).withColumn("x", F.col("t") / 1000)
    return _r(metrics.split_mae(rows, "q", "x", 10), [], ["mae_low", "mae_high"])


@query("residual_by_setpoint", f"""
WITH {_REG} SELECT q, count(*) AS n, round(avg(t / 1000 - q), 6) + 0.0 AS mean_residual FROM reg GROUP BY q""")
def residual_by_setpoint(spark, sf):
    rows = _regression(spark, sf).withColumn("x", F.col("t") / 1000)
    return _r(metrics.residual_by_truth(rows, "q", "x"), ["q", "n"], ["mean_residual"])


# ROC ---------------------------------------------------------------------------------------

_RANKED = _LOGITS + """, r AS (
  SELECT class, label = class AS pos, rank() OVER (PARTITION BY class ORDER BY logit)
    + (count(*) OVER (PARTITION BY class, logit) - 1) / 2.0 AS rk,
    rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS rk_all FROM logits),
a AS (SELECT class, count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn,
  sum(rk) FILTER (WHERE pos) AS s FROM r GROUP BY class),
auc AS (SELECT class, np, (s - np * (np + 1) / 2.0) / (np * nn) AS auc FROM a WHERE np > 0)"""


@query("roc_auc_ovr", f"""
WITH {_RANKED}, mic AS (SELECT count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn,
  sum(rk_all) FILTER (WHERE pos) AS s FROM r)
SELECT CAST(class AS VARCHAR) AS curve, round(auc, 6) + 0.0 AS auc FROM auc
UNION ALL SELECT 'micro', round((s - np * (np + 1) / 2.0) / (np * nn), 6) + 0.0 FROM mic
UNION ALL SELECT 'macro', round(avg(auc), 6) + 0.0 FROM auc
UNION ALL SELECT 'weighted', round(sum(auc * np) / sum(np), 6) + 0.0 FROM auc""")
def roc_auc_ovr(spark, sf):
    return _r(metrics.roc_auc_ovr(_logits(spark, sf), "label", "logits", CLASSES), ["curve"], ["auc"])


_MACRO = _LOGITS + """, pc AS (
  SELECT class, logit, count(*) FILTER (WHERE label = class) AS pos, count(*) FILTER (WHERE label <> class) AS neg
  FROM logits GROUP BY class, logit),
pt AS (SELECT class, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER c AS np, sum(neg) OVER c AS nn FROM pc
  WINDOW w AS (PARTITION BY class ORDER BY logit DESC), c AS (PARTITION BY class)),
st AS (SELECT class, fp / nn AS fpr, tp / np AS tpr FROM pt WHERE np > 0 UNION ALL SELECT DISTINCT class, 0.0, 0.0 FROM pt WHERE np > 0),
cv AS (SELECT class, fpr, min(tpr) AS lo, max(tpr) AS hi FROM st GROUP BY class, fpr),
grid AS (SELECT g.fpr, c.class FROM (SELECT DISTINCT fpr FROM cv) g, (SELECT DISTINCT class FROM cv) c),
nb AS (
  SELECT g.fpr, g.class, arg_max(p.fpr, p.fpr) AS pf, arg_max(p.hi, p.fpr) AS ph FROM grid g JOIN cv p ON p.class = g.class AND p.fpr <= g.fpr
  GROUP BY g.fpr, g.class),
nx AS (
  SELECT g.fpr, g.class, min(p.fpr) AS nf, arg_min(p.lo, p.fpr) AS nl FROM grid g LEFT JOIN cv p ON p.class = g.class AND p.fpr > g.fpr
  GROUP BY g.fpr, g.class),
macro AS (
  SELECT fpr, avg(CASE WHEN pf = fpr OR nf IS NULL THEN ph ELSE ph + (nl - ph) * (fpr - pf) / (nf - pf) END) AS macro_tpr
  FROM nb JOIN nx USING (fpr, class) GROUP BY fpr)"""


@query("roc_macro_curve", f"WITH {_MACRO} SELECT round(fpr, 9) + 0.0 AS fpr, round(macro_tpr, 6) + 0.0 AS macro_tpr FROM macro")
def roc_macro_curve(spark, sf):
    c = metrics.macro_roc_curve(_logits(spark, sf), "label", "logits", CLASSES)
    return c.select(rounded("fpr", 9).alias("fpr"), rounded("macro_tpr").alias("macro_tpr"))


@query("roc_macro_auc", f"""
WITH {_MACRO}, s AS (SELECT fpr - lag(fpr) OVER (ORDER BY fpr) AS dx, macro_tpr + lag(macro_tpr) OVER (ORDER BY fpr) AS sy FROM macro)
SELECT round(sum(dx * sy / 2), 6) + 0.0 AS auc FROM s""")
def roc_macro_auc(spark, sf):
    c = metrics.macro_roc_curve(_logits(spark, sf), "label", "logits", CLASSES)
    return _r(metrics.curve_auc(c, "fpr", "macro_tpr"), [], ["auc"])


# Fold tables and decisions -------------------------------------------------------------------

_FM = """fm AS (
  SELECT event_type AS modality, CAST(user_id % 5 AS BIGINT) AS fold, avg(value) / 200 AS macro_f1, stddev_pop(value) / 10 AS mae
  FROM events GROUP BY ALL),
delta AS (
  SELECT r.modality AS reference, r.fold, c.macro_f1 - r.macro_f1 AS delta_macro_f1, c.mae - r.mae AS delta_mae
  FROM fm r JOIN fm c ON r.fold = c.fold AND c.modality = 'click' WHERE r.modality <> 'click')"""


def _fold_table(spark, sf):
    return S.table(spark, sf, "events").groupBy(
        F.col("event_type").alias("modality"), (F.col("user_id") % 5).alias("fold")).agg(
        (F.avg("value") / 200).alias("macro_f1"), (F.stddev_pop("value") / 10).alias("mae"))


_DELTA_COLS = ["delta_macro_f1", "delta_mae"]


@query("fold_summary", f"""
WITH {_FM} SELECT modality, round(avg(macro_f1), 6) + 0.0 AS macro_f1_mean, round(stddev_samp(macro_f1), 6) + 0.0 AS macro_f1_std,
  round(avg(mae), 6) + 0.0 AS mae_mean, round(stddev_samp(mae), 6) + 0.0 AS mae_std FROM fm GROUP BY modality""")
def fold_summary(spark, sf):
    return _r(stats.fold_summary(_fold_table(spark, sf), ["modality"], ["macro_f1", "mae"]), ["modality"],
              ["macro_f1_mean", "macro_f1_std", "mae_mean", "mae_std"])


@query("ci95", f"""
WITH {_FM}, all_rows AS (
  SELECT modality AS k, macro_f1 AS v FROM fm UNION ALL SELECT 'all', macro_f1 FROM fm
  UNION ALL SELECT concat('one ', modality), macro_f1 FROM fm WHERE fold = 0 UNION ALL SELECT 'none', NULL FROM fm),
s AS (SELECT k, count(v) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM all_rows GROUP BY k)
SELECT k, n, round(m, 6) + 0.0 AS mean,
  round(m - CASE WHEN n = 1 THEN 0 ELSE CASE WHEN n <= 5 THEN 2.776 ELSE 1.96 END * sd / sqrt(n) END, 6) + 0.0 AS ci_low,
  round(m + CASE WHEN n = 1 THEN 0 ELSE CASE WHEN n <= 5 THEN 2.776 ELSE 1.96 END * sd / sqrt(n) END, 6) + 0.0 AS ci_high FROM s""")
def ci95(spark, sf):
    fm = _fold_table(spark, sf)
    keys = F.array(F.struct(F.col("modality").alias("k"), F.col("macro_f1").alias("v")),
                   F.struct(F.lit("all").alias("k"), F.col("macro_f1").alias("v")),
                   F.struct(F.when(F.col("fold") == 0, F.concat(F.lit("one "), "modality")).alias("k"),
                            F.col("macro_f1").alias("v")),
                   F.struct(F.lit("none").alias("k"), F.lit(float("nan")).alias("v")))
    long = fm.select(F.explode(keys).alias("_x")).select("_x.k", "_x.v").where("k IS NOT NULL")
    return _r(stats.t_interval(long, ["k"], "v"), ["k", "n"], ["mean", "ci_low", "ci_high"])


@query("paired_delta", f"WITH {_FM} SELECT reference, fold, {_rs(_DELTA_COLS)} FROM delta")
def paired_delta(spark, sf):
    return _r(stats.paired_deltas(_fold_table(spark, sf), "click", ["macro_f1", "mae"]),
              ["reference", "fold"], _DELTA_COLS)


def _boot_sql(column: str, name: str) -> str:
    return f"""{name} AS (
  SELECT reference, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
    SELECT reference, it, avg(v[1 + CAST(concat('0x', substr(md5(concat('42:', it, ':', d)), 1, 8)) AS BIGINT) % len(v)]) AS m
    FROM (SELECT reference, list({column} ORDER BY fold) AS v FROM delta GROUP BY reference), range(5000) a(it), range(5) b(d)
    GROUP BY reference, it) GROUP BY reference)"""


@query("bootstrap_ci", f"""
WITH {_FM}, {_boot_sql('delta_macro_f1', 'b')}
SELECT reference, round(any_value(lo), 6) + 0.0 AS ci_low, round(any_value(hi), 6) + 0.0 AS ci_high,
  round(avg(delta_macro_f1), 6) + 0.0 AS mean FROM delta JOIN b USING (reference) GROUP BY reference""")
def bootstrap_ci(spark, sf):
    d = stats.paired_deltas(_fold_table(spark, sf), "click", ["macro_f1", "mae"])
    return _r(stats.bootstrap_interval(d, ["reference"], "delta_macro_f1"), ["reference"],
              ["mean", "ci_low", "ci_high"])


@query("bootstrap_large", """
SELECT l_returnflag AS quantity, round(avg(l_extendedprice), 4) + 0.0 AS mean, true AS low_as_normal, true AS high_as_normal
FROM lineitem GROUP BY l_returnflag""")
def bootstrap_large(spark, sf):
    """Intervals of large groups, drawn slice by slice; by the central limit they are those of the normal law.

    The SQL has the mean, and expects both limits within a quarter of the standard error.
    """
    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("quantity"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"),
        F.col("l_extendedprice").cast("double").alias("price"))
    got = stats.bootstrap_interval_sliced(rows, ["quantity"], "line", "price", n_iter=2000, slice_rows=2048)
    normal = rows.groupBy("quantity").agg(F.avg("price").alias("_m"), (F.stddev_pop("price") / F.sqrt(F.count("price"))).alias("_e"))

    def near(limit: str, z: float):
        return F.abs(F.col(limit) - (F.col("_m") + F.lit(z) * F.col("_e"))) < F.col("_e") / 4

    return got.join(normal, "quantity").select("quantity", rounded("mean", 4).alias("mean"), near("ci_low", -1.959964).alias("low_as_normal"),
                                               near("ci_high", 1.959964).alias("high_as_normal"))


def _exact_sql(column: str, name: str) -> str:
    return f"""{name}_r AS (
  SELECT reference, {column} AS d, row_number() OVER (PARTITION BY reference ORDER BY abs({column})) AS rk FROM delta),
{name} AS (
  SELECT reference, rp, rm, least(1.0, 2 * (SELECT count(*) FROM range(32) t(mask) WHERE
      (mask & 1) + 2 * ((mask >> 1) & 1) + 3 * ((mask >> 2) & 1) + 4 * ((mask >> 3) & 1) + 5 * ((mask >> 4) & 1) <= least(rp, rm)) / 32.0) AS pv
  FROM (SELECT reference, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS rp, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS rm
        FROM {name}_r GROUP BY reference))"""


@query("wilcoxon", f"""
WITH {_FM}, {_exact_sql('delta_mae', 'w')}
SELECT reference, 5::BIGINT AS n, rp::DOUBLE AS r_plus, rm::DOUBLE AS r_minus, round(pv, 6) + 0.0 AS p_value FROM w""")
def wilcoxon(spark, sf):
    d = stats.paired_deltas(_fold_table(spark, sf), "click", ["macro_f1", "mae"])
    return _r(stats.signed_rank(d, ["reference"], "delta_mae"), ["reference", "n", "r_plus", "r_minus"],
              ["p_value"])


@query("wilcoxon_large", """
WITH d AS (SELECT event_type AS reference, CASE WHEN abs(value - 45) < 1 THEN 0 ELSE round(value - 45, 0) END AS d FROM events),
nz AS (SELECT *, rank() OVER (PARTITION BY reference ORDER BY abs(d)) + (count(*) OVER (PARTITION BY reference, abs(d)) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY reference, abs(d)) AS t FROM d WHERE d <> 0),
s AS (SELECT reference, count(*) AS n, sum(rk) FILTER (WHERE d > 0) AS rp, sum(rk) FILTER (WHERE d < 0) AS rm, sum(t * t - 1.0) AS ties
      FROM nz GROUP BY reference)
SELECT reference, n, rp::DOUBLE AS r_plus, rm::DOUBLE AS r_minus,
  round((least(rp, rm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48), 6) + 0.0 AS z FROM s""")
def wilcoxon_large(spark, sf):
    shift = F.col("value") - 45
    d = S.table(spark, sf, "events").select(
        F.col("event_type").alias("reference"),
        F.when(F.abs(shift) < 1, 0.0).otherwise(F.round(shift, 0)).alias("d"))
    return _r(stats.signed_rank(d, ["reference"], "d"), ["reference", "n", "r_plus", "r_minus"], ["z"])


_CMP = [f"delta_{m}_{s}" for m in ("f1", "mae") for s in ("mean", "ci_low", "ci_high", "wilcoxon_p")]


@query("noninferiority", f"""
WITH {_FM}, {_boot_sql('delta_macro_f1', 'bf')}, {_boot_sql('delta_mae', 'bm')}, {_exact_sql('delta_macro_f1', 'wf')},
{_exact_sql('delta_mae', 'wm')},
j AS (
  SELECT reference, avg(delta_macro_f1) AS delta_f1_mean, any_value(bf.lo) AS delta_f1_ci_low, any_value(bf.hi) AS delta_f1_ci_high,
    any_value(wf.pv) AS delta_f1_wilcoxon_p, avg(delta_mae) AS delta_mae_mean, any_value(bm.lo) AS delta_mae_ci_low,
    any_value(bm.hi) AS delta_mae_ci_high, any_value(wm.pv) AS delta_mae_wilcoxon_p
  FROM delta JOIN bf USING (reference) JOIN bm USING (reference) JOIN wf USING (reference) JOIN wm USING (reference) GROUP BY reference)
SELECT reference, {_rs(_CMP)}, delta_f1_ci_low > -0.05 AS noninferior_f1, delta_mae_ci_high < 0.3 AS noninferior_mae,
  delta_f1_ci_low > -0.05 AND delta_mae_ci_high < 0.3 AS noninferior_overall FROM j""")
def noninferiority(spark, sf):
    out = stats.compare_modalities(_fold_table(spark, sf), "click", mae_margin=0.3)
    return _r(out, ["reference", "noninferior_f1", "noninferior_mae", "noninferior_overall"], _CMP)


_QUART = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("quartile_summary", f"""
WITH q AS (SELECT event_type AS modality, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY ALL),
x AS (SELECT q.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q ON event_type = modality),
s AS (SELECT modality, q1, median, q3, min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers FROM x GROUP BY ALL)
SELECT modality, outliers, {_rs(_QUART)} FROM s""")
def quartile_summary(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("event_type").alias("modality"), "value")
    return _r(stats.quartile_summary(rows, ["modality"], "value"), ["modality", "outliers"], _QUART)


@query("topk_per_group", """
SELECT l_returnflag AS modality, l_orderkey, l_linenumber, l_extendedprice AS importance FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 8""")
def topk_per_group(spark, sf):
    from waveledger.operators import ranking

    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("modality"), "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").alias("importance"))
    return ranking.top_k(rows, ["modality"], [F.desc("importance"), "l_orderkey", "l_linenumber"], 8)


# The composed comparison -----------------------------------------------------------------------

_BENCH = S.WIN + """, base AS (SELECT DISTINCT vec_id, label, group_id, vec_id // 10 % 3 AS m FROM win),
seg AS (SELECT *, row_number() OVER (PARTITION BY group_id, m ORDER BY vec_id) - 1 AS s FROM base),
have AS (SELECT group_id, label, m, count(*) AS n FROM seg GROUP BY ALL),
man AS (SELECT group_id, label, min(n + (label % 4 = 0)::INT) AS common FROM have GROUP BY ALL HAVING count(*) = 3),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', group_id))) - 1
  + CAST(concat('0x', substr(md5(concat('42:', label)), 1, 8)) AS BIGINT) % 5) % 5 AS fold FROM man),
kept AS (SELECT seg.*, fold FROM seg JOIN dealt USING (group_id) WHERE s < common),
tr AS (SELECT kept.*, f AS tf FROM kept, range(5) t(f) WHERE f <> fold),
gr AS (SELECT tf, m, group_id, count(*) AS g FROM tr GROUP BY ALL),
cl AS (SELECT tf, m, label, count(*) AS c FROM tr GROUP BY ALL),
tot AS (SELECT tf, m, sum(g) AS n, count(*) AS groups FROM gr GROUP BY ALL),
cn AS (SELECT tf, m, count(*) AS classes FROM cl GROUP BY ALL)"""


def _bench_plan(spark, sf):
    """Windows of three sensors; some points promise a window more than they have."""
    from waveledger.operators import benchmark

    w = S.windows(spark, sf).select("vec_id", "label", "group_id", F.element_at(
        F.array(*[F.lit(m) for m in fv.MODALITIES]), (F.floor(F.col("vec_id") / 10) % 3 + 1).cast("int")).alias("modality"))
    w = ordered.running_sums(w, ["group_id", "modality"], ["vec_id"], F.floor(F.col("vec_id") / F.lit(65_536)),
                             {"_at": F.lit(1).cast("bigint")})
    w = tables.staged(w.withColumn("segment_index", F.col("_at") - 1).drop("_at"), "bench-windows")
    spans = w.groupBy("group_id", "modality").agg(
        (F.lit(0.5) + 0.5 * F.count(F.lit(1)) + 0.5 * (F.min("label") % 4 == 0).cast("int")).alias("duration_s"))
    return benchmark.plan(w, spans, fv.MODALITIES, window_s=1.0, overlap=0.5)


@query("benchmark_manifest", f"""
WITH {_BENCH} SELECT dealt.group_id, dealt.label, common AS common_windows, fold, count(*) FILTER (WHERE n < common) AS shortages
FROM dealt JOIN have USING (group_id) GROUP BY ALL""")
def benchmark_manifest(spark, sf):
    made = _bench_plan(spark, sf)
    short = made.shortages.groupBy("group_id").agg(F.count(F.lit(1)).alias("shortages"))
    return made.manifest.join(short, "group_id", "left").withColumn(
        "shortages", F.coalesce("shortages", F.lit(0))).select("group_id", "label", "common_windows", "fold", "shortages")


_SENSOR = "CASE tr.m " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(fv.MODALITIES)) + " END"


@query("benchmark_training", f"""
WITH {_BENCH} SELECT tr.tf AS fold, {_SENSOR} AS modality, tr.group_id, tr.vec_id, tr.s AS segment_index,
  round((tot.n / groups / g) * (tot.n / classes / c), 6) + 0.0 AS weight
FROM tr JOIN gr ON gr.tf = tr.tf AND gr.m = tr.m AND gr.group_id = tr.group_id
JOIN cl ON cl.tf = tr.tf AND cl.m = tr.m AND cl.label = tr.label JOIN tot ON tot.tf = tr.tf AND tot.m = tr.m
JOIN cn ON cn.tf = tr.tf AND cn.m = tr.m""")
def benchmark_training(spark, sf):
    from waveledger.operators import benchmark

    rows = benchmark.training_rows(_bench_plan(spark, sf))
    return rows.select("fold", "modality", "group_id", "vec_id", "segment_index", rounded("weight").alias("weight"))
