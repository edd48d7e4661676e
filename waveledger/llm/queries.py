"""The registered query of each operator, over the driver tables, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waveledger.llm import (
    bpe, cover_tree, exact_dedup, hard_negatives, html_text, line_crf, line_dedup, packing, periodic_runs, quality_rules,
    sharding, simhash, suffix_dedup)
from waveledger.llm.shared import BLANK, table, text_or_empty


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hex_sha256(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    decoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          hex_sha256(F.array_join("ids", ",")).alias("ids_sha256"),
                          hex_sha256(F.col("decoded")).alias("decoded_sha256"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate_documents(table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed_lines", hex_sha256(text_or_empty("text")).alias("kept_sha256"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten (by the checksum of its id) the words repeat from some place on."""
    words = F.array_remove(F.split(text_or_empty("text"), BLANK + "+"), "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("words", F.when(F.expr("h % 10 = 0"), words))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("(h div 10) % n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    again = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(table(spark, sf_dir, "documents")), copies=4, least=6)
    first = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(
        best.isNull() | (r["length"] > best["length"]), r).otherwise(best))  # runs are ordered: the first of equals stays
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        hex_sha256(lines).alias("runs_sha256"), hex_sha256(F.col("collapsed")).alias("collapsed_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.expr("vec_id % 7 = 0"), (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.expr("vec_id % 100 = 0"), scale=256, positives=5, negatives=5,
                                         low_percent=80, high_percent=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_cover_tree, op3_packing, op4_html_text, op5_sharding, op6_bpe, op7_line_crf, op8_quality_rules, op9_simhash,
                              op10_line_dedup, op11_periodic_runs, op12_exact_dedup, op13_hard_negatives)}

#: Values are spelled out rather than taken from the operators, so that a change there shows.
ORACLES: dict[str, str] = {
    "op2_cover_tree": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id
), classes AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN classes ON id = v.vec_id LEFT JOIN counts ON a = v.vec_id""",
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d
), starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM starts),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) z(k) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '[!"''()+,./:;=?@\[\\\]^_`{}~-]', '', 'g')))::BIGINT AS n_marks,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // (n_words + 50) + 20 AS m1, 1000 * n_marks // (word_chars + 250) + 4 AS m2,
    1000 * n_capitals // (word_chars + 250) + 4 AS m3, 1000 * n_repeat_words // (n_words + 50) + 20 AS m4,
    1000 * n_dup_lines // (n_lines + 10) + 100 AS m5 FROM base
), long AS (
  SELECT doc_id, lang, source, base_failed, z.m,
    CASE z.m WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 WHEN 4 THEN m4 ELSE m5 END AS v
  FROM f, (VALUES (1), (2), (3), (4), (5)) z(m)
), bins AS (
  SELECT lang, source, m, (v >> greatest(length(bin(v)) - 3, 0)::BIGINT) << greatest(length(bin(v)) - 3, 0)::BIGINT AS b,
    count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL
), scopes AS (
  SELECT 'g' AS scope, lang, source, m, b, n FROM bins
  UNION ALL SELECT 'l', lang, NULL, m, b, sum(n) FROM bins GROUP BY lang, m, b
  UNION ALL SELECT 'o', NULL, NULL, m, b, sum(n) FROM bins GROUP BY m, b
  UNION ALL SELECT 'e', lang, NULL, m, b, sum(1000000 * n // rows)
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, m) AS rows FROM bins) GROUP BY lang, m, b
), seen AS (
  SELECT *, sum(n) OVER (PARTITION BY scope, lang, source, m) AS rows, sum(n) OVER (PARTITION BY scope, lang, source, m ORDER BY b) AS upto
  FROM scopes
), shapes AS (
  SELECT scope, lang, source, m, first(rows) AS rows, min(b) FILTER (4 * upto >= rows) AS q1, min(b) FILTER (4 * upto >= 3 * rows) AS q3,
    list(b ORDER BY b) FILTER (1000 * n > rows) AS occupied FROM seen GROUP BY scope, lang, source, m
), picked AS (
  SELECT g.lang, g.source, g.m, CASE WHEN g.rows >= 200 THEN g.occupied WHEN l.rows >= 200 THEN l.occupied ELSE o.occupied END AS occupied,
    least(4 * e.q3 - 3 * e.q1, CASE WHEN g.rows >= 200 THEN 4 * g.q3 - 3 * g.q1 WHEN l.rows >= 200 THEN 4 * l.q3 - 3 * l.q1
      ELSE 4 * o.q3 - 3 * o.q1 END) AS fence
  FROM shapes g JOIN shapes l ON l.scope = 'l' AND g.lang IS NOT DISTINCT FROM l.lang AND g.m = l.m
  JOIN shapes e ON e.scope = 'e' AND g.lang IS NOT DISTINCT FROM e.lang AND g.m = e.m
  JOIN shapes o ON o.scope = 'o' AND g.m = o.m WHERE g.scope = 'g'
), cuts AS (
  SELECT lang, source, m, [2 * greatest(occupied[i], fence) FOR i IN range(1, len(occupied))
    IF occupied[i + 1] >= 4 * greatest(occupied[i], fence)][1] AS cut FROM picked
), bad AS (
  SELECT DISTINCT doc_id FROM long JOIN cuts ON long.lang IS NOT DISTINCT FROM cuts.lang
    AND long.source IS NOT DISTINCT FROM cuts.source AND long.m = cuts.m AND v > cut
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad ON bad.doc_id = f.doc_id""",
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), words AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS g
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM windows WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1
), gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, (VALUES (0), (1), (2)) z(j)),
marked AS (
  SELECT lines.doc_id, lines.i, lines.line, words.k IS NOT NULL AS real, gone.k IS NOT NULL AS gone
  FROM lines LEFT JOIN words ON words.doc_id = lines.doc_id AND words.i = lines.i
  LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k
)
SELECT doc_id, count(*) FILTER (real) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    # the checksum bit by bit; runs as islands of equal words a period apart
    "op11_periodic_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents
), p AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h % 10 = 0 AND len(ws) > 0 AS planted FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS step FROM p),
w AS (
  SELECT doc_id, n, CASE WHEN planted THEN [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % step END] FOR i IN range(n)] ELSE ws END AS ws
  FROM q
), places AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal
), stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM islands GROUP BY doc_id, q, g
  HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)
), runs AS (SELECT doc_id, s, e, min(q) AS q FROM stretches GROUP BY doc_id, s, e),
facts AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min({'s': s, 'l': e - s, 'q': q}, {'l': s - e, 's': s, 'q': q}) AS best
  FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (
  SELECT places.doc_id, string_agg(word, ' ' ORDER BY places.i) AS text
  FROM places ANTI JOIN gone ON gone.doc_id = places.doc_id AND gone.i = places.i GROUP BY places.doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length,
  best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN facts ON facts.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER r)::INTEGER AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW r AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER r <= 5""",
}
