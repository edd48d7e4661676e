"""Quality rules whose cut-offs follow each language and source, from mergeable quantile sketches.

No cut-off is a constant: quartiles tell where the bulk of a group ends, and the sketch's empty
bins where something else begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waveledger.llm.shared import BLANK, WORD, checked, text_or_empty, with_columns
from waveledger.sources.tables import staged

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

#: Metric -> what is counted, out of what, and how many of these count besides as without any, so
#: that one event in a short text is no high rate.
METRICS = {
    "symbol_rate": ("n_symbols", "n_words", 50),
    "mark_rate": ("n_marks", "word_chars", 250),         # other ASCII punctuation marks than symbols
    "capital_rate": ("n_capitals", "word_chars", 250),   # A-Z
    "repeat_rate": ("n_repeat_words", "n_words", 50),    # words in repeated three-word windows
    "dup_line_rate": ("n_dup_lines", "n_lines", 10),     # lines equal to an earlier line
}
#: The bulk of a group ends at the third quartile and so many times the distance between the quartiles.
SPREAD = 3
#: Beyond the bulk a gap of this factor parts a second mode from it.
GAP = 4
#: A bin with one row of so many or fewer counts as empty.
THIN = 1000
#: Groups with fewer rows use the merged sketch of their language, then that of all rows.
MIN_GROUP = 200
#: Significant bits of a sketch bin: four bins to a factor of two.
BITS = 3


def _removed(text: Column, pattern: str) -> Column:
    """Bytes that the ASCII characters of `pattern` take in `text`."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, F.lit(pattern), F.lit("")))).cast("long")


def base_features(df: DataFrame, text: Column) -> DataFrame:
    """Add the counts the rules are made of, as longs, for a column that is not null.

    Words in repeated windows are found by hashing every three consecutive words and sorting
    the (hash, position) pairs of the text, so the work is near-linear in its length.
    """
    df = df.withColumn("_words", F.array_remove(F.split(text, BLANK + "+"), ""))
    df = df.withColumn("_n", F.size("_words"))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    windows = F.transform(F.slice("_words", F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_windows", windows)
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"),
                                        F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0)))
    twice = F.filter("_pairs", lambda p, j: (F.get("_pairs", j - 1)["h"] == p["h"]).eqNullSafe(True)
                     | (F.get("_pairs", j + 1)["h"] == p["h"]).eqNullSafe(True))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda p: p["i"])))
    cover = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))))
    letters = F.array_join("_words", "")
    df = df.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.char_length(letters).cast("long"),
        "n_symbols": _removed(text, SYMBOLS),
        "n_marks": _removed(text, r"[!\"'()+,./:;=?@\[\\\]^_`{}~-]"),
        "n_capitals": _removed(text, "[A-Z]"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate(cover, F.lit(0), lambda a, x: a + x).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.drop("_words", "_n", "_lines", "_windows", "_pairs", "_at").withColumn("base_failed", failed)


def metrics() -> dict[str, Column]:
    """Each metric as a long above zero: its rate in thousandths, and that of one event in no text."""
    return {m: F.expr(f"1000 * {part} div ({whole} + {prior}) + {1000 // prior}")
            for m, (part, whole, prior) in METRICS.items()}


def _bin(value: Column) -> Column:
    """Lower end of the value's bin: the leading BITS bits, so bins widen with the value."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(features: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): mergeable by adding n; at most a few hundred bins a metric.

    Rows that fail the base rules are left out. The counts are exact integers, so a repeated
    task changes nothing and merging in any order gives the same sketch.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bin(v).alias("bin"))
                                for m, v in metrics().items()]))
    return (features.filter("not base_failed").select("lang", "source", pairs.alias("p"))
            .groupBy("lang", "source", "p.metric", "p.bin").agg(F.count(F.lit(1)).alias("n")))


def _shape(merged: DataFrame, keys: list[str]) -> DataFrame:
    """rows, quartiles and occupied bins (in order) of each sketch; a quartile is the first bin that holds its rank."""
    one = Window.partitionBy(*keys, "metric")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(one)})
    return seen.groupBy(*keys, "metric").agg(
        F.first("rows").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("bin"))).alias("q3"),
        F.sort_array(F.collect_list(F.when(THIN * F.col("n") > F.col("rows"), F.col("bin")))).alias("bins"))


def cutoffs(sketched: DataFrame) -> DataFrame:
    """One row for each language and source that has rows left: a cut-off for each metric, null if it has none.

    The bulk ends at a fence from the quartiles of the group's sketch, or from those of a sketch
    in which every source of the language weighs alike, whichever is lower: so a source that is
    junk for a good part does not hide it, and a hot source does not speak for the others. The
    cut-off lies in the first gap at or beyond the fence that parts a second mode from the bulk;
    where values only thin out, nothing is cut off.
    """
    merged = ["lang", "metric", "bin"]
    alike = sketched.withColumn("n", F.expr("1000000 * n div sum(n) over (partition by lang, source, metric)"))
    shapes = {
        "g": (_shape(sketched, ["lang", "source"]), ["lang", "source"]),
        "l": (_shape(sketched.groupBy(*merged).agg(F.sum("n").alias("n")), ["lang"]), ["lang"]),
        "o": (_shape(sketched.groupBy("metric", "bin").agg(F.sum("n").alias("n")), []), []),
        "e": (_shape(alike.groupBy(*merged).agg(F.sum("n").alias("n")), ["lang"]), ["lang"]),
    }
    wide = {name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("metric").alias(f"{name}_metric"),
                            F.struct("rows", "q1", "q3", "bins").alias(name)) for name, (df, keys) in shapes.items()}
    joined = (wide["g"].join(wide["l"], F.expr("g_lang <=> l_lang and g_metric = l_metric"))
              .join(wide["e"], F.expr("g_lang <=> e_lang and g_metric = e_metric"))
              .join(wide["o"], F.expr("g_metric = o_metric")))
    pick = F.when(F.col("g.rows") >= MIN_GROUP, F.col("g")).when(F.col("l.rows") >= MIN_GROUP, F.col("l")).otherwise(
        F.col("o"))
    joined = joined.withColumn("p", pick).withColumn("fence", F.least(*[
        F.col(f"{x}.q3") + SPREAD * (F.col(f"{x}.q3") - F.col(f"{x}.q1")) for x in "pe"]))
    edges = F.transform("p.bins", lambda x, i: F.struct(F.greatest(x, F.col("fence")).alias("lo"),
                                                        F.get("p.bins", i + 1).alias("hi")))
    gaps = F.filter(edges, lambda x: F.coalesce(x["hi"] >= GAP * x["lo"], F.lit(False)))
    cut = F.get(F.transform(gaps, lambda x: 2 * x["lo"]), F.lit(0))
    return (joined.withColumn("cut", cut).groupBy(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"))
            .agg(*[F.max(F.when(F.col("g_metric") == m, F.col("cut"))).alias(f"cut_{m}") for m in METRICS]))


def judge(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add `kept`: no base failure and no metric above its cut-off.

    `cuts` has one row for each language and source; Spark broadcasts it if its written size
    allows, and joins by shuffle otherwise.
    """
    cuts = cuts.withColumnsRenamed({"lang": "_cut_lang", "source": "_cut_source"})
    joined = features.join(cuts, F.expr("lang <=> _cut_lang and source <=> _cut_source"), "left")
    # a sum, not a conjunction: a filter on it stays whole and above the join, so the optimiser
    # does not copy the text expressions into it
    faults = F.coalesce(F.col("base_failed"), F.lit(True)).cast("int")
    for m, v in metrics().items():
        faults = faults + F.coalesce(v > F.col(f"cut_{m}"), F.lit(False)).cast("int")
    return joined.withColumn("kept", faults == 0).drop("_cut_lang", "_cut_source", *[f"cut_{m}" for m in METRICS])


def _features(docs: DataFrame, lang_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    checked(docs, text_col, lang_col, source_col)
    rows = docs.select(*more, F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("_text"))
    return base_features(rows, F.col("_text")).drop("_text")


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, lang, source, all counts, base_failed, kept.

    The counts are written once, sketched, and joined with the cut-offs. A null text has no
    words and fails. Null languages and sources are groups of their own. Equal rows are judged
    alike; an empty table gives an empty result.
    """
    checked(docs, id_col)
    feats = staged(_features(docs, lang_col, source_col, text_col, F.col(id_col).alias("doc_id")), "features")
    return judge(feats, staged(cutoffs(sketch(feats)), "cutoffs"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, unchanged.

    Rows are written once with their counts, of which the sketch reads nothing else: counting
    costs more than the copy. No text is shuffled, as the cut-offs come to the rows.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    feats = staged(_features(docs, lang_col, source_col, text_col, row), "features")
    cuts = staged(cutoffs(sketch(feats)), "cutoffs")
    return judge(feats, cuts).filter("kept").select(*with_columns(docs, "_row", {}))
