"""Scalar column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from waveledger import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round, and turn -0.0 into 0.0 so equal values also print equal."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def is_finite(c: Column | str) -> Column:
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(c: Column | str) -> Column:
    x = col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def finite_or_zero(c: Column | str) -> Column:
    return F.when(is_finite(c), col(c).cast("double")).otherwise(F.lit(0.0))


def fill_missing(c: Column | str, value: float = 0.0) -> Column:
    """Null and NaN both count as missing; infinities are kept."""
    return F.coalesce(nan_to_null(c), F.lit(float(value)))


def slugify(c: Column | str) -> Column:
    """Lower-case ASCII key: transliterate, then join letter/digit runs with `_`."""
    out = F.lower(trimmed(c))
    single = {k: v for k, v in fv.TRANSLITERATION.items() if len(v) == 1}
    for letter, latin in fv.TRANSLITERATION.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.regexp_replace(out, "[^a-z0-9]+", "_")
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


def map_lookup(c: Column | str, table: Mapping) -> Column:
    """Look a key up in a small fixed table; null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[col(c)]


def label_or_self(c: Column | str, table: Mapping[str, str]) -> Column:
    return F.coalesce(map_lookup(c, table), col(c))


def file_stem(c: Column | str) -> Column:
    name = F.regexp_replace(col(c), r"^.*[/\\]", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def setpoint_from_name(c: Column | str) -> Column:
    """Leading integer of a file stem, or null."""
    digits = F.regexp_extract(file_stem(c), r"^\s*(\d+)", 1)
    return digits.try_cast("int")


def recording_file_name(setpoint: Column | str, sensor: Column | str,
                        extension: Column | str) -> Column:
    return F.format_string("speed%03d_%s%s", col(setpoint).cast("int"), col(sensor),
                           col(extension))


def parse_recording_name(stem: Column | str) -> Column:
    """Struct(speed_percent, sensor); null where the whole name does not match."""
    pattern = r"^speed(\d+)_(.+)$"
    s = col(stem)
    return F.when(s.rlike(pattern), F.struct(
        F.regexp_extract(s, pattern, 1).try_cast("int").alias("speed_percent"),
        F.regexp_extract(s, pattern, 2).alias("sensor"),
    ))


def group_key(condition: Column | str, setpoint: Column | str) -> Column:
    """Operating-point key; null when either part is null."""
    return F.concat(col(condition), F.lit("__"), col(setpoint).cast("int").cast("string"))


def segment_key(group: Column | str, segment: Column | str) -> Column:
    return F.format_string("%s__seg%03d", col(group), col(segment).cast("int"))


def match_within(actual: Column | str, expected: Column | str, tolerance: float = 0.0) -> Column:
    """Three-valued check: null = nothing to compare with, false = value missing."""
    a, e = nan_to_null(actual), nan_to_null(expected)
    return (F.when(e.isNull(), F.lit(None).cast("boolean"))
            .when(a.isNull(), F.lit(False))
            .otherwise(F.abs(a - e) <= F.lit(float(tolerance))))


def si_format(c: Column | str, unit: str = "") -> Column:
    """Four significant digits with an SI prefix, e.g. `1.25 mV`."""
    v = col(c).cast("double")
    power = F.floor(F.log10(F.abs(v)) / 3) * 3
    power = F.greatest(F.least(power, F.lit(12)), F.lit(-15)).cast("int")
    text = F.format_string("%.4g", v / F.pow(F.lit(10.0), power))
    text = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    text = F.regexp_replace(text, r"\.(e|$)", "$1")
    scaled = F.concat(text, F.lit(" "), map_lookup(power, fv.SI_PREFIXES), F.lit(unit))
    special = F.concat(
        F.when(v == 0, "0").when(F.isnan(v), "nan").when(v > 0, "inf").otherwise("-inf"),
        F.lit(f" {unit}"))
    plain = (v == 0) | ~is_finite(v)
    return F.when(v.isNotNull(), trimmed(F.when(plain, special).otherwise(scaled)))


def si_parse_seconds(c: Column | str) -> Column:
    """`-25s`, `2us`, `500ms`, `2e-06s` to seconds; null if not a number."""
    text = trimmed(c)
    pattern = r"^([+-]?[\d.]+(?:[eE][+-]?\d+)?)\s*([afpnumkM]?)s?$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    factor = map_lookup(F.regexp_extract(text, pattern, 2), fv.SECONDS_FACTORS)
    bare = F.regexp_replace(text, "s+$", "").try_cast("double")
    return F.when(text.rlike(pattern), number * factor).otherwise(bare)


def path_problem(path: Column | str, extensions: Sequence[str] = ()) -> Column:
    """Why a stored path is unsafe: absolute, escaping or of the wrong type; else null."""
    p = col(path)
    extension = F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))
    out = (F.when(p.isNull() | (trimmed(p) == ""), "empty")
           .when(p.startswith("/") | p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute")
           .when(F.array_contains(F.split(p, r"[/\\]"), ".."), "escapes root"))
    if extensions:
        out = out.when(~extension.isin([e.lower() for e in extensions]), "extension")
    return out


def scale_setpoint(c: Column | str) -> Column:
    return (col(c).cast("double") - 1.0) / 99.0


def unscale_setpoint(c: Column | str) -> Column:
    return col(c).cast("double") * 99.0 + 1.0


def portable_hash(*parts: Column | str) -> Column:
    """32-bit integer from md5 of the colon-joined parts; same on every engine."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def condition_family(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("_with_reversal"), F.lit("")),
                     F.lit("_no_reversal"), F.lit(""))


def reversal_flag(c: Column | str) -> Column:
    return F.when(col(c).contains("with_reversal"), "with").otherwise("no")
