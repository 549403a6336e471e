"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(n: Column, d: Column) -> Column:
    """100 n / d, 0 when d is 0."""
    return F.coalesce(100.0 * n / F.nullif(d, F.lit(0)), F.lit(0.0))


def quantile(x: Column, q: float) -> Column:
    """exact, linear between neighbours, 0 for no values."""
    return F.coalesce(F.percentile(x, F.lit(q)), F.lit(0.0))


def whole(x: Column) -> Column:
    """Cut to a whole number towards zero, after rounding off what floating point adds."""
    return F.round(x, 6).cast("bigint")


def cut_bytes(s: Column, most: int = 80, keep: int = 77) -> Column:
    """Over ``most`` bytes: the characters that fit in ``keep`` bytes, and three dots."""
    fit = F.aggregate(F.split(F.left(s, F.lit(keep)), ""), F.struct(F.lit("").alias("s"), F.lit(True).alias("go")), lambda a, c: F.when(a["go"] & (F.octet_length(a["s"]) + F.octet_length(c) <= keep), F.struct(F.concat(a["s"], c).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("go"))), lambda a: a["s"])
    return F.when(F.octet_length(s) > most, F.concat(fit, F.lit("..."))).otherwise(s)


def compact_signature(name: Column, params: Column, ret: Column, line: Column, end: Column) -> Column:
    """name(params) -> ret :line-end, parameters cut at 80 bytes."""
    sig = F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"), F.when(ret.isNotNull(), F.concat(F.lit(" -> "), ret)).otherwise(""))
    return F.concat(cut_bytes(sig), F.lit(" :"), line.cast("string"), F.lit("-"), end.cast("string"))


def strip_scope(name: Column) -> Column:
    """what follows the last '::', else the last '.'."""
    return F.when(F.contains(name, F.lit("::")), F.substring_index(name, "::", -1)).otherwise(F.substring_index(name, ".", -1))


def ms_to_human(ms: Column) -> Column:
    """milliseconds, seconds, minutes or hours."""
    s = (ms / 1000).cast("bigint")
    return F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))).when(s < 60, F.format_string("%.1fs", ms / 1000.0)).when(s < 3600, F.concat((s / 60).cast("bigint").cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat((s / 3600).cast("bigint").cast("string"), F.lit("h "), ((s % 3600) / 60).cast("bigint").cast("string"), F.lit("m")))


def line_count(content: Column) -> Column:
    """lines, a final line feed adding none."""
    return F.size(F.split(content, "\n", -1)) - F.when((content == "") | F.endswith(content, F.lit("\n")), 1).otherwise(0)


def encode_cursor(mode: Column, offset: Column) -> Column:
    """base64 of the JSON cursor."""
    return F.base64(F.encode(F.to_json(F.struct(mode.alias("mode"), offset.alias("offset"))), "utf-8"))


def decode_cursor(cursor: Column) -> Column:
    """struct(mode, offset), null for a broken cursor."""
    return F.from_json(F.try_to_binary(cursor, F.lit("base64")).cast("string"), "mode string, offset bigint")


def content_hash(c: Column) -> Column:
    """F8: SHA-256, in place of a hash that Spark lacks."""
    return F.sha2(c, 256)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """lower-case extension of the last part, null if none."""
    return F.lower(F.nullif(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1), F.lit("")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def top_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def strip_base(path: Column, base: str) -> Column:
    base = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def snippet_one_line(snippet: Column) -> Column:
    """the middle line, trimmed and cut."""
    return cut_bytes(F.trim(F.coalesce(F.get(F.split(snippet, "\n", -1), F.lit(1)), F.lit(""))))


def info_parts(lines: Column, functions: Column, classes: Column) -> Column:
    """[12L, 3F, 1C] without the zero parts, null without any."""
    part = lambda n, c: F.when(n > 0, F.concat(n.cast("string"), F.lit(c)))
    parts = F.array_compact(F.array(part(lines, "L"), part(functions, "F"), part(classes, "C")))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")))


def call_marker(sig: Column, n: Column) -> Column:
    """the number of calls when over 3."""
    return F.when(n > 3, F.concat(sig, F.lit("•"), n.cast("string"))).otherwise(sig)


def lf(s: Column) -> Column:
    """line feeds only."""
    return F.replace(s, F.lit("\r\n"), F.lit("\n"))


def occurrences(s: Column, part: Column) -> Column:
    """how often ``part`` is in ``s``, not overlapping; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(s) - F.length(F.replace(s, part, F.lit("")))) / F.length(part)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def match_lines(s: Column, part: Column) -> Column:
    """numbers, from 1, of the lines in which a match starts."""
    quoted = F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pieces = F.split(s, F.concat(F.lit("\\Q"), quoted, F.lit("\\E")), -1)
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    step = lambda a, p: F.struct((a["at"] + feeds(p) + feeds(part)).alias("at"), F.concat(a["out"], F.array(a["at"] + feeds(p))).alias("out"))
    return F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])


def common_prefix(a: Column, b: Column) -> Column:
    """F16: length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.arrays_zip(F.split(F.left(a, n), "").alias("x"), F.split(F.left(b, n), "").alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, z: F.when(s["go"] & (z["x"] == z["y"]) & (z["x"] != ""), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("go"))), lambda s: s["n"])


def candidates(names: Column, most: int = 20) -> Column:
    """the first names and how many more there are."""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise(""))


def token_estimate(chars: Column) -> Column:
    """F18."""
    return F.floor(chars / 4).cast("bigint")


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """prices are for a million tokens; without a price it costs nothing."""
    return (F.coalesce(tokens_in, F.lit(0)) * F.coalesce(price_in, F.lit(0.0)) + F.coalesce(tokens_out, F.lit(0)) * F.coalesce(price_out, F.lit(0.0))) / 1_000_000.0


def utc_day(ms: Column) -> Column:
    """F20. Years of more than four digits have no sign."""
    return F.regexp_replace(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), r"^\+", "")


def run_condition(run_id: Column) -> Column:
    """F21."""
    return F.when(F.startswith(run_id, F.lit("A2_")), "A2").otherwise(F.left(run_id, F.lit(1)))


def any_timestamp(ts: Column) -> Column:
    """seconds since the epoch, or ISO with or without Z. A number is never a year."""
    return F.coalesce(F.timestamp_seconds(ts.try_cast("double")), F.try_to_timestamp(ts))


def valid_json(c: Column) -> Column:
    """F25."""
    return F.try_parse_json(c).isNotNull()


def tail(s: Column, n: int) -> Column:
    """the last n bytes, and those before them that belong to their first character."""
    raw = F.encode(s, "utf-8")
    start = F.greatest(F.octet_length(s) - n, F.lit(0))
    inside = lambda k: F.conv(F.hex(F.substring(raw, start + 1 - k, F.lit(1))), 16, 10).cast("int").between(0x80, 0xBF)
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.decode(F.substring(raw, start + 1 - back, F.lit(n + 3)), "utf-8"))
