"""Numbers and places as text, and text as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB = 1024, 1024 * 1024


def size_number(size: Column) -> tuple[Column, Column]:
    """(number, unit) of a size: MB or KB as a fraction, else Bytes."""
    unit = F.when(size >= MB, "MB").when(size >= KB, "KB").otherwise("Bytes")
    return F.when(size >= MB, size / MB).when(size >= KB, size / KB).otherwise(size.cast("double")), unit


def size_label(size: Column) -> Column:
    """One decimal for MB and KB, none for Bytes."""
    number, unit = size_number(size)
    return F.when(size >= KB, F.format_string("%.1f %s", number, unit)).otherwise(F.format_string("%d %s", size, unit))


def parse_double(text: Column) -> Column:
    """The number that ``text`` says, null if it says none."""
    return text.try_cast("double")


def parse_long(text: Column) -> Column:
    """The whole number that ``text`` says, null if it says none."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def duration_label(milliseconds: Column) -> Column:
    """Whole seconds with an s; what is no number counts as 0."""
    return F.concat((F.call_function("div", F.coalesce(parse_long(milliseconds), F.lit(0).cast("bigint")), F.lit(1000).cast("bigint"))).cast("string"), F.lit("s"))


def resolution_label(width: Column, height: Column) -> Column:
    """<width>x<height>, null if either is."""
    return F.concat(width, F.lit("x"), height)


def hemisphere(degrees: Column, positive: str, negative: str) -> Column:
    """Which side of the equator or the prime meridian; 0 is positive."""
    return F.when(degrees >= 0, positive).otherwise(negative)


def plain(number: Column) -> Column:
    """A double as text, small ones without an exponent: 0.0005, where Spark's own text is 5.0E-4."""
    text = number.cast("string")
    digits = F.rtrim(F.translate(F.split_part(text, F.lit("E-"), F.lit(1)), "-.", ""), F.lit("0"))
    zeros = F.repeat(F.lit("0"), F.split_part(text, F.lit("E-"), F.lit(2)).try_cast("int") - 1)
    small = F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.lit("0."), zeros, digits)
    return F.when(F.contains(text, F.lit("E-")), small).otherwise(text)


def plain_sql(number: str) -> str:
    """:func:`plain` as SQL text."""
    text = f"cast({number} as string)"
    digits = f"trim(TRAILING '0' FROM translate(split_part({text}, 'E-', 1), '-.', ''))"
    zeros = f"repeat('0', try_cast(split_part({text}, 'E-', 2) as int) - 1)"
    return f"CASE WHEN contains({text}, 'E-') THEN concat(if(startswith({text}, '-'), '-', ''), '0.', {zeros}, {digits}) ELSE {text} END"


def location_text(latitude: Column, longitude: Column) -> Column:
    return F.concat(plain(latitude), F.lit(", "), plain(longitude))


def degrees(text: Column, ref: Column) -> Column:
    """A coordinate as images hold it, degrees, minutes and seconds as fractions or one number, with its hemisphere; null if it says none."""
    parts = F.split(text, ",")
    one = lambda i: F.try_divide(parse_double(F.split_part(F.get(parts, F.lit(i)), F.lit("/"), F.lit(1))), parse_double(F.split_part(F.get(parts, F.lit(i)), F.lit("/"), F.lit(2))))
    size = F.when(F.size(parts) == 3, one(0) + one(1) / 60 + one(2) / 3600).otherwise(parse_double(text))
    return F.when(ref.isin("S", "W"), -size).otherwise(size)


def point(text: Column, which: int) -> Column:
    """Latitude (1) or longitude (2) of a place as media containers hold it: +45.5000-120.2500/."""
    return F.nullif(F.regexp_extract(text, "^([+-][0-9.]+)([+-][0-9.]+)", which), F.lit("")).try_cast("double")
