"""Safe file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSAFE = "[^a-zA-Z0-9._-]"
RANDOM_TAG = "file"


def blank(text: Column) -> Column:
    """Null, empty or white space only (all of Unicode's)."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def sanitize_simple(text: Column) -> Column:
    """Every character that isn't safe in a name as an underscore."""
    return F.regexp_replace(text, UNSAFE, "_")


def sanitize_filename(name: Column, now_ms: int) -> Column:
    """The last part of a path as a safe, visible name; what has no usable part is named after the time.

    Separators are / and then the backslash; trailing / are not parts. A leading dot gets the prefix file_<time>_.
    """
    last = F.substring_index(F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1), "\\", -1)
    safe = sanitize_simple(last)
    unnamed = F.lit(f"file_{now_ms}")
    return (
        F.when(blank(name), F.lit(f"unknown_{now_ms}"))
        .when(safe.rlike(r"^\.*$"), unnamed)
        .when(F.startswith(safe, F.lit(".")), F.concat(unnamed, F.lit("_"), safe))
        .otherwise(safe)
    )


def split_name(name: Column) -> tuple[Column, Column]:
    """(base, extension with its dot); a dot in first place begins no extension."""
    pattern = r"(?s)^(.+)(\.[^.]*)$"
    has = name.rlike(pattern)
    return F.when(has, F.regexp_extract(name, pattern, 1)).otherwise(name), F.when(has, F.regexp_extract(name, pattern, 2)).otherwise("")


def random_base(uri: Column, seed: str, now_ms: int) -> Column:
    """A name that says nothing about the file and differs between files: the time and 64 bits of a seeded hash of the uri."""
    return F.concat(F.lit(f"{RANDOM_TAG}_{now_ms}_"), F.substring(F.md5(F.concat_ws(":", F.lit(seed), uri, F.lit("name"))), 1, 16))


def output_name(name: Column, prefix: str = "", suffix: str = "", random: Column | None = None) -> Column:
    """prefix + base + suffix + extension, each made safe; ``random`` replaces the first three."""
    base, extension = split_name(name)
    made = F.concat(sanitize_simple(F.lit(prefix)), sanitize_simple(base), sanitize_simple(F.lit(suffix))) if random is None else random
    return F.concat(made, sanitize_simple(extension))
