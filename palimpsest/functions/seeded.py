"""Choices that depend on a seed, a record and a field only: the same after any repartitioning or retry.

Each is there on a column and, as ``*_sql``, as SQL text on the name of a column. Plans with many choices are made of text: one call to the JVM
makes a whole expression then, where columns take one or two for every literal and function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(seed: str, key: Column, field: str) -> Column:
    """The first 32 bits of the MD5 of seed:key:field as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, F.lit(field))), 1, 8), 16, 10).cast("bigint")


def whole(seed: str, key: Column, field: str, low: int, high: int) -> Column:
    """A whole number from ``low`` to below ``high``."""
    return hash32(seed, key, field) % (high - low) + low


def picked(seed: str, key: Column, field: str, options: Sequence[str]) -> Column:
    """One of ``options``."""
    return F.element_at(F.array(*map(F.lit, options)), (hash32(seed, key, field) % len(options) + 1).cast("int"))


def chosen(seed: str, key: Column, field: str, options: Column) -> Column:
    """One element of an array column."""
    return F.element_at(options, (hash32(seed, key, field) % F.size(options) + 1).cast("int"))


def shuffled(seed: str, key: Column, field: str, options: Sequence[str]) -> Column:
    """``options`` in the order of their own hashes."""
    pairs = [F.struct(hash32(seed, key, f"{field}{i}").alias("h"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(options)]
    return F.transform(F.array_sort(F.array(*pairs)), lambda p: p["x"])


def quoted(text: str) -> str:
    """``text`` as a SQL literal. A dollar sign goes as its code, as Spark puts settings in the place of names after one."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def listed(values: Sequence[str]) -> str:
    """An array of literals."""
    return f"array({', '.join(map(quoted, values))})"


def hash32_sql(seed: str, key: str, field: str) -> str:
    """:func:`hash32`."""
    return f"cast(conv(substring(md5(concat_ws(':', {quoted(seed)}, {key}, {quoted(field)})), 1, 8), 16, 10) as bigint)"


def whole_sql(seed: str, key: str, field: str, low: int, high: int) -> str:
    """:func:`whole`."""
    return f"({hash32_sql(seed, key, field)} % {high - low} + {low})"


def chosen_sql(seed: str, key: str, field: str, options: str) -> str:
    """:func:`chosen`."""
    return f"element_at({options}, cast({hash32_sql(seed, key, field)} % size({options}) + 1 as int))"


def picked_sql(seed: str, key: str, field: str, options: Sequence[str]) -> str:
    """:func:`picked`."""
    return f"element_at({listed(options)}, cast({hash32_sql(seed, key, field)} % {len(options)} + 1 as int))"


def shuffled_sql(seed: str, key: str, field: str, options: Sequence[str]) -> str:
    """:func:`shuffled`."""
    pairs = ", ".join(f"struct({hash32_sql(seed, key, f'{field}{i}')} as h, {i} as i, {quoted(x)} as x)" for i, x in enumerate(options))
    return f"transform(array_sort(array({pairs})), p -> p.x)"
