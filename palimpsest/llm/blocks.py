"""Arrow text columns as numpy bytes, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import ship

SLICE_BYTES = 1 << 18
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
HOT_KEYS = 1000
#: Fixed value: the C library's number for the size from which blocks are mapped one by one.
MMAP_THRESHOLD = -3
#: Bits of a filter, 4 MB, however many keys it is made of: with some ten millions of keys and more it lets everything through.
FILTER_BITS = 1 << 25


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH_BYTES at most (one larger text still comes whole), unless they hold less already.

    Python workers also get this package, as every operator that calls this runs code of it there.
    """
    ship(spark)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING, "64m"))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


@lru_cache(maxsize=1)
def _allocator():
    """What gives freed memory of this process back, once it is told to keep large blocks apart; None where there is no such allocator.

    By default the allocator keeps what large arrays leave behind, so a worker that waits for its next task holds the memory of its last one.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(MMAP_THRESHOLD, 4 << 20)
        return libc.malloc_trim
    except (OSError, AttributeError):
        return None


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, giving freed memory back at the end of each task."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = _allocator()
        yield from run(batches)
        if trim is not None:
            trim(0)

    return task


def spread_join(rows: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and, in ``rows``, how many rows have that key.

    Keys of more than one in HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are sent to all tasks, so their rows stay where
    they are; rows of the other keys are shuffled. No key is null.
    """
    total = table.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") * HOT_KEYS > total
    hot = table.where(often)
    near = rows.join(F.broadcast(hot), [*key])
    far = rows.join(F.broadcast(hot.select(*key)), [*key], "left_anti").join(table.where(~often), [*key])
    return near.unionByName(far)


def maybe_in(keys: DataFrame, *names: str) -> Column:
    """A test of the columns ``names`` together: false only for values that ``keys`` lacks. It saves work and decides nothing."""
    bit = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    parts = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[parts.column("at").to_numpy()] = parts.column("bits").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return test(bit)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores behind it as it takes to differ from all ``columns``, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of up to ``limit`` bytes; a longer text comes alone."""
    data, offsets = text_bytes(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
