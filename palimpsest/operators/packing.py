"""Packing of files into tasks of near equal bytes, before any content is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import materialize

#: Bytes that a file counts besides its own, so that very many empty ones don't meet in one task.
FILE_BYTES = 4096


def running_sums(rows: DataFrame, amounts: tuple[str, ...], *order: str) -> DataFrame:
    """``rows`` with, for each of ``amounts``, ``<amount>_before``, its sum over all rows before in ``order``, and ``<amount>_total``, that over all rows.

    Rows are cut into ranges of the order; windows run within a range, and over one row for each range. Null amounts count as 0. Rows that
    agree in the whole ``order`` are in one range and in no certain order.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    sums = ranged.groupBy("__range").agg(*[zero(F.sum(a)).alias(f"__{a}") for a in amounts])
    # One row for each range, so as many as there are shuffle partitions.
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.select("__range", *[x for a in amounts for x in (zero(F.sum(f"__{a}").over(upto)).alias(f"__start_{a}"), F.sum(f"__{a}").over(Window.partitionBy()).alias(f"{a}_total"))]), "range-starts")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.select("*", *[zero(F.sum(a).over(within)).alias(f"__within_{a}") for a in amounts]).join(F.broadcast(starts), "__range")
    return joined.select(*rows.columns, *[x for a in amounts for x in ((F.col(f"__start_{a}") + F.col(f"__within_{a}")).alias(f"{a}_before"), f"{a}_total")])


def pack(files: DataFrame, tasks: int, *order: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``files`` (size_bytes, ...) with the number ``task`` of 0 to ``tasks`` - 1, contiguous in ``order`` (uri by default), and ``weight``, the bytes a file counts.

    A file goes to the task in whose equal share of all bytes it begins. So a task's bytes exceed the mean by less than its last file, and a
    file is never split. A null size counts as 0; ``file_bytes`` are added to each. An empty table gives no rows.
    """
    weighed = files.withColumn("weight", F.coalesce("size_bytes", F.lit(0)).cast("bigint") + F.lit(file_bytes))
    summed = running_sums(weighed, ("weight",), *(order or ("uri",)))
    share = F.call_function("div", F.col("weight_before").cast("decimal(20,0)") * F.lit(tasks), F.greatest("weight_total", F.lit(1)))
    return summed.withColumn("task", F.least(share, F.lit(tasks - 1)).cast("int")).drop("weight_before", "weight_total")


def tasks_for(total_bytes: int, task_bytes: int) -> int:
    """How many tasks of about ``task_bytes`` take ``total_bytes``."""
    return max(1, -(-total_bytes // task_bytes))


def dealt(packed: DataFrame, tasks: int) -> DataFrame:
    """``packed`` with the rows of each task in a partition of its own, as the next step's tasks: partition k has task k."""
    return packed.repartitionById(tasks, "task")
