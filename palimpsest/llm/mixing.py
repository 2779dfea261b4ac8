"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Each row has a 60-bit hash. A source's budget keeps the rows whose hash is up to a threshold, so thresholds are
nested: a larger budget keeps all that a smaller one kept. The threshold is found without sorting: sum sizes by
source and hash bucket, find the bucket in which the budget ends, refine only that bucket by the next bits of the
hash, and so on until single hash values are told apart; then filter. Targets, histograms and open buckets are
tables; the driver sees no source. Only the table of totals, one row per source, passes through single tasks, to be
ranked and to find the level at which sources are full.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.blocks import spread_join
from palimpsest.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes, as a fraction
MAX_REPEATS = 2
HASH_BITS = 60
ROUND_BITS = 10


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters (blank: space and the controls 9 to 13); null: 0.

    With all blanks turned to spaces and short runs of them to one, spaces are counted by what a text loses without them. Texts with longer
    runs are split by a pattern, which takes several times as long.
    """
    flat = text
    for blank in "\t\n\v\f\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    for _ in range(2):
        flat = F.replace(flat, F.lit("  "), F.lit(" "))

    def split(t: Column) -> Column:
        return F.size(F.filter(F.split(t, " +"), lambda w: w != ""))

    def count(t: Column) -> Column:
        spaces = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
        return F.when(t == "", 0).when(F.contains(t, F.lit("  ")), split(t)).otherwise(spaces + 1)

    # through an array, so that the replacing is done once
    return F.coalesce(F.get(F.transform(F.array(F.trim(flat)), count), F.lit(0)), F.lit(0)).cast("long")


def row_hash(key: Column) -> Column:
    """A 60-bit number from the first 15 hex digits of the MD5 of the key as text (null: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), source.cast("string")))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """(key, rows, source_size, target, whole, rest) per key of ``rows`` (key, size): the target, how often it holds the source, and what is left.

    Targets are by weight, none above ``most`` times its size; the excess goes to the others by weight, again and again. That ends
    with the sources full whose size per weight is lowest; the first that isn't full says what a weight of 1 gets. Sums are exact.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    totals = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1))
    scaled = whole("source_size") * F.floor(F.lit(lcm(*weights)) / F.col("w")).cast("decimal(10,0)")
    order = Window.orderBy("scaled", "key")
    filled = weighed.withColumn("scaled", scaled).select(
        "*",
        F.row_number().over(order).alias("place"),
        (whole("source_size") * 0 + F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(38,0)").alias("before"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"),
        F.sum("source_size").over(Window.partitionBy()).alias("everything"),
    )
    # what is left before this source, in units of 1 / share[1]
    left = (whole("everything") * share[0] - F.col("before") * (share[1] * most)).cast("decimal(38,0)")
    filled = filled.withColumn("left_units", left)
    is_full = F.col("w") * F.col("left_units") > whole("source_size") * F.col("open_w") * (share[1] * most)
    filled = filled.withColumn("is_full", is_full)
    first = F.min(F.when(~F.col("is_full"), F.struct("place", "left_units", "open_w"))).over(Window.partitionBy())
    filled = filled.withColumn("level", first)
    num = F.when(F.col("is_full"), whole("source_size") * most).otherwise((F.col("w") * F.col("level.left_units")).cast("decimal(38,0)"))
    den = F.when(F.col("is_full"), F.lit(1)).otherwise(F.col("level.open_w") * share[1]).cast("decimal(20,0)")
    filled = filled.withColumns({"num": num.cast("decimal(38,0)"), "den": den})
    goal = F.expr("num div den")
    times = F.when(F.col("source_size") > 0, F.expr("(num div den) div source_size")).otherwise(0).cast("long")
    return filled.select(
        "key", "rows", "source_size", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"), times.alias("whole"), (goal - times * F.col("source_size")).cast("long").alias("rest")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, cut) per row of ``budgets`` (key, rest): the hash up to which rows of that key are kept; ``rows`` has key, size and h, never null.

    The sizes of the rows kept are as near to ``rest`` as sizes of whole hashes from the lowest on come; of two as near ones the smaller.
    A round sums by buckets of ROUND_BITS more bits, only in the bucket in which a budget ends, until that is one hash.
    """
    found: list[DataFrame] = []
    shift, inside, left = HASH_BITS - ROUND_BITS, rows, budgets.select("key", F.col("rest").alias("left"))
    while True:
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        upto = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))  # 2**ROUND_BITS buckets of a key at most
        over = sums.withColumn("upto", upto).join(left, "key").where("upto > left")
        state = over.groupBy("key").agg(F.min_by(F.struct("bucket", "first", "last", "size", "upto", "left"), "bucket").alias("b")).select("key", "b.*")
        state = materialize(state.withColumn("left", F.expr("left - (upto - size)")), "mix-buckets")
        # in a bucket of one hash the budget ends at that hash or before it, whichever is nearer
        found.append(state.where("first = last").select("key", F.expr("CASE WHEN size - left < left THEN last ELSE last - 1 END").alias("cut")))
        still = state.where("first < last").select("key", "bucket", "left")
        if still.isEmpty():
            break
        # few rows, as a rule; no hint, so that they are sent to all tasks only when Spark finds them small
        inside = rows.withColumn("bucket", F.shiftright("h", shift)).join(still.drop("left"), ["key", "bucket"]).drop("bucket")
        left = still.select("key", "left")
        shift -= ROUND_BITS
    cuts = found[0]
    for more in found[1:]:
        cuts = cuts.unionByName(more)
    return budgets.select("key").join(cuts, "key", "left").select("key", F.coalesce("cut", F.lit((1 << HASH_BITS) - 1)).alias("cut"))


def _plan(docs: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, table): doc_id, key, size and h per row of ``docs``; what the mix does with each key."""
    rows = materialize(docs.select("doc_id", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("h")), "mix")
    targets = materialize(source_targets(rows, weights, share, most), "mix-targets")
    table = targets.join(thresholds(rows, targets), "key").drop("rest")
    return rows, materialize(table, "mix-table")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken, repeats.

    Sources in code-point order, null last, take ``weights`` in turn. ``taken`` is size times ``repeats``: each row is taken as
    often as its source's target holds the whole source, and once more if its hash is up to the source's threshold.
    What a source's rows take differs from its target by half the size of the rows of one hash at most, and by less than 1 for rounding.
    Nulls: a null text has size 0; null sources are one source; null ids share one hash. Rows with equal ids are taken alike,
    so a boundary can only fall between ids. Very long texts are counted whole. An empty table gives no rows; a source without words has
    target 0. Other columns aren't read.
    """
    rows, table = _plan(docs, weights, share, most)
    repeats = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    return spread_join(rows, table, "key").select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def repeat_mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it; rows that it doesn't take go. All columns stay, under any names."""
    _, table = _plan(docs, weights, share, most)
    table = table.select("key", "rows", "whole", "cut")
    held = docs.select(F.struct("*").alias("row"), source_key(docs["source"]).alias("key"), row_hash(docs["doc_id"]).alias("h"))
    repeats = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    taken = spread_join(held, table, "key").where(repeats > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), repeats)).alias("copy"))
    return taken.select("row.*")
