"""Minimax contiguous partition of ordered atomic groups into shards (DataFrame functions only).

Groups are rows with equal texts, in the order of a 64-bit hash of the text. The smallest capacity that lets a greedy
pass fill at most the given number of shards is found by binary search. It bounds the shards; they are cut near equal
sizes below it, so that a group larger than a fair share doesn't set the size of all others.

A greedy pass needs running sums over all groups, which the driver must not hold. It holds sums by hash range instead
and works with bounds: a range with several groups may be cut nowhere inside (too pessimistic) or anywhere inside (too
optimistic). The two searches leave few ranges in which a cut can lie; only those are split further, until they are
single groups. Then both searches agree and the capacity is the exact optimum.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import nlargest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import materialize

SHARDS = 24
FIRST_BITS = 14
MAX_RANGES = 200_000
ROW_BYTES = 8
SLOT_ROWS = 50_000
#: The order of groups: the hash with its sign bit turned, as an unsigned number.
BIAS = 1 << 63


class Ranges:
    """Consecutive hash ranges (low, bits, size, groups, largest group) in order."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]) -> None:
        self.rows = sorted(rows)
        self.ends = [0]
        for r in self.rows:
            self.ends.append(self.ends[-1] + r[2])

    @property
    def total(self) -> int:
        return self.ends[-1]

    def cuts(self, capacity: int, optimistic: bool, shards: int) -> list[int] | None:
        """Where a greedy pass ends each shard, as sizes from the start; None if it needs more shards."""
        out, at = [], 0
        while at < self.total:
            if len(out) == shards:
                return None
            goal = at + capacity
            i = bisect_right(self.ends, goal) - 1  # ranges before i fit whole
            if optimistic and i < len(self.rows) and self.rows[i][3] > 1:
                at = goal
            elif self.ends[i] <= at:
                return None
            else:
                at = self.ends[i]
            out.append(min(at, self.total))
        return out

    def smallest(self, optimistic: bool, shards: int) -> int:
        """The smallest capacity that suffices, by binary search."""
        low, high = max([-(-self.total // shards), *(r[4] if optimistic else r[2] for r in self.rows), 1]), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, optimistic, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def even(self, capacity: int, shards: int) -> list[int]:
        """First ranges of the shards after the first: sizes near equal, none over ``capacity``, which must suffice.

        No shard stays empty if there are as many ranges. A shard's goal is an equal part of what is left, where ranges larger than
        that count as shards of their own; it closes at the end of a range next to the goal from which the rest can be placed.
        """
        n, least = len(self.rows), [len(self.rows)]
        for _ in range(shards - 1):  # from behind: the first range at which so many shards suffice for the rest
            least.append(bisect_left(self.ends, self.ends[least[-1]] - capacity))
        out, i = [], 0
        for left in range(shards, 1, -1):
            if i == n:
                break
            size, k = self.total - self.ends[i], left
            for big in nlargest(left - 1, (r[2] for r in self.rows[i:])):
                if big * k <= size:
                    break
                size, k = size - big, k - 1
            goal = self.ends[i] + size / k
            j = bisect_right(self.ends, goal) - 1
            if j < n and self.ends[j + 1] - goal < goal - self.ends[j]:
                j += 1
            most = min(bisect_right(self.ends, self.ends[i] + capacity) - 1, max(i + 1, n - left + 1))
            i = min(max(j, i + 1, least[left - 1]), most)
            out.append(i)
        return [i for i in out if i < n]

    def open(self, shards: int) -> list[tuple[int, int]]:
        """Runs (first, last) of ranges, one per cut at most, in which a cut of the optimum may lie inside a range of several groups."""
        least, enough = self.smallest(True, shards), self.smallest(False, shards)
        low, high = self.cuts_all(least, False, shards), self.cuts_all(enough, True, shards)
        runs: list[list[int]] = []
        for a, b in zip(low, high, strict=True):
            i, j = max(0, bisect_right(self.ends, a) - 2), min(len(self.rows) - 1, bisect_right(self.ends, b))
            if runs and i <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], j)
            elif i <= j:
                runs.append([i, j])
        return [(i, j) for i, j in runs if any(r[3] > 1 for r in self.rows[i : j + 1])]

    def cuts_all(self, capacity: int, optimistic: bool, shards: int) -> list[int]:
        """Bounds on each of ``shards`` cuts; a pessimistic pass that is stuck stays where it is."""
        out, at = [], 0
        for _ in range(shards):
            goal = min(at + capacity, self.total)
            i = bisect_right(self.ends, goal) - 1
            at = goal if optimistic and i < len(self.rows) and self.rows[i][3] > 1 else max(at, self.ends[min(i, len(self.rows))])
            out.append(at)
        return out


def _sums(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
    """Sums of ``groups`` (h, size) by ranges of 2**bits hashes."""
    found = groups.groupBy(F.shiftright("h", bits).alias("k")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).collect()
    return [((r["k"] << bits) + BIAS, bits, r["size"], r["n"], r["most"]) for r in found]


def find_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], int]:
    """(first hash of the shards after the first, capacity) for ``groups`` (h, size), one row per group."""
    bits = 64 - FIRST_BITS
    ranges = Ranges(_sums(groups, bits))
    while todo := ranges.open(shards):
        chosen = [r for i, j in todo for r in ranges.rows[i : j + 1]]
        n = sum(r[3] for r in chosen)
        finer = max(1, (MAX_RANGES // len(chosen)).bit_length() - 1)
        step = 0 if n <= MAX_RANGES else max(0, min(r[1] for r in chosen if r[3] > 1) - finer)
        inside: Column = F.lit(False)
        for i, j in todo:  # one run per shard at most
            first, last = ranges.rows[i], ranges.rows[j]
            inside = inside | F.col("h").between(first[0] - BIAS, last[0] + (1 << last[1]) - 1 - BIAS)
        gone = {r[0] for r in chosen}
        ranges = Ranges([r for r in ranges.rows if r[0] not in gone] + _sums(groups.where(inside), step))
    capacity = ranges.smallest(False, shards)
    return [ranges.rows[i][0] - BIAS for i in ranges.even(capacity, shards)], capacity


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard. Law ``bytes``: sizes near equal.

    Size is the UTF-8 bytes of the text (null: none) plus 8. Equal texts go to one shard, so no shard is larger than the
    optimum for whole groups in hash order; below that, sizes differ from equal parts by about a group or one of 2**FIRST_BITS hash
    ranges, and groups larger than an equal part have what is left of the others spread over the other shards. Slots count from 0 in each shard without gaps; rows that agree in id and text get
    neighbouring slots in any order. Slots depend on the table alone, not on partitions or settings. Null ids come first in a bin. Null and empty texts are one group. An empty table gives no rows.
    Two texts with one 64-bit hash count as one group, which keeps every promise above. Other columns aren't read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(F.encode(text, "UTF-8")) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h")
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    starts, _ = find_cuts(groups, shards)
    shard = sum(((F.col("h") >= s).cast("int") for s in starts), F.lit(0))
    # Slots: a bin of a shard holds about SLOT_ROWS rows, however many bins that makes; bins are counted first, so no task ranks a whole shard.
    bins = rows.count() // (shards * SLOT_ROWS) + 1
    placed = rows.withColumn("shard", shard).withColumn("bin", F.pmod(F.xxhash64("doc_id", "h"), F.lit(bins)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bin").count().select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bin").orderBy("doc_id", "h")
    return (
        placed.withColumn("rank", F.row_number().over(own))
        .join(offsets, ["shard", "bin"])  # a row per bin; the other side is dealt by bins already
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
