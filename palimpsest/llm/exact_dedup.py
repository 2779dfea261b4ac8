"""Exact deduplication over a cuckoo-filter index of live digests.

Every text gets a SHA-256 digest in the JVM. A :class:`CuckooIndex` is a filter of
short fingerprints in front of buckets of full keys: a filter miss proves a digest
new; a hit is verified against the bucket's stored keys; a full filter is rebuilt
at twice the size from the stored keys. The index works twice. Where rows are read,
each task merges its own rows of a digest, so a text that a third of all rows
share leaves a task as one row. Then digests are dealt by slices to tasks that
bring the index of a slice up to date: stored digests go in, deleted ones out,
new ones in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import lean, small_batches, spread_join
from palimpsest.storage import materialize

SLOTS = 4
MAX_KICKS = 200
FLUSH_KEYS = 500_000


class CuckooFilter:
    """Partial-key cuckoo filter: buckets of four 16-bit fingerprints, two homes per key; insert, contains, delete."""

    def __init__(self, capacity: int = 1024) -> None:
        buckets = 1
        while buckets * SLOTS * 0.9 < capacity:
            buckets *= 2
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.size = 0

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[:2], "little") or 1  # tasks and slices are dealt by other bytes
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def contains(self, digest: bytes) -> bool:
        p, a, b = self._homes(digest)
        return p in self.table[a] or p in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False if the filter is too full; the caller then rebuilds it larger (nothing is lost: keys are stored outside)."""
        p, a, b = self._homes(digest)
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(p)
                self.size += 1
                return True
        at = a
        for kick in range(MAX_KICKS):
            row = self.table[at]
            row[kick % SLOTS], p = p, row[kick % SLOTS]
            at = self._other(at, p)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(p)
                self.size += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Remove one copy of a digest's fingerprint. Only digests that are in the index may be deleted."""
        p, a, b = self._homes(digest)
        for at in (a, b):
            if p in self.table[at]:
                self.table[at].remove(p)
                self.size -= 1
                return True
        return False


class CuckooIndex:
    """Live digests with their values: the filter answers most misses, the stored keys answer hits for certain."""

    def __init__(self, capacity: int = 1024) -> None:
        self.filter = CuckooFilter(capacity)
        self.store: dict[bytes, dict[bytes, list]] = {}  # buckets of full keys by two bytes
        self.count = 0
        self.false_hits = 0
        self.resizes = 0

    @staticmethod
    def _bucket(key: bytes) -> bytes:
        return key[10:12]

    def get(self, key: bytes) -> list | None:
        if not self.filter.contains(key):
            return None
        value = self.store.get(self._bucket(key), {}).get(key)
        self.false_hits += value is None
        return value

    def insert(self, key: bytes, value: list) -> None:
        self.store.setdefault(self._bucket(key), {})[key] = value
        self.count += 1
        if not self.filter.insert(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Forget a live digest; a later row with it counts as new."""
        bucket = self.store.get(self._bucket(key), {})
        if key not in bucket:
            return False
        del bucket[key]
        if not bucket:
            del self.store[self._bucket(key)]
        self.filter.delete(key)
        self.count -= 1
        return True

    def _resize(self) -> None:
        capacity = self.count
        while True:
            capacity *= 2
            self.resizes += 1
            self.filter = CuckooFilter(capacity)
            if all(self.filter.insert(k) for k, _ in self.items()):
                return

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.store.values():
            yield from bucket.items()


def _merge(index: CuckooIndex, key: bytes, rows: int, largest: int | None) -> None:
    value = index.get(key)
    if value is None:
        index.insert(key, [rows, largest])
        return
    value[0] += rows
    if value[1] is None or (largest is not None and largest > value[1]):
        value[1] = largest


def _contents(index: CuckooIndex, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    found = list(index.items())
    for i in range(0, len(found), 50_000):
        part = found[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], names=list(names))


def _own_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, doc_id) of a task to (digest, rows, largest), a digest once for each FLUSH_KEYS distinct ones at most."""
    index = CuckooIndex()
    for batch in batches:
        for digest, doc_id in zip(batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            _merge(index, digest, 1, doc_id)
        if index.count >= FLUSH_KEYS:
            yield from _contents(index, ("digest", "rows", "largest"))
            index = CuckooIndex()
    yield from _contents(index, ("digest", "rows", "largest"))


STORED, DELETED, NEW = range(3)


def _slice_indexes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, step, digest, rows, largest), sorted by slice and step, to the digests that live in the end.

    A slice is complete once the next begins, so memory is one slice.
    """
    index, now = CuckooIndex(), None
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("slice", "step", "digest", "rows", "largest"))
        for part, step, digest, rows, largest in zip(*columns, strict=True):
            if part != now:
                yield from _contents(index, ("digest", "group_size", "keep_id"))
                index, now = CuckooIndex(), part
            if step == DELETED:
                index.delete(digest)
            else:
                _merge(index, digest, rows, largest)
    yield from _contents(index, ("digest", "group_size", "keep_id"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_sha256): the SHA-256 of each text in lower-case hex; null counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))


def live_index(rows: DataFrame, stored: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """(text_sha256, group_size, keep_id): one row per live digest after the index ``stored`` (of the same columns) lost the digests of
    ``deletes`` (text_sha256) and got ``rows`` (doc_id, text_sha256). Null digests are ignored.

    keep_id is the largest id of a digest, null if all are null; each row counts in group_size, repeated ones too. Deleting a digest that
    isn't stored, or one twice, does no more. Empty tables do nothing: of none but empty ones there are no rows. Other columns aren't read.

    Slices hold about half of FLUSH_KEYS digests; their number follows the number of rows, so a task's memory doesn't.
    """
    spark = rows.sparkSession
    small_batches(spark)
    hex_ = F.col("text_sha256")
    none = F.lit(None).cast("long")
    new = rows.where(hex_.isNotNull()).select(F.unhex(hex_).alias("digest"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(_own_rows), "digest binary, rows long, largest long")
    steps, n_rows = [new.withColumn("step", F.lit(NEW))], rows.count()
    if stored is not None:
        n_rows += stored.count()
        steps.append(stored.where(hex_.isNotNull()).select(F.unhex(hex_).alias("digest"), F.col("group_size").alias("rows"), F.col("keep_id").cast("long").alias("largest"), F.lit(STORED).alias("step")))
    if deletes is not None:
        steps.append(deletes.where(hex_.isNotNull()).select(F.unhex(hex_).alias("digest"), none.alias("rows"), none.alias("largest"), F.lit(DELETED).alias("step")).distinct())
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    n_slices = max(1, -(-2 * n_rows // FLUSH_KEYS))
    number = lambda first: F.conv(F.substring(F.hex("digest"), first, 12), 16, 10).cast("long")
    spread = max(n_slices, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # fewer slices than tasks are cut further, by other bytes than slices and fingerprints come from
    every = every.withColumn("slice", F.pmod(number(53), F.lit(n_slices)) * spread + (F.pmod(number(41), F.lit(-(-spread // n_slices))) if n_slices < spread else F.lit(0)))
    live = every.repartition(spread, "slice").sortWithinPartitions("slice", "step").mapInArrow(lean(_slice_indexes), "digest binary, group_size long, keep_id long")
    return live.select(F.lower(F.hex("digest")).alias("text_sha256"), "group_size", "keep_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays.
    Nulls: a null id is below every id; a group with only null ids keeps them all, with a null keep_id.
    Repeated rows: rows with the same id and text are all kept if that id is the largest; each counts in group_size. Very long texts
    are digested whole. Empty table: no rows. Other columns of ``docs`` are not read, so their names can't clash.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    groups = materialize(live_index(rows).withColumn("rows", F.col("group_size")), "digest-index")
    return spread_join(rows, groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def apply_changes(index: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
    """A stored index (text_sha256, group_size, keep_id) after rows (doc_id, text_sha256) come and digests (text_sha256) go.

    Deleted digests leave first, so a digest that is in both tables starts anew; one that isn't live is no error. Null digests are ignored.
    """
    if inserts is None:
        inserts = index.select(F.lit(None).cast("long").alias("doc_id"), "text_sha256").limit(0)
    return live_index(inserts.select("doc_id", "text_sha256"), index, deletes)
