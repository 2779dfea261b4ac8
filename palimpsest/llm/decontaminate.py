"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become byte strings of words between single spaces. The patterns are all
windows of benchmark words in the same form, with a space at either end, so an
occurrence of the bytes is an occurrence of the words. Patterns are grouped by
length; each group has a shift table over blocks of up to eight bytes (how far
no pattern can end), buckets of patterns by the hash of the block their first
``m`` bytes end in, and direct comparison of what a bucket offers. The scan runs
in numpy: a slice of text is cut into lanes that jump forward together.

The benchmark is broadcast in parts of at most MAX_PART_BYTES of text, so its size
never bounds what can be searched, nor what a task holds. Each part is a pass over
the documents. With several, a pass writes what it found, by the digest of the text,
and no texts: what is found is put together once, after the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.blocks import free_names, lean, maybe_in, slices, small_batches
from palimpsest.storage import materialize, release

WINDOW = 10
MAX_PART_BYTES = 8 << 20
TABLE_BITS = 18
LANE = 1024
SPACE, EDGE = 32, 1


def _byte_map() -> np.ndarray:
    """A-Z to lower case, other ASCII that belongs to no word to a space; everything else stays."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    out[~word] = SPACE
    return out


BYTE_MAP = _byte_map()


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of one text."""
    return (text or "").encode().translate(BYTE_MAP.tobytes()).split()


def spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All texts of a slice as one array: EDGE, a space, then each word with a space after it."""
    n = len(offsets) - 1
    out = np.full(len(data) + 3 * n, SPACE, np.uint8)
    out[offsets[:-1] + 3 * np.arange(n)] = EDGE
    at = np.repeat(3 * np.arange(n) + 2, np.diff(offsets))
    at += np.arange(len(data))
    out[at] = BYTE_MAP[data]
    blank = out == SPACE
    blank[1:] &= blank[:-1].copy()
    blank[0] = False
    return out[~blank]


def _hash(block: np.ndarray) -> np.ndarray:
    return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one integer (unaligned view; eight zeros pad the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


class PatternGroup:
    """Patterns of like length with their Wu-Manber tables. All have at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes], block: int) -> None:
        self.patterns = patterns
        self.block = block
        self.m = min(map(len, patterns))
        self.mask = np.uint64((1 << (8 * block)) - 1)
        most = self.m - block
        self.shift = np.full(1 << TABLE_BITS, most + 1, np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        load = _loads(heads.reshape(-1))
        rows = np.arange(len(patterns)) * self.m
        for j in range(most + 1):
            np.minimum.at(self.shift, _hash(load[rows + j] & self.mask), most - j)
        suffix = _hash(load[rows + most] & self.mask)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        k = min(8, self.m)
        self.edge_mask = np.uint64((1 << (8 * k)) - 1)
        self.first = np.array([int.from_bytes(p[:k], "little") for p in patterns], np.uint64)
        self.final = np.array([int.from_bytes(p[-k:], "little") for p in patterns], np.uint64)
        self.edge = k

    def candidates(self, load: np.ndarray, n: int) -> np.ndarray:
        """Starts whose first m bytes end in some pattern's block; the shift table skips the rest."""
        last = n - self.m
        if last < 0:
            return np.zeros(0, np.int64)
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        found = []
        ahead = self.m - self.block
        while len(at):
            step = self.shift[_hash(load[at + ahead] & self.mask)]
            if len(hit := at[step == 0]):
                found.append(hit)
            at = at + np.maximum(step, 1)
            if not (go := at < stop).all():
                at, stop = at[go], stop[go]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, data: np.ndarray, load: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        at = self.candidates(load, len(data))
        suffix = _hash(load[at + self.m - self.block] & self.mask)
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        out: list[tuple[int, int]] = []
        size, start = high - low, 0
        ends = np.cumsum(size)
        while start < len(at):  # a bounded number of pairs at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 1_000_000, "right")))
            part = slice(start, stop)
            s = np.repeat(at[part], size[part])
            base = np.repeat(low[part] - (ends[part] - size[part]), size[part])
            which = self.order[base + np.arange(len(s)) + (ends[start - 1] if start else 0)]
            length = self.lengths[which]
            ok = s + length <= len(data)
            s, which, length = s[ok], which[ok], length[ok]
            ok = ((load[s] & self.edge_mask) == self.first[which]) & ((load[s + length - self.edge] & self.edge_mask) == self.final[which])
            out += [(a, p) for a, p in zip(s[ok].tolist(), which[ok].tolist(), strict=True) if raw.startswith(self.patterns[p], a)]
            start = stop
        return out


class Searcher:
    """Windows of benchmark items: pattern tables, words of each pattern, and the items it belongs to."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                for i in range(max(1, len(words) - window + 1)):
                    owners.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).update([] if item is None else [str(item)])
        self.groups = []
        for low, high, block in ((0, 8, 2), (8, 24, 4), (24, 1 << 60, 8)):
            if part := sorted(p for p in owners if low <= len(p) < high):
                group = PatternGroup(part, block)
                words = np.array([p.count(b" ") - 1 for p in part], np.int64)
                self.groups.append((group, words, [tuple(sorted(owners[p])) for p in part]))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Of a slice's texts: words of each, hit marks of all words, first word of each, items of each."""
        text = spaced(data, offsets)
        spaces = np.flatnonzero(text == SPACE)
        edges = np.flatnonzero(text == EDGE)
        first = np.searchsorted(spaces, edges)  # each text's first space; a text has one space more than words
        counts = np.diff(np.append(first, len(spaces))) - 1
        change = np.zeros(len(spaces) + 1, np.int32)
        items: list[set[str]] = [set() for _ in edges]
        load, raw = _loads(text), text.tobytes()
        for group, words, owners in self.groups:
            if found := group.search(text, load, raw):
                at = np.array([f[0] for f in found])
                which = np.array([f[1] for f in found])
                word = np.searchsorted(spaces, at)
                np.add.at(change, word, 1)
                np.add.at(change, word + words[which], -1)
                doc = np.searchsorted(edges, at, "right") - 1
                for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                    items[d].update(owners[p])
        return counts, np.cumsum(change[:-1]) > 0, first, items


#: The searcher that a worker process used last, by the name of its part of the benchmark.
_LAST: dict[str, Searcher] = {}


def _searcher(name: str, part: list[tuple], window: int) -> Searcher:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Searcher(part, window)
    return _LAST[name]


def _scan_batches(name: str, part_var, window: int, text_col: str, carry: list[str], hits_only: bool, out_schema: pa.Schema):
    """Carries ``carry`` through and adds words (count), hits (numbers of hit words) and items; of rows without hits or items none, if ``hits_only``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(name, part_var.value, window)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(text_col)):
                counts, hit, first, items = searcher.scan(data, offsets)
                at = np.flatnonzero(hit)
                ends = np.searchsorted(at, np.append(first, len(hit)))
                words = at - np.repeat(first, np.diff(ends))
                # A text has one space more than words, which is never hit.
                hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.int32()))
                columns = [*(batch.column(c)[a:b] for c in carry), pa.array(counts, pa.int64()), hits, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)
                yield out.filter(pa.array(np.diff(ends) > 0)) if hits_only else out

    return run


def _parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in runs of at most ``limit`` bytes of text (a longer item comes alone), one in memory at a time."""
    part, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        n = len((row[1] or "").encode())
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    yield part


def _pass(docs: DataFrame, part_var, carry: list[str], window: int, own: tuple[str, str, str] | list[str] = ("words", "hits", "items"), hits_only: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` (text, ...) with three more, ``own``: words, hits and items (``_scan_batches``)."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(own[0], T.LongType()), T.StructField(own[1], T.ArrayType(T.IntegerType())), T.StructField(own[2], T.ArrayType(T.StringType()))])
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    return docs.mapInArrow(lean(_scan_batches(uuid.uuid4().hex, part_var, window, "text", carry, hits_only, out)), schema)


def _digest(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)


def found_in_parts(docs: DataFrame, benchmark: DataFrame, window: int, part_bytes: int, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame | None, Broadcast | None]:
    """What occurs in the texts of ``docs``, if the benchmark has several parts: (digest, hits, items), one row for each different text with hits.

    A benchmark of one part is broadcast instead, for a pass that need not write anything.
    """
    spark = docs.sparkSession
    keyed = docs.select(_digest(docs).alias("digest"), "text")
    parts = _parts(benchmark, item_id, item_text, part_bytes)
    part, passes = next(parts), []
    while True:
        var, more = spark.sparkContext.broadcast(part), next(parts, None)
        if more is None and not passes:
            return None, var
        passes.append(materialize(_pass(keyed, var, ["digest"], window, hits_only=True).drop("words"), "benchmark-pass"))
        var.destroy()
        if more is None:
            break
        part = more
    rows = passes[0]
    for other in passes[1:]:
        rows = rows.unionByName(other)
    # Copies of a text have equal rows, which a set has once.
    one = rows.groupBy("digest").agg(F.collect_set(F.struct("hits", "items")).alias("x"))
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda x: x[c])))).alias(c)
    found = materialize(one.select("digest", all_of("hits"), all_of("items")), "benchmark-found")
    release(*passes)
    return found, None


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words; a null or wordless item has no window; an item shorter than ``window`` is one window. An item
    with a null id hits words but isn't counted or named. Rows that repeat, in either table, change nothing but that each document row
    gets a row. A very long text is searched whole, in one piece, in one task. With no benchmark rows nothing is hit. Other columns of
    either table aren't read. ``part_bytes`` bounds the benchmark text of a pass and changes no result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found, var = found_in_parts(docs, benchmark, window, part_bytes)
    if found is None:
        rows = _pass(docs, var, ["doc_id"], window)
    else:
        nothing = docs.sparkSession.sparkContext.broadcast([])
        counted = _pass(docs.withColumn("digest", _digest(docs)), nothing, ["doc_id", "digest"], window)
        rows = counted.select("doc_id", "digest", "words").join(found, "digest", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    return rows.select("doc_id", F.col("words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark window occurs, with all their columns, under any names.

    Nulls, empty and very long texts, repeated rows and empty tables are as in :func:`contamination`: a text without words stays.
    With a benchmark of several parts, a bitmap of the texts with hits keeps most other rows where they are.
    """
    small_batches(docs.sparkSession)
    found, var = found_in_parts(docs, benchmark, window, part_bytes)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if found is None:
        own = free_names(docs.columns, "words", "hits", "items")
        return _pass(docs, var, docs.columns, window, own).where(F.size(own[1]) == 0).select(*names)
    (digest,) = free_names(docs.columns, "digest")
    keyed, hit = docs.withColumn(digest, _digest(docs)), found.select(F.col("digest").alias(digest))
    maybe = maybe_in(hit, digest)
    return keyed.where(~maybe).unionByName(keyed.where(maybe).join(hit, digest, "left_anti").select(keyed.columns)).select(*names)
