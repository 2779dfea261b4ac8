"""MinHash near-dedup with tensored banding.

Sketches. Each set of shingles has two collections of SIDE sketches, a sketch being the hash of ROWS minhashes. The keys of its
SIDE * SIDE tables are all pairs of a sketch of the first and one of the second collection, so tables of 2 * ROWS minhashes cost
2 * SIDE * ROWS minhashes instead of 2 * ROWS * SIDE^2. Two sets of similarity s share a table unless they agree in no sketch of a
collection: 2 (1 - s^ROWS)^SIDE, 2e-9 at 0.85, less above.

Tables. A sketch that one set alone has makes no key. First each set is compared with one other of its bucket in the tables of
equal numbers (the diagonal), which connects most groups of near copies. Keys of the whole tensor are then made of sketches that
sets of different components share, and only such sets are compared further: buckets of two directly, larger ones as tiles
(``ngram_join.tile_tasks``), pairs within a component never. So all pairs that share a table and aren't connected otherwise are
compared, while a large group of near copies is compared with few of its members.

Links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import lean, maybe_in, slices, small_batches
from palimpsest.llm.components import connected_components
from palimpsest.llm.ngram_join import PLAIN_KEY, SEEN_SETS, TILE_SHINGLES, Maps, U, bitmap, bitmap_bits, classes_of, forest, mix, overlap, salted, shingle_sets, stars, tile_tasks, tiled, with_components
from palimpsest.storage import materialize, release

ROWS, SIDE = 4, 28
#: The lowest bits of a sketch are its number: below SIDE in the first collection, from SIDE on in the second.
NUMBER = 63


@lru_cache(maxsize=4)
def factors(key: int) -> np.ndarray:
    """Odd numbers by which hashes are multiplied; the least product is a minhash."""
    return np.array([salted(key, 1000 + i) | U(1) for i in range(2 * SIDE * ROWS)], U)


def sketches(sets: list[np.ndarray], key: int = PLAIN_KEY) -> np.ndarray:
    """A row of 2 * SIDE sketches for each of the sets, none of which is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    factor = factors(key)
    out = np.empty((len(sets), 2 * SIDE), U)
    product = np.empty_like(flat)
    for k in range(2 * SIDE):
        h = np.full(len(sets), salted(key, 500 + k), U)
        for r in range(k * ROWS, (k + 1) * ROWS):
            np.multiply(flat, factor[r], out=product)
            h = mix(h ^ np.minimum.reduceat(product, starts))
        out[:, k] = (h & ~U(NUMBER)) | U(k)
    return out


def set_key(s: np.ndarray) -> bytes | None:
    """A 128-bit BLAKE2b of a set; None for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _profile(n_words: int, key: int):
    """(doc_id, doc_key, digest, text) to those without text and (n_shingles, weight, node, cls, sketches).

    Sketches are there once per task for sets seen before (a bounded memory of keys), cls is null for an empty set.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                sets = shingle_sets(data, offsets, n_words, key)
                keys = list(map(set_key, sets))
                new = []
                for i, k in enumerate(keys):
                    if k is not None and k not in seen:
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen.add(k)
                        new.append(i)
                flat = sketches([sets[i] for i in new], key).ravel().view(np.int64) if new else np.zeros(0, np.int64)
                fresh = np.zeros(b - a, np.int64)
                fresh[new] = 2 * SIDE
                ends = np.concatenate([[0], np.cumsum(fresh)])
                size = np.array([len(s) for s in sets], np.int64)
                columns = [
                    pa.array(size), pa.array(np.maximum(size, np.diff(offsets) >> 3)), pa.array([int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys], pa.int64()),
                    pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[a:b] for c in ("doc_id", "doc_key", "digest")], *columns], names=["doc_id", "doc_key", "digest", "n_shingles", "weight", "node", "cls", "sketches"])

    return run


PROFILE = "doc_key long, digest long, n_shingles long, weight long, node long, cls binary, sketches array<long>"


def _sets_of(n_words: int, key: int):
    """Rows (text, cls, node, root) to (cls, node, root, set), of texts that really have that set; repeated rows once a task as far as they follow each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                sets, wanted, at = shingle_sets(data, offsets, n_words, key), batch.column("cls")[a:b].to_pylist(), []
                for i, (s, cls) in enumerate(zip(sets, wanted, strict=True)):
                    if cls != last and set_key(s) == cls:
                        at.append(i)
                        last = cls
                ends = np.concatenate([[0], np.cumsum([len(sets[i]) for i in at], dtype=np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, U), *(sets[i] for i in at)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[a:b].take(pa.array(at, pa.int64())) for c in ("cls", "node", "root")], lists], names=["cls", "node", "root", "set"])

    return run


def _tiles(num: int, den: int):
    """Rows (task, side, cls, root, set) to links of sets of different roots."""

    def join(rows: list[tuple]) -> list[tuple]:
        held = sorted({r[1]: r for r in rows}.values(), key=lambda r: len(r[3]))
        sets = [r[3].view(U) for r in held]
        first: dict[int, int] = {}
        label = np.array([first.setdefault(r[2], i) for i, r in enumerate(held)])

        def linked(j: int, i: int) -> bool:
            common = overlap(sets[i], sets[j])
            return den * common >= num * (len(sets[i]) + len(sets[j]) - common)

        maps = Maps([bitmap(s, bitmap_bits(len(s))) for s in sets])
        return stars([r[1] for r in held], forest(np.array(list(map(len, sets)), np.int64), maps, [r[0] for r in held], num, den, linked, label))

    return tiled(("task", "side", "cls", "root", "set"), pa.binary(), join)


def table_keys(rows: DataFrame, diagonal: bool) -> DataFrame:
    """(key, node, root) of the tables that sets take part in, from their sketches ``a``: all pairs of both collections, or those of equal numbers."""
    number = lambda s: s.bitwiseAND(F.lit(NUMBER))
    one = rows.select("node", "root", "a", F.explode(F.filter("a", lambda s: number(s) < SIDE)).alias("x"))
    fits = (lambda s: number(s) == number(F.col("x")) + SIDE) if diagonal else (lambda s: number(s) >= SIDE)
    return one.select("node", "root", "x", F.explode(F.filter("a", fits)).alias("y")).select(F.xxhash64("x", "y").alias("key"), "node", "root")


def shared_sketches(rows: DataFrame, name: str) -> DataFrame:
    """Of ``rows`` (node, root, a: sketches) those with sketches that another root has too, in ``a`` only such. Nodes may occur repeatedly."""
    flat = rows.select("node", "root", F.explode("a").alias("sketch"))
    several = materialize(flat.groupBy("sketch").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sketch"), name)
    both = lambda low: F.exists("a", lambda s: (s.bitwiseAND(F.lit(NUMBER)) < SIDE) if low else (s.bitwiseAND(F.lit(NUMBER)) >= SIDE))
    out = materialize(flat.join(several, "sketch").groupBy("node", "root").agg(F.collect_set("sketch").alias("a")).where(both(True) & both(False)), name)
    release(several)
    return out


def _buckets(keys: DataFrame, name: str) -> DataFrame:
    """(key, node, root, rep, n, low): the members of buckets with several roots, with the bucket's least node, its number of nodes and least root."""
    found = keys.groupBy("key").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return keys.join(materialize(found.drop("high"), name), "key")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the classes of ``pairs`` (node, rep) whose sets link."""
    one = sets.select("node", F.col("cls").alias("a"), F.col("set").alias("s"))
    two = sets.select(F.col("node").alias("rep"), F.col("cls").alias("b"), F.col("set").alias("t"))
    both = pairs.join(one, "node").join(two, "rep").where(F.least(F.size("s"), F.size("t")) * den >= F.greatest(F.size("s"), F.size("t")) * num)
    common = F.size(F.array_intersect("s", "t")).cast("long")
    return both.where(common * den >= (F.size("s") + F.size("t") - common) * num).select("a", "b")


def minhash_dedup(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10, tile: int = TILE_SHINGLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Sets of distinct ``n_words``-word shingles link when den * intersection >= num * union, as far as they share a table (module docstring: all
    but 2e-9 of pairs at a similarity of 0.85, 8e-7 at 0.8). component_id is the smallest id that links reach, itself included; kept
    says whether it is the row's own. Words are runs of non-blank characters with A-Z in lower case; a text of fewer words is one
    shingle; one without words, or null, is an empty set that links with nothing.

    Null ids take part in links but name no component; a component of null ids only has a null id and keeps its rows. Repeated rows are
    equal sets and share a fate, so rows that repeat the smallest id all stay. Very long texts are taken whole; one text has to fit into
    a task. An empty table gives no rows. Other columns aren't read. Shingles are told by 64-bit hashes, sets by 128-bit ones, under a
    key drawn for each call. ``tile`` bounds a task's shingles and changes no result.
    """
    small_batches(docs.sparkSession)
    secret = secrets.randbits(63)
    doc_key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    docs = docs.select("doc_id", doc_key.alias("doc_key"), F.xxhash64("text").alias("digest"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = materialize(docs.mapInArrow(lean(_profile(n_words, secret)), f"doc_id {kind}, {PROFILE}"), "minhash-profile")
    rows = full.drop("sketches")
    classes = classes_of(rows)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets(nodes: DataFrame) -> DataFrame:
        """(cls, node, root, set) of ``nodes`` (node, root)."""
        wanted = materialize(classes.join(nodes, "node").select("cls", "node", "root", "one.*"), "minhash-wanted")
        # The bitmap keeps most texts from being moved, the join drops the rest.
        texts = docs.where(maybe_in(wanted, "doc_key")).join(wanted.hint("merge"), ["doc_key", "digest"]).select("text", "cls", "node", "root")
        return materialize(texts.mapInArrow(lean(_sets_of(n_words, secret)), "cls binary, node long, root long, set array<long>"), "minhash-sets")

    # The diagonal: each set with the least of its buckets.
    near = shared_sketches(full.where("size(sketches) > 0").select("node", F.col("node").alias("root"), F.col("sketches").alias("a")), "minhash-near")
    first = _buckets(table_keys(near, True), "minhash-buckets").where("node <> rep").groupBy("node").agg(F.min("rep").alias("rep"))
    first = materialize(first, "minhash-first")
    ends = materialize(first.select(F.explode(F.array("node", "rep")).alias("node")).distinct().withColumn("root", F.col("node")), "minhash-ends")
    links = materialize(_confirmed(first, sets(ends), num, den), "minhash-links")
    # Each set has one link here at most. What it leads to, or what that leads to, tells most connected sets; no more is needed of a root.
    onward = links.select(F.col("a").alias("b"), F.col("b").alias("c"))
    roots = materialize(links.join(onward, "b", "left").select(F.col("a").alias("cls"), F.coalesce("c", "b").alias("of")), "minhash-roots")

    # The tensor: sets that share a table and have different roots by now.
    known = near.drop("root").join(classes.select("cls", "node"), "node").join(roots, "cls", "left").select("node", F.xxhash64(F.coalesce("of", "cls")).alias("root"), "a")
    left = shared_sketches(known, "minhash-left")
    members = materialize(_buckets(table_keys(left, False), "minhash-buckets").groupBy("node", "root", F.when(F.col("n") == 2, F.col("rep")).alias("rep"), F.when(F.col("n") > 2, F.col("low")).alias("low")).count(), "minhash-members")
    pairs = members.where("rep is not null and node <> rep").select("node", "rep").distinct()
    groups = connected_components(members.where("low is not null").select(F.col("root").alias("a"), F.col("low").alias("b")), "minhash-groups").select(F.col("node").alias("root"), F.col("root").alias("comp"))
    several = members.where("low is not null").select("node", "root").distinct().join(groups, "root").select("node", "comp")
    open_sets = sets(members.select("node", "root").distinct())
    found = _confirmed(pairs, open_sets, num, den)
    tasks = tile_tasks(classes.join(several, "node").select("cls", "comp", "n_shingles", "one.*"), num, den, tile).select("cls", "tasks")
    dealt = open_sets.join(tasks, "cls").select(F.inline("tasks"), "cls", "root", "set").repartition(n, "task").sortWithinPartitions("task")
    more = dealt.mapInArrow(lean(_tiles(num, den)), "a binary, b binary")
    out = with_components(rows, classes, links.unionByName(found).unionByName(more)).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
