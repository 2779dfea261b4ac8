"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Which documents are compared. For a similarity of at least t, two sets of sizes x <= y differ in at most x (1 - t) / t
elements. Hash ranges cut every set of a size band into more parts than that, so two linked sets agree in some whole parts,
enough of them that neither empty parts nor very common ones are needed. Documents with a part in common whose bitmaps don't
rule a link out are joined to candidate groups. No link between different sets can be lost, however common a passage or word is.

How they are compared. A candidate group is cut into tiles by size band (and by hash where a band is large), and only
tiles of the same or neighbouring bands meet, so a task's memory is bounded and no group has to fit into one task. In a
tile each set has a bitmap of hashed elements; the bits in which two bitmaps differ bound the overlap from above. Pairs
that pass, and are not connected yet, are intersected exactly as sorted arrays, and what agrees by its hashes is compared
word by word before it counts as a link. Tasks return spanning forests.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import lean, maybe_in, slices, small_batches, spread_join
from palimpsest.llm.components import connected_components
from palimpsest.storage import materialize, release

U = np.uint64
BAND_RATIO = 1.5
#: Shingles (or eights of bytes) of a tile, sets of a block of bitmaps: what a task holds, whatever the group's size.
TILE_SHINGLES = 2_000_000
BLOCK_SETS = 4096
#: Sets known to a task as seen before: beyond that it forgets them and repeats their signatures.
SEEN_SETS = 500_000
#: A part of more sets than this is common; a set leaves out its common parts if it has enough others (``Bands``).
COMMON_SETS = 64
SLACK = 63
LONG_WORD = 64
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()
SHORT = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
PLAIN_KEY = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1000)
def salted(key: int, n: int) -> np.uint64:
    """The ``n``-th constant that belongs to a key."""
    return U(int.from_bytes(hashlib.blake2b(b"%d" % n, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little"))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (also from the end) as one number; what is behind the end is zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, load: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A hash of ``data[starts[i]:ends[i]]`` for each i: eight bytes after eight go through ``mix``; long runs through BLAKE2b."""
    length = ends - starts
    out = mix(length.astype(U) ^ salted(key, 0))
    short = np.flatnonzero(length <= LONG_WORD)
    at, left = starts[short], length[short]
    while len(short):
        out[short] = mix(out[short] ^ (load[at] & SHORT[np.minimum(left, 8)]))
        if not (more := left > 8).any():
            break
        short, at, left = short[more], at[more] + 8, left[more] - 8
    secret = key.to_bytes(8, "little")
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a slice's texts: runs of non-blank bytes of one text."""
    full = ~BLANK[data]
    opens, closes = full.copy(), full.copy()
    opens[1:] &= ~full[:-1]
    closes[:-1] &= ~full[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    opens[first] = full[first]
    closes[first[1:] - 1] = full[first[1:] - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, key: int = PLAIN_KEY) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of a slice, in order; words are runs of non-blank bytes, A-Z in lower case."""
    starts, ends = word_edges(data, offsets)
    lower = LOWER[data]
    return run_hashes(lower, loads(lower), starts, ends, key), np.searchsorted(offsets, starts, "right") - 1


def rolled_hashes(words: np.ndarray, n: int, key: int) -> np.ndarray:
    """A hash of each run of ``n`` words, from the words' hashes."""
    size = max(0, len(words) - n + 1)
    out = mix(words[:size] ^ salted(key, n))
    for j in range(1, n):
        out = mix(out ^ words[j : j + size])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int, key: int = PLAIN_KEY, places: bool = False) -> list:
    """For each text of a slice the sorted distinct hashes of its ``n_words``-word shingles; fewer words are one shingle.

    With ``places``, pairs of such an array and the number of the word at which each shingle first begins.
    """
    n = len(offsets) - 1
    words, doc = word_hashes(data, offsets, key)
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    rolled = rolled_hashes(words, n_words, key)
    out = []
    for f, c in zip(first.tolist(), counts.tolist(), strict=True):
        part = rolled[f : f + c - n_words + 1] if c >= n_words else rolled_hashes(words[f : f + c], c, key) if c else rolled[:0]
        out.append(np.unique(part, return_index=places) if places else np.unique(part))
    return out


def class_keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """For each text of a slice a 128-bit BLAKE2b of its lower-cased words between single spaces; None without words."""
    full = ~BLANK[data]
    keep = full.copy()
    keep[1:] |= full[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = full[first]
    plain = np.where(full, LOWER[data], np.uint8(32))[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
    out: list[bytes | None] = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        b -= b > a and plain[b - 1] == 32
        out.append(hashlib.blake2b(plain[a:b], digest_size=16).digest() if b > a else None)
    return out


class Bands:
    """Size bands and how many parts sets of a band are cut into, for a similarity of num / den.

    Two sets of sizes x <= y that link have y <= x den / num and differ in at most x (den - num) / num elements. A set takes
    part in its own band and in those of its smaller partners. Of a band's parts, ``need`` - 1 at most can differ between linked
    sets. So a set with f parts that aren't empty agrees in f - need + 1 of them at least with any partner, and may leave out
    f - need of its parts, as long as whether a part is left out by a set depends on the part alone: empty or common. A band has
    parts enough that f is below ``need`` for next to no set; such a set has signatures of its empty parts too, and leaves out none:
    a partner with more full parts knows nothing of empty ones, so it is the full ones, common or not, in which they can meet.
    """

    def __init__(self, num: int, den: int, ratio: float = BAND_RATIO) -> None:
        self.num, self.den = num, den
        self.least = -(-num // (den - num)) if den > num else 1 << 62  # smaller sets link with equal ones only
        self.starts = [self.least]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, "right")) - 1

    @lru_cache(maxsize=1000)  # noqa: B019  one object a task
    def parts(self, band: int) -> tuple[int, int]:
        """(parts, need) of a band: the smallest sets have ``need`` full parts even four standard deviations below the mean."""
        need = (self.starts[band + 1] - 1) * (self.den - self.num) // self.num + 1
        size, parts = self.starts[band], need + 1
        while parts < 4 * need:
            empty = parts * (1 - 1 / parts) ** size
            spread = max(0.0, empty + parts * (parts - 1) * (1 - 2 / parts) ** size - empty**2) ** 0.5
            if parts - empty - 4 * spread >= need:
                break
            parts += 1 + need // 50
        return parts, need

    @lru_cache(maxsize=100_000)  # noqa: B019
    def joined(self, size: int) -> tuple[tuple[int, int, int], ...]:
        """(band, parts, need) in which a set of this size takes part; one part of all sets of that size if only equal sets link."""
        if size < self.least:
            return ((-1 - size, 1, 1),)
        low = max(self.least, -(-self.num * size // self.den))
        return tuple((b, *self.parts(b)) for b in range(self.of(low), self.of(size) + 1))


def signatures(s: np.ndarray, bands: Bands, key: int = PLAIN_KEY) -> list[tuple[int, np.ndarray]]:
    """One set's (slack, signatures of its parts) for each band that it takes part in; it may leave out ``slack`` common ones.

    A set with too few full parts (``Bands``) has signatures of its empty ones too and leaves out none.
    """
    out = []
    top = s >> U(32)
    running = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ salted(key, 101)), dtype=U)])
    for band, parts, need in bands.joined(len(s)):
        part = (top * U(parts)) >> U(32)
        ends = np.searchsorted(part, np.arange(parts + 1, dtype=U))
        sums = running[ends[1:]] - running[ends[:-1]]
        sig = mix(sums + mix(np.arange(parts, dtype=U) + U(band * PLAIN_KEY % (1 << 64))))
        full = ends[1:] > ends[:-1]
        f = int(full.sum())
        out.append((min(SLACK, f - need), sig[full]) if f >= need else (0, sig))
    return out


def bitmap_bits(size: int) -> int:
    """Bits of a bitmap for sets of this size: twice as many, a power of two within bounds."""
    bits = 512
    while bits < 2 * size and bits < 1 << 15:
        bits *= 2
    return bits


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of which those are set that the elements hash to."""
    out = np.zeros(bits // 64, U)
    at = mix(s) & U(bits - 1)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def folded(one: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in ``words`` words: the halves of a wider one laid over each other."""
    return np.bitwise_or.reduce(one.reshape(-1, words), 0)


class Maps:
    """Bitmaps of sets in ascending order of size, one matrix for each width."""

    def __init__(self, maps: list[np.ndarray]) -> None:
        self.segments: list[tuple[int, int, np.ndarray]] = []
        a = 0
        for i in range(1, len(maps) + 1):
            if i == len(maps) or len(maps[i]) != len(maps[a]):
                self.segments.append((a, i, np.stack(maps[a:i])))
                a = i

    def apart(self, i: int, at: np.ndarray) -> np.ndarray:
        """For each of the sets ``at`` (ascending, none after ``i``) in how many bits its bitmap and that of set ``i`` differ, in the narrower one's width."""
        own = next(m[i - a] for a, b, m in self.segments if a <= i < b)
        out = []
        for a, b, m in self.segments:
            low, high = np.searchsorted(at, (a, b))
            if low < high:
                out.append(np.bitwise_count(m[at[low:high] - a] ^ folded(own, m.shape[1])).sum(1, dtype=np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def may_link(apart: np.ndarray, sizes: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
    """Whether sets whose bitmaps differ in ``apart`` bits may link: those bits are elements in which the sets differ."""
    both = sizes + size
    # overlap <= (both - apart) / 2, and a link needs den * overlap >= num * (both - overlap)
    return (den + num) * (both - apart) >= 2 * num * both


def _profile(n_words: int, num: int, den: int, key: int):
    """(doc_id, doc_key, digest, text) to those without text and (n_shingles, weight, node, cls, bits, bands); cls is null for an empty set.

    ``bands`` has a set's (slack, signatures), once per task for sets seen before (a bounded memory of keys).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                sets, keys = shingle_sets(data, offsets, n_words, key), class_keys(data, offsets)
                size = np.array([len(s) for s in sets], np.int64)
                rows: list[list[tuple[int, np.ndarray]]] = []
                for s, k in zip(sets, keys, strict=True):
                    if k is None or k in seen:
                        rows.append([])
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(k)
                    rows.append(signatures(s, bands, key))
                flat = [x for r in rows for x in r]
                sig = np.concatenate([np.zeros(0, U), *(x[1] for x in flat)]).view(np.int64)
                ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), pa.int32())
                inner = pa.ListArray.from_arrays(ends([len(x[1]) for x in flat]), pa.array(sig))
                pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), inner], names=["slack", "sigs"])
                columns = [
                    pa.array(size), pa.array(np.maximum(size, np.diff(offsets) >> 3)), pa.array([int.from_bytes(k[:8], "little", signed=True) & ~SLACK if k else None for k in keys], pa.int64()),
                    pa.array(keys, pa.binary()), pa.array([bitmap(s, bitmap_bits(len(s))).tobytes() if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(ends([len(r) for r in rows]), pairs),
                ]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[a:b] for c in ("doc_id", "doc_key", "digest")], *columns], names=["doc_id", "doc_key", "digest", "n_shingles", "weight", "node", "cls", "bits", "bands"])

    return run


PROFILE = "doc_key long, digest long, n_shingles long, weight long, node long, cls binary, bits binary, bands array<struct<slack:long,sigs:array<long>>>"


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, who) in their order to (grp, who, n_sets, n_sigs): the sets of every signature that several have.

    Signatures of the same sets are one group, as far as one batch of rows has them; n_sigs says how many they are.
    """
    rest: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last signature, which may go on

    def found(sig: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, who = sig[new], who[new]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]]))
        n = np.diff(np.append(start, len(sig)))
        plain = mix(who.view(U))
        grp = mix(np.add.reduceat(plain, start) ^ mix(plain[start] + n.astype(U))) if len(start) else plain
        many = np.flatnonzero(n > 1)
        _, at, times = np.unique(grp[many], return_index=True, return_counts=True)
        runs = many[at]
        size = n[runs]
        rows = np.repeat(start[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        columns = [np.repeat(grp[runs].view(np.int64), size), who[rows], np.repeat(size, size), np.repeat(times.astype(np.int64), size)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["grp", "who", "n_sets", "n_sigs"])

    for batch in batches:
        sig, who = batch.column("sig").to_numpy(), batch.column("who").to_numpy()
        if not len(sig):
            continue
        cut = int(np.searchsorted(sig, sig[-1]))
        if cut or (rest and rest[0][0][0] != sig[-1]):
            yield found(*map(np.concatenate, zip(*rest, (sig[:cut], who[:cut]), strict=True)))
            rest = []
        rest.append((sig[cut:], who[cut:]))
    if rest:
        yield found(*map(np.concatenate, zip(*rest, strict=True)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def forest(size: np.ndarray, maps: Maps, sides: list[int], num: int, den: int, linked: Callable[[int, int], bool] | None = None, label: np.ndarray | None = None) -> list[int]:
    """For each set the number of a set that it is connected to by links (itself for roots). With two sides only pairs across count.

    ``size`` ascends. ``linked`` says for certain whether two sets link; without it, sets that may link do. ``label`` has what is connected
    from the start: for each set the least number of its component.
    """
    side = np.array(sides)
    across = len(set(sides)) > 1
    label = np.arange(len(size)) if label is None else label.copy()
    low = np.searchsorted(size * den, size * num)  # the first partner that is large enough
    step = max(1, (4 << 20) // (8 * max(m.shape[1] for _, _, m in maps.segments)))  # a bounded number of bitmaps at a time
    for i in range(1, len(size)):
        for start in range(int(low[i]), i, step):
            at = np.arange(start, min(i, start + step))
            at = at[label[at] != label[i]]
            if across:
                at = at[side[at] != side[i]]
            at = at[may_link(maps.apart(i, at), size[at], int(size[i]), num, den)]
            for j in at.tolist():
                if label[j] != label[i] and (linked is None or linked(j, i)):
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label[label == old] = new
    return label.tolist()


class Texts:
    """Sets of one tile with the texts they come from, for comparing words."""

    def __init__(self, texts: list[bytes], n_words: int, key: int) -> None:
        self.texts, self.n_words = texts, n_words
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        found = shingle_sets(data, offsets, n_words, key, places=True)
        self.sets, self.places = [f[0] for f in found], [f[1] for f in found]
        self.known: dict[int, list[bytes]] = {}
        self.held = 0

    def words(self, i: int) -> list[bytes]:
        if i not in self.known:
            if self.held > 400_000:
                self.known, self.held = {}, 0
            self.known[i] = self.texts[i].translate(LOWER_TABLE).split()
            self.held += len(self.known[i])
        return self.known[i]

    def common(self, i: int, j: int) -> int:
        """How many shingles two sets share. What agrees by hash is compared as words, in runs that go along in both texts."""
        a, b = self.sets[i], self.sets[j]
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        same = np.flatnonzero(b[at] == a)
        p, q = self.places[i][same], self.places[j][at[same]]
        order = np.argsort(p)
        p, q = p[order], q[order]
        cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
        x, y = self.words(i), self.words(j)
        for first, last in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(p)]]).tolist(), strict=True):
            if first < last and x[p[first] : p[last - 1] + self.n_words] != y[q[first] : q[last - 1] + self.n_words]:
                return len(self.exact(x) & self.exact(y))  # two shingles with one hash
        return len(same)

    def exact(self, words: list[bytes]) -> set[tuple[bytes, ...]]:
        return {tuple(words[k : k + self.n_words]) for k in range(max(1, len(words) - self.n_words + 1))}


def link_texts(texts: list[bytes], sides: list[int], n_words: int, num: int, den: int, key: int = PLAIN_KEY) -> list[int]:
    """``forest`` of texts with words, in any order, with exact intersections."""
    tile = Texts(texts, n_words, key)
    size = np.array([len(s) for s in tile.sets], np.int64)
    order = np.argsort(size, kind="stable").tolist()

    def linked(j: int, i: int) -> bool:
        i, j = order[i], order[j]
        both = len(tile.sets[i]) + len(tile.sets[j])
        common = overlap(tile.sets[i], tile.sets[j])
        return den * common >= num * (both - common) and den * (common := tile.common(i, j)) >= num * (both - common)

    label = forest(size[order], Maps([bitmap(tile.sets[i], bitmap_bits(len(tile.sets[i]))) for i in order]), [sides[i] for i in order], num, den, linked)
    out = [0] * len(texts)
    for k, i in enumerate(order):
        out[i] = order[label[k]]
    return out


def stars(names: list, label: list[int]) -> list[tuple]:
    """(name, smallest name of its component) of all that aren't the smallest."""
    least: dict[int, object] = {}
    for name, k in zip(names, label, strict=True):
        least[k] = min(name, least.get(k, name))
    return [(name, least[k]) for name, k in zip(names, label, strict=True) if least[k] != name]


def cells(column: pa.Array) -> list:
    """The values of a column, lists of numbers as arrays of their own."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def tiled(names: tuple[str, ...], kind: pa.DataType, join: Callable[[list[tuple]], list[tuple]]):
    """Rows (``names``, a task's key first) sorted by the key to edges (a, b): what ``join`` finds among the rows of one key, one key in memory at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, pairs = None, []

        def out() -> pa.RecordBatch:
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                for key, *row in zip(*(cells(part.column(c)) for c in names), strict=True):
                    if key != now:
                        if len(held) > 1:
                            pairs += join(held)
                        held, now = [], key
                    held.append(tuple(row))
            yield out()
            pairs = []
        if len(held) > 1:
            pairs += join(held)
        yield out()

    return run


def _blocks(num: int, den: int):
    """Rows (task, side, n_shingles, node, bits) to edges of nodes that may link."""

    def join(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r[1], r[2]))
        maps = Maps([np.frombuffer(r[3], U) for r in rows])
        label = forest(np.array([r[1] for r in rows], np.int64), maps, [r[0] for r in rows], num, den)
        return stars([r[2] for r in rows], label)

    return tiled(("task", "side", "n_shingles", "node", "bits"), pa.int64(), join)


def _tiles(n_words: int, num: int, den: int, key: int):
    """Rows (task, side, cls, text) to links of classes."""

    def join(rows: list[tuple]) -> list[tuple]:
        held = {cls: (side, text) for side, cls, text in rows}
        texts = [text.encode() for _, text in held.values()]
        return stars(list(held), link_texts(texts, [side for side, _ in held.values()], n_words, num, den, key))

    return tiled(("task", "side", "cls", "text"), pa.binary(), join)


def _wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, cls, tasks) those whose text really is of that class."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            keys = pa.array(class_keys(data, offsets), pa.binary())
            yield batch.slice(a, b - a).filter(pc.fill_null(pc.equal(keys, batch.column("cls")[a:b].cast(pa.binary())), False))


def _pairs_of(own: Column, n: Column) -> Column:
    """For block ``own`` of ``n`` blocks its tasks as array<struct<name, side>>: one with each block, itself included."""
    name = lambda t: F.concat_ws("=", F.least(own, t), F.greatest(own, t))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.struct(name(t).alias("name"), F.when(t < own, 1).otherwise(0).alias("side")))


def _candidates(rows: DataFrame, num: int, den: int, common: int, block: int) -> DataFrame:
    """(node, comp): candidate groups of the classes in ``rows`` (as _profile makes them) that may link to some other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = rows.where("size(bands) > 0").select("node", F.inline("bands")).select(F.explode("sigs").alias("sig"), F.expr("node | slack").alias("who"))
    found = sigs.repartition(n, "sig").sortWithinPartitions("sig", "who").mapInArrow(lean(_shared), "grp long, who long, n_sets long, n_sigs long")
    groups = materialize(found.groupBy("grp", "who", "n_sets").agg(F.sum("n_sigs").alias("n_sigs")), "join-groups")
    # A set with as many common parts as its slack, or fewer, leaves them out: it agrees in others with each partner.
    spared = groups.where(F.col("n_sets") > common).groupBy("who").agg(F.sum("n_sigs").alias("parts")).where(f"parts <= (who & {SLACK})").select("who", F.lit(True).alias("spared"))
    kept = groups.join(spared, "who", "left").where((F.col("n_sets") <= common) | F.col("spared").isNull())
    kept = kept.select("grp", F.col("who").bitwiseAND(F.lit(~SLACK)).alias("node"), F.ceil(F.col("n_sets") / block).cast("int").alias("n_blocks"))
    sets = rows.where("cls is not null").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("node", "n_shingles", "bits")]).drop("cls")
    tasks = kept.withColumn("task", F.explode(_pairs_of(F.expr("pmod(xxhash64(node), n_blocks)").cast("int"), F.col("n_blocks"))))
    tasks = tasks.select("node", F.concat_ws(":", "grp", "task.name").alias("task"), "task.side")
    edges = tasks.join(sets, "node").repartition(n, "task").sortWithinPartitions("task").mapInArrow(lean(_blocks(num, den)), "a long, b long")
    out = connected_components(edges, "join-rough").withColumnsRenamed({"root": "comp"})
    release(groups)
    return out


def tile_tasks(members: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """``members`` (cls, comp, n_shingles, weight) with the tiles' tasks each takes part in, as tasks array<struct<task, side>>."""
    width = float(np.log(den / num)) * (1 + 1e-9)
    members = members.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width)).cast("int"))
    totals = members.groupBy("comp", "band").agg(F.sum("weight").alias("n"))
    whole = totals.groupBy("comp").agg(F.sum("n").alias("all"))
    cut = totals.join(whole, "comp").where(F.col("all") > tile).select("comp", "band", F.ceil(F.col("n") / tile).cast("int").alias("m"))
    near = cut.select("comp", F.explode(F.array(*[F.struct((F.col("band") + d).alias("band"), F.lit(d).alias("d"), F.col("m")) for d in (-1, 0, 1)])).alias("x")).select("comp", "x.*")
    # d = -1: the count belongs to the next larger band, 1: to the next smaller
    near = near.groupBy("comp", "band").agg(*[F.coalesce(F.max(F.when(F.col("d") == d, F.col("m"))), F.lit(0)).alias(n) for d, n in ((-1, "m_up"), (0, "m_own"), (1, "m_down"))])
    found = members.join(near, ["comp", "band"], "left").withColumn("s", F.expr("pmod(xxhash64(cls), greatest(m_own, 1))").cast("int"))
    name = lambda b, i, j: F.concat_ws("/", F.hex("comp"), b, i, j)
    upto = lambda m: F.when(F.col(m) > 0, F.sequence(F.lit(0), F.col(m) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda t, side: F.struct(t.alias("task"), side.cast("int").alias("side"))
    own = F.transform(upto("m_own"), lambda t: task(name(F.concat(F.col("band"), F.lit("=")), F.least("s", t), F.greatest("s", t)), F.when(t < F.col("s"), 1).otherwise(0)))
    up = F.transform(upto("m_up"), lambda t: task(name(F.concat(F.col("band"), F.lit("+")), F.col("s"), t), F.lit(0)))
    down = F.transform(upto("m_down"), lambda t: task(name(F.concat(F.col("band") - 1, F.lit("+")), t, F.col("s")), F.lit(1)))
    one = F.array(task(F.hex("comp"), F.lit(0)))
    return found.withColumn("tasks", F.when(F.col("m_own").isNull(), one).otherwise(F.concat(own, up, down))).select("cls", "doc_key", "digest", "tasks")


def near_duplicates(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10, **how: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Sets of distinct ``n_words``-word shingles link when den * intersection >= num * union. component_id is the smallest id
    that links reach, itself included. Words are runs of non-blank characters with A-Z in lower case; a text of fewer words is
    one shingle; one without words, or null, is an empty set that links with nothing (its component is its own id).
    Null ids take part in links but name no component; a component of null ids only has a null id. Equal sets always link.
    Repeated rows are equal sets. Very long texts are taken whole; one text has to fit into a task. An empty table gives no rows.
    Other columns aren't read.

    Shingles are found by 64-bit hashes under a key drawn for each call (so that no texts can be made to collide), and a link
    counts only after its shingles agree word by word. Texts with the same words in the same order are told by a 128-bit BLAKE2b.
    ``how`` has the bounds ``tile``, ``common`` and ``block``, which change no result.
    """
    return _linked(docs, n_words, num, den, **how).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _own() -> Column:
    """What orders the rows of a component: by id, null last, then by digest."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each class of equal texts (or sets) in ``rows``: cls, node, n_shingles, ``one`` row's (doc_key, digest, weight), rows, class_id, class_least."""
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("doc_key", "digest", "weight")).alias("one"),
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("class_id"), F.min(_own()).alias("class_least"),
    )
    return materialize(classes, "join-classes")


def with_components(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, n_shingles, cls) with component_id and the least row (``_own``) of what ``links`` between classes reach; both null without a class."""
    roots = connected_components(links, "join-links").withColumnsRenamed({"node": "cls"})
    linked = roots.join(classes, "cls")
    component = linked.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("class_least").alias("least"))
    names = classes.select("cls", "rows", "class_id", "class_least").join(linked.select("cls", "root").join(component, "root").select("cls", "component_id", "least"), "cls", "left")
    names = materialize(names.select("cls", "rows", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("least", "class_least").alias("least")), "join-names")
    worded = spread_join(rows.where("cls is not null").select("doc_id", "digest", "n_shingles", "cls"), names, "cls").drop("cls", "rows")
    wordless = rows.where("cls is null").select("doc_id", "digest", "n_shingles", *[F.lit(None).cast(names.schema[c].dataType).alias(c) for c in ("component_id", "least")])
    return worded.unionByName(wordless)


def _linked(docs: DataFrame, n_words: int, num: int, den: int, tile: int = TILE_SHINGLES, common: int = COMMON_SETS, block: int = BLOCK_SETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest of the text, n_shingles, component_id and, as ``_own`` has it, the least of its component; both null without words."""
    small_batches(docs.sparkSession)
    secret = secrets.randbits(63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    docs = docs.select("doc_id", key.alias("doc_key"), F.xxhash64("text").alias("digest"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = materialize(docs.mapInArrow(lean(_profile(n_words, num, den, secret)), f"doc_id {kind}, {PROFILE}"), "join-profile")
    rough = _candidates(full, num, den, common, block)
    rows = materialize(full.drop("bits", "bands"), "join-rows")
    release(full)
    classes = classes_of(rows)
    members = materialize(classes.join(rough, "node").select("cls", "comp", "n_shingles", "one.*"), "join-members")
    tasks = tile_tasks(members, num, den, tile)
    # Most texts are in no candidate group; the bitmap keeps nearly all of those from being moved, the join drops the rest.
    texts = docs.where(maybe_in(members, "doc_key")).join(tasks.hint("merge"), ["doc_key", "digest"]).select("text", "cls", "tasks")
    sets = texts.mapInArrow(lean(_wanted), texts.schema).select(F.inline("tasks"), "cls", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = sets.repartition(n, "task").sortWithinPartitions("task").mapInArrow(lean(_tiles(n_words, num, den, secret)), "a binary, b binary")
    return with_components(rows, classes, links)


def keep_representatives(docs: DataFrame, n_words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` that stay when of each group exactly one does: one with the smallest id. Rows without words stay.

    Of several texts with that id in a group, one stays by a 64-bit hash; of rows equal in id and text, the one least in its other
    columns. A group of null ids only keeps one row as well. Very long texts are compared whole. An empty table stays empty. All columns stay,
    under any names.
    """
    rows = _linked(docs, n_words, num, den).where("least is not null").select("doc_id", "digest", (_own() == F.col("least")).alias("stays"))
    fate = materialize(rows.groupBy("doc_id", "digest", "stays").count().where("not stays or count > 1"), "join-fate")
    fate = fate.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "stays")
    digest = F.xxhash64(docs["text"])
    same = docs["doc_id"].eqNullSafe(fate["__id"]) & (digest == fate["__digest"])
    twice = fate.where("stays")
    kept = docs.join(fate, same, "left_anti")
    if twice.isEmpty():
        return kept
    one = docs.join(twice, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("row"))
    return kept.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
