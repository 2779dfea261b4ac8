"""Periodic runs of words, from the branching tandem repeats of a suffix tree.

The tree of a slice of texts is its suffix array with the intervals of equal prefixes: an interval of the array is a node, its
depth the words that all its suffixes begin with, its leaf list the suffixes themselves. For each node the leaf lists of all
children but the largest are gone through (Stoye and Gusfield); a leaf i of a node of depth q is the start of a branching
tandem repeat of period q if leaf i + q is in another child of the node. Every run has exactly one such repeat for its
period, at its right end. Rotating that repeat to the left as far as words agree gives the run; repeats of multiples of the
period rotate to the same stretch and are merged.

All steps are vectorised over a slice of texts. Words of different texts never count as equal, so nodes stay within a text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.blocks import lean, small_batches, text_bytes

#: Words of a slice of texts, whose tree is made at once; a longer text comes alone.
SLICE_WORDS = 1 << 16
LEAST_WORDS, LEAST_TIMES = 12, 2
#: Leaves gone through at a time.
STEP = 1 << 20


def suffix_ranks(values: np.ndarray) -> list[np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4, ... numbers, as many arrays as it takes until all differ.

    A rank is the number of suffixes before all of that rank. Whatever repeats has to be followed by a number of its own.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    new = np.ones(n, bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, step = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)  # places in order of suffixes that aren't told apart yet
        if not len(at):
            return levels
        who = order[at]
        key = rank[who] * n + rank[who + step]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[at] = split
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(split, at, 0))
        levels.append(rank)
        step *= 2


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each suffix of the array but the first, how many words it shares with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    apart: list[np.ndarray] = []  # by the level at which two neighbours first differ
    for rank in levels:
        same = rank[order[at]] == rank[order[at - 1]]
        apart.append(at[~same])
        at = at[same]
    for k, at in enumerate(apart):
        i, j = order[at], order[at - 1]
        have = np.zeros(len(at), np.int64)
        for level in range(k - 1, -1, -1):
            same = levels[level][i + have] == levels[level][j + have]
            have += np.where(same, 1 << level, 0)
        out[at] = have
    return out


def nearest_below(depth: np.ndarray, strict: bool) -> np.ndarray:
    """For each place with a number above 0 the nearest one before it with a smaller (or, unless ``strict``, equal) one; place 0 has none above 0."""
    back = np.arange(-1, len(depth) - 1)
    left = np.flatnonzero(depth > 0)
    while len(left):
        over = depth[back[left]] >= depth[left] if strict else depth[back[left]] > depth[left]
        left = left[over]
        back[left] = back[back[left]]
    return back


def branching_repeats(levels: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of all branching tandem repeats: suffixes i and i + q that share just q words."""
    n = len(order)
    rank = levels[-1]
    depth = np.append(common_prefixes(levels, order), -1)
    depth[0] = -1
    low, edge = nearest_below(depth, True), nearest_below(depth, False)
    mirrored = depth[::-1]
    high = n - nearest_below(mirrored, True)[::-1]
    last = n - nearest_below(mirrored, False)[::-1]  # the next edge between children of the same node, or its end
    k = np.flatnonzero(depth > 0)
    # Children are what edges part: one before each edge, and one behind a node's last.
    ends = k[last[k] == high[k]]
    node = np.concatenate([k, ends])
    begin = np.concatenate([edge[k], ends])
    end = np.concatenate([k, high[ends]])
    low, high, q = low[node], high[node], depth[node]
    # Of each node's children the largest is left out (the first of those, if there are several).
    size = end - begin
    by = np.lexsort((begin, -size, high, low))
    same = np.zeros(len(by), bool)
    same[1:] = (low[by[1:]] == low[by[:-1]]) & (high[by[1:]] == high[by[:-1]])
    small = by[same]
    starts, periods = [], []
    total = np.cumsum(size[small])
    a = 0
    while a < len(small):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, "right")))
        part = small[a:b]
        of = np.repeat(part, size[part])
        place = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + begin[of]
        leaf = order[place]
        for sign in (1, -1):
            other = leaf + sign * q[of]
            there = (other >= 0) & (other < n)
            at = rank[np.where(there, other, 0)]
            hit = there & (at >= low[of]) & (at < high[of]) & ((at < begin[of]) | (at >= end[of]))
            starts.append(np.minimum(leaf, other)[hit])
            periods.append(q[of][hit])
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, words ``numbered``, its runs as rows (start, length, period), by start, then period.

    Runs are maximal stretches of smallest period q, of LEAST_TIMES * q words at least and of LEAST_WORDS at least, that no neighbouring word goes on with.
    """
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    n = int(edges[-1])
    values = np.arange(n)  # a number of its own behind each text
    for t, a in zip(texts, edges[:-1].tolist(), strict=True):
        values[a : a + len(t)] = a + t
    levels = suffix_ranks(values)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    start, period = branching_repeats(levels, order)
    end = start + 2 * period
    # Rotated to the left by as many words as agree, in powers of two.
    for level in range(len(levels) - 1, -1, -1):
        back = start - (1 << level)
        at = np.maximum(back, 0)
        start = np.where((back >= 0) & (levels[level][at] == levels[level][at + period]), back, start)
    keep = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    start, end, period = start[keep], end[keep], period[keep]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(by), bool)  # of one stretch the smallest period counts
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    start, end, period = start[by], end[by], period[by]
    cut = np.searchsorted(start, edges)
    return [np.stack([start[a:b] - e, end[a:b] - start[a:b], period[a:b]], 1) for a, b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), edges[:-1].tolist(), strict=True)]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of the first word like it."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays when runs keep their first period only."""
    open_ = np.zeros(n + 1, np.int64)
    np.add.at(open_, runs[:, 0] + runs[:, 2], 1)
    np.add.at(open_, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(open_)[:n] == 0


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten the numbers of the words that make the tail of a text of ``n`` words periodic; None for other texts."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


COLUMNS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _described(words: list[bytes], runs: np.ndarray) -> tuple:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    if not len(runs):
        return 0, None, None, None, None, sha(b""), sha(b" ".join(words))
    start, length, period = (int(x) for x in runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]])
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    kept = [words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()]
    return len(runs), start, length, period, 1000 * length // period, sha(listed.encode()), sha(b" ".join(kept))


def _scan(planted: bool):
    """(doc_id, text) to doc_id and COLUMNS, a slice of texts in memory at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            held: list[list[bytes]] = []
            size = done = 0
            for i in range(len(ids) + 1):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split() if i < len(ids) else []
                if planted and i < len(ids) and (at := periodic_tail(ids[i], len(words))) is not None:
                    words = [words[k] for k in at.tolist()]
                if held and (i == len(ids) or size + len(words) > SLICE_WORDS):
                    rows = list(map(_described, held, find_runs([numbered(w) for w in held])))
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(held)), *columns], names=["doc_id", *COLUMNS])
                    done, held, size = i, [], 0
                held.append(words)
                size += len(words)

    return run


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_runs; start, length, period and exponent_milli of the longest run; runs_sha256; collapsed_sha256.

    Words are runs of non-blank characters, numbered from 0. A run is a stretch of words with smallest period q (words q apart are
    the same) and max(12, 2 q) words at least that no neighbouring word goes on with. Ties for the longest go to the smallest start, then
    period; without runs the four are null. runs_sha256 is of all runs' ``start,length,period`` lines in order, collapsed_sha256 of
    the words that stay when of each run only the first q words do, between single spaces. With ``planted``, texts of one id in
    ten are first made periodic from some word on (``periodic_tail``), which leaves texts of null ids as they are.

    A null or empty text has no words, hence no runs; repeated rows each get a row. A very long text is searched whole: it has to fit
    into a task, which holds 8 bytes a word for each doubling of its longest repeat. An empty table gives no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    long_ = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in COLUMNS.items())
    return docs.select("doc_id", "text").mapInArrow(lean(_scan(planted)), f"doc_id {kind}, {long_}")
