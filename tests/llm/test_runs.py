"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import periodic_runs as P
from palimpsest.llm.queries import QUERIES, table

rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def brute_runs(words):
    """(start, length, period) of all runs."""
    t = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out = {}
    for q in range(1, len(t) // 2 + 1):
        same = np.concatenate([[False], t[q:] == t[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(12, 2 * q):
                out.setdefault((a, b - a + q), q)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequences(seed):
    """Few letters, many letters, powers between other words, Fibonacci words."""
    rng = random.Random(seed)
    for _ in range(rng.randrange(1, 6)):
        kind, n = rng.randrange(5), rng.randrange(200)
        if kind == 0:
            yield [rng.randrange(2) for _ in range(n)]
        elif kind == 1:
            yield [rng.randrange(30) for _ in range(n)]
        elif kind == 2:
            power = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
            yield [rng.randrange(3) for _ in range(rng.randrange(20))] + (power * n)[:n] + [rng.randrange(3) for _ in range(rng.randrange(20))]
        elif kind == 3:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            yield b[:n]
        else:
            yield [0] * n


def test_runs_of_sequences():
    for seed in range(250):
        texts = [[b"%d" % x for x in t] for t in sequences(seed)]
        got = [list(map(tuple, r.tolist())) for r in P.find_runs([P.numbered(t) for t in texts])]
        assert got == [brute_runs([w.decode() for w in t]) for t in texts], texts


def test_leaves_are_gone_through_in_parts(monkeypatch):
    monkeypatch.setattr(P, "STEP", 5)
    test_runs_of_sequences()


def test_nested_runs_and_ties():
    words = "a a a a a a a a a a a a b " * 3  # three runs of period 1 within one of period 13
    runs = P.find_runs([P.numbered(words.encode().split())])[0].tolist()
    assert runs == [[0, 12, 1], [0, 39, 13], [13, 12, 1], [26, 12, 1]]
    assert P._described(words.encode().split(), np.array(runs))[:5] == (4, 0, 39, 13, 3000)
    assert P.collapsed(39, np.array(runs)).nonzero()[0].tolist() == [0, 12]
    assert P.find_runs([P.numbered([b"x"] * 11), P.numbered([b"x"] * 12)])[1].tolist() == [[0, 12, 1]]  # texts don't go on in each other
    assert len(P.find_runs([P.numbered([b"x"] * 11), P.numbered([b"x"] * 11)])[0]) == 0


def test_long_runs_take_no_squares():
    n = 300_000
    assert P.find_runs([np.zeros(n, np.int64)])[0].tolist() == [[0, n, 1]]
    assert P.find_runs([np.arange(n) % 7])[0].tolist() == [[0, n, 7]]


@pytest.mark.parametrize("planted", [False, True])
def test_odd_rows(odd, odd_rows, clashing, empty, planted):
    want = sorted((brute(r[0], r[1], planted) for r in odd_rows), key=repr)
    assert rows_of(P.periodic_runs(odd, planted)) == want
    assert rows_of(P.periodic_runs(clashing, planted)) == want
    assert P.periodic_runs(empty, planted).collect() == []


def test_query_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = sorted((brute(r.doc_id, r.text, True) for r in table(spark, sf, "documents").collect()), key=repr)
    got = QUERIES["op12_periodic_runs"](spark, sf)
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert rows_of(got) == want
    assert any(r[1] for r in want)
