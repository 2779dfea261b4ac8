"""MinHash near-dedup against all pairs compared one by one."""

import random

import numpy as np
import pytest
from test_join_quality import brute, rows_of, varied

from palimpsest.llm import minhash_dedup as M

shown = lambda rows: sorted(((*r, r[0] == r[2]) for r in rows), key=repr)


@pytest.mark.parametrize(("n", "num", "den"), [(5, 85, 100), (3, 9, 10)])
def test_odd_rows(odd, odd_rows, clashing, empty, n, num, den):
    want = shown(brute([r[:2] for r in odd_rows], n, num, den))
    assert rows_of(M.minhash_dedup(odd, n, num, den)) == want
    assert rows_of(M.minhash_dedup(clashing, n, num, den)) == want
    assert M.minhash_dedup(empty, n, num, den).collect() == []


@pytest.mark.parametrize(("n", "num", "den", "tile", "diagonal"), [(5, 85, 100, 2_000_000, True), (5, 85, 100, 2_000_000, False), (3, 85, 100, 200, False), (2, 85, 100, 200, True)])
def test_no_link_is_lost(spark, monkeypatch, n, num, den, tile, diagonal):
    """Also when nothing is connected by the diagonal, and everything goes through the tensor's buckets and small tiles."""
    if not diagonal:
        real = M.table_keys
        monkeypatch.setattr(M, "table_keys", lambda rows, d: real(rows, d).limit(0) if d else real(rows, d))
    rows = varied(n * 7 + tile % 11, 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(M.minhash_dedup(docs, n, num, den, tile=tile)) == shown(brute(rows, n, num, den))


def test_chains_and_copies(spark):
    """A chain of texts of which only neighbours link, copies of each, and texts that share a passage without linking."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(1 << 30)}" for _ in range(300)]
    chain = []
    for k in range(12):
        chain.append(" ".join(words))
        words = words[: 8 * k] + [f"x{rng.randrange(1 << 30)}" for _ in range(8)] + words[8 * k + 8 :]
    passage = [f"p{i}" for i in range(90)]
    apart = [" ".join(passage + [f"y{rng.randrange(1 << 30)}" for _ in range(40)]) for _ in range(150)]
    texts = chain + apart + chain
    rows = [(7 * i % len(texts), t) for i, t in enumerate(texts)]
    got = M.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 85, 100)
    assert rows_of(got) == shown(brute(rows, 5, 85, 100))


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(200):
        both = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        a, b = np.unique(both[:370]), np.unique(both[30:])  # similarity 0.85
        x, y = M.sketches([a, b])
        agree.append((x == y).mean())
        assert ((x & np.uint64(M.NUMBER)) == np.arange(2 * M.SIDE)).all()
        assert (x == y)[: M.SIDE].any() and (x == y)[M.SIDE :].any()
    assert abs(np.mean(agree) - 0.85**M.ROWS) < 0.02
    assert 2 * (1 - 0.85**M.ROWS) ** M.SIDE < 3e-9


def test_keys_are_pairs_of_the_collections(spark):
    rows = spark.createDataFrame([(1, 1, [64 + 0, 128 + 1, 64 + M.SIDE, 192 + M.SIDE + 1, 64 + M.SIDE + 2])], "node long, root long, a array<long>")
    assert M.table_keys(rows, False).distinct().count() == 6
    assert M.table_keys(rows, True).count() == 2
