"""N-gram join, components and quality classifier."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ngram_join as J
from palimpsest.llm.blocks import slices
from palimpsest.llm.components import connected_components
from palimpsest.llm.quality import FEATURES, fit_trees, held_out, quality_scores, statistics

rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def brute(rows, n, num, den):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_join_of_odd_rows(odd, odd_rows, clashing, n, num, den):
    want = brute([r[:2] for r in odd_rows], n, num, den)
    assert rows_of(J.near_duplicates(odd, n, num, den)) == want
    assert rows_of(J.near_duplicates(clashing, n, num, den)) == want


def varied(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 11, 14, 25, 40, 90, 300]))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20 + 2)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            if rng.random() < 0.3:
                w += [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1 + len(w) // 8))]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "den", "tile"), [(3, 90, 100, 2_000_000), (3, 90, 100, 150), (2, 8, 10, 2_000_000), (2, 8, 10, 300)])
def test_join_loses_no_link(spark, n, num, den, tile):
    rows = varied(n * 10 + tile % 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(J.near_duplicates(docs, n, num, den, tile=tile)) == brute(rows, n, num, den)


def test_linked_sets_share_a_signature_that_neither_leaves_out():
    rng = random.Random(2)
    for num, den in ((9, 10), (8, 10)):
        bands = J.Bands(num, den)
        for _ in range(1500):
            x = rng.choice([3, 4, 9, 10, 13, 20, 50, 120, 700])
            a = {rng.randrange(1 << 64) for _ in range(x)}
            b = set(a)
            while True:  # as far apart as a link allows
                c = set(b)
                if rng.random() < 0.5 and c:
                    c.discard(rng.choice(sorted(c)))
                if rng.random() < 0.6:
                    c.add(rng.randrange(1 << 64))
                if den * len(a & c) < num * len(a | c):
                    break
                b = c
            one, two = (J.signatures(np.array(sorted(s), np.uint64), bands) for s in (a, b))
            everything = {int(s) for _, sigs in one + two for s in sigs}
            common = {s for s in everything if rng.random() < 0.2}  # what is left out depends on the signature alone
            left = []
            for bandwise in (one, two):
                left.append(set())
                for slack, sigs in bandwise:
                    sigs = set(sigs.tolist())
                    left[-1] |= sigs - common if len(sigs & common) <= slack else sigs
            assert left[0] & left[1], (num, x)


@pytest.mark.parametrize("which", ["all", "full", "empty"])
def test_sets_with_few_full_parts_meet_their_partners(which):
    """Whatever is common, also all full parts at once, of a set with too few of them."""
    rng = random.Random(11)
    bands, few = J.Bands(8, 10), 0
    for x in (4, 4, 5, 6) * 2500:
        a = sorted(rng.randrange(1 << 64) for _ in range(x))
        b = sorted({*a, rng.randrange(1 << 64)})
        one, two = (J.signatures(np.array(s, np.uint64), bands) for s in (a, b))
        short = [len(sigs) == p for (_, sigs), (_, p, _) in zip(one, bands.joined(x), strict=True)]
        few += any(short)
        if not any(short):
            continue
        every = {int(s) for _, sigs in one + two for s in sigs}
        shared = {int(s) for _, sigs in one for s in sigs} & {int(s) for _, sigs in two for s in sigs}
        common = {"all": every, "full": shared, "empty": every - shared}[which]
        left = [set().union(*({int(s) for s in sigs} - (common if len({int(s) for s in sigs} & common) <= slack else set()) for slack, sigs in side)) for side in (one, two)]
        assert left[0] & left[1], (a, b)
    assert few


def test_families_of_short_texts_stay_whole(spark, monkeypatch):
    """A text with too few full parts heads a family so large that all its full parts are common."""
    monkeypatch.setattr(J.secrets, "randbits", lambda n: J.PLAIN_KEY >> 1)
    rng, heads = random.Random(5), []
    bands = J.Bands(8, 10)
    while len(heads) < 2:
        words = [f"w{rng.randrange(1 << 40)}" for _ in range(8)]
        text = " ".join(words).encode()
        s = J.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 5, J.PLAIN_KEY >> 1)[0]
        if any(len(sigs) == parts for (_, sigs), (_, parts, _) in zip(J.signatures(s, bands, J.PLAIN_KEY >> 1), bands.joined(4), strict=True)):
            heads.append(words)
    rows = [(1000 * k + i, " ".join([*w, *([f"more{k}x{i}"] if i else [])])) for k, w in enumerate(heads) for i in range(80)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 10)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(d, d // 1000 * 1000) for d, _ in rows]


def test_few_sets_need_signatures_of_empty_parts():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10)):
        bands = J.Bands(num, den)
        for size in (40, 100, 400, 3000):
            for _ in range(50):
                s = np.sort(rng.integers(0, 1 << 64, size, dtype=np.uint64))
                for (_, sigs), (_, parts, need) in zip(J.signatures(s, bands), bands.joined(size), strict=True):
                    assert need <= len(sigs) < parts or len(sigs) == parts == len(np.unique(sigs))


def thue_morse(letters, n=4096):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_constructed_texts_do_not_collide(spark):
    """Texts that every polynomial hash modulo a power of two confuses."""
    texts = [f"{'x' * 9} {thue_morse(ab)} {'y' * 9}" for ab in ("ab", "ba")] + [f"{'x' * 9}{thue_morse(ab)}{'y' * 9}" for ab in ("ab", "ba")]
    texts += [f"{'x' * 9}{thue_morse(ab, 48)}{'y' * 7}" for ab in ("ab", "ba")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert rows_of(J.near_duplicates(docs, 3, 90, 100)) == [(i, 1, i) for i in range(6)]


def test_equal_hashes_do_not_make_a_link(monkeypatch):
    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    texts = [words("a").encode(), words("b").encode(), words("a").upper().encode() + b" more"]
    assert J.link_texts(texts, [0, 0, 0], 3, 9, 10) in ([0, 1, 0], [2, 1, 2])
    real = J.run_hashes
    monkeypatch.setattr(J, "run_hashes", lambda d, load, starts, ends, key: real(d, load, starts + 1, ends, key))  # blind for a word's first letter
    assert J.link_texts(texts, [0, 0, 0], 3, 9, 10) in ([0, 1, 0], [2, 1, 2])


def test_forest_matches_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        base = [f"w{rng.randrange(1 << 30)}" for _ in range(42)]
        texts = []
        for _ in range(25):
            w = base[: rng.randrange(20, 43)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(1 << 30)}"
            texts.append(w)
        sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in texts]
        got = J.link_texts([" ".join(w).encode() for w in texts], [0] * 25, 2, 9, 10)
        up = list(range(25))
        for i in range(25):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if 10 * c >= 9 * (len(sets[i]) + len(sets[j]) - c):
                    old, new = up[i], up[j]
                    up = [new if u == old else u for u in up]
        assert len({(a, b) for a, b in zip(got, up)}) == len(set(got)) == len(set(up))


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(8)
    for _ in range(300):
        base = {rng.randrange(1 << 64) for _ in range(rng.choice([9, 60, 700]))}
        other = set(list(base)[len(base) // 9 :]) | {rng.randrange(1 << 64) for _ in range(rng.randrange(4))}
        a, b = (np.array(sorted(s), np.uint64) for s in (base, other))
        maps = J.Maps([J.bitmap(a, J.bitmap_bits(len(a))), J.bitmap(b, J.bitmap_bits(len(b)) * 2)])
        apart = maps.apart(1, np.array([0]))
        assert apart[0] <= len(base ^ other)
        if 10 * len(base & other) >= 8 * len(base | other):
            assert J.may_link(apart, np.array([len(a)]), len(b), 8, 10).all()


@pytest.mark.parametrize(("common", "block"), [(1, 2), (1, 3), (3, 4096)])
def test_join_with_common_parts_and_many_blocks(spark, common, block):
    rows = varied(77, groups=7)
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, 10, common=common, block=block)) == brute(rows, 3, 8, 10)


def test_join_empty(empty):
    assert J.near_duplicates(empty).count() == 0


def test_representatives(spark):
    rows = varied(5)
    docs = spark.createDataFrame([*rows, (None, "no id at all in this one"), (900, None)], "doc_id long, text string")
    keep = {d for d, _, c in brute([*rows, (900, None)], 5, 8, 10) if d == c}
    assert {r.doc_id for r in J.keep_representatives(docs).collect()} == keep | {None}


def test_representatives_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [
        (5, a, "x"), (9, a, "x"),  # the group that (5, a) names
        (2, b, "x"), (5, b, "x"),  # 5 again, but in another group
        (7, c, "y"), (7, c, "x"), (7, c, "x"), (8, c, "x"), (7, c.upper(), "x"), (None, c, "x"),  # repeated rows, and another text of the same id
        (None, "no ids " + b[:60], "x"), (None, "no ids " + b[:60], "x"),
        (5, "", "x"), (5, "", "x"), (None, None, "x"),
    ]
    got = [tuple(r) for r in J.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    seven = [r for r in got if r[0] == 7]
    assert len(seven) == 1 and seven[0] in [(7, c, "x"), (7, c.upper(), "x")]
    rest = [(5, a, "x"), (2, b, "x"), (None, "no ids " + b[:60], "x"), (5, "", "x"), (5, "", "x"), (None, None, "x")]
    assert sorted(map(repr, got)) == sorted(map(repr, [*seven, *rest]))


def test_representatives_keep_columns_of_any_names(odd, clashing, empty):
    plain = [tuple(r) for r in J.keep_representatives(odd).collect()]
    named = J.keep_representatives(clashing.withColumns({c: F.lit(1) for c in ("stays", "least", "__id", "__digest", "count", "doc_key")}))
    assert sorted(repr(tuple(r)[:5]) for r in named.collect()) == sorted(map(repr, plain))
    assert named.columns[: len(clashing.columns)] == clashing.columns
    assert J.keep_representatives(empty).columns == empty.columns and J.keep_representatives(empty).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    edges += [(5, 5), (None, 3), (7, None)]
    up = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for a, b in edges:
        if a != b and None not in (a, b):
            old, new = max(up[a], up[b]), min(up[a], up[b])
            up = {k: new if v == old else v for k, v in up.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == up and got.count() == len(up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_statistics_of_known_texts():
    import pyarrow as pa

    column = pa.array(["", "Ab ab\nAB 12 ||| é!", None, "x x x x"])
    (_, _, data, offsets), = slices(column)
    x = statistics(data, offsets)
    assert x.shape == (4, len(FEATURES)) and not x[0].any() and not x[2].any()
    f = dict(zip(FEATURES, x[1].tolist()))
    assert f["log_words"] == pytest.approx(np.log1p(6)) and f["bare_share"] == pytest.approx(1 / 6)
    assert f["distinct_share"] == pytest.approx(4 / 6) and f["repeat_share"] == pytest.approx(2 / 6)
    g = dict(zip(FEATURES, x[3].tolist()))
    assert g["top_share"] == 1 and g["repeat_share"] == pytest.approx(3 / 4) and g["pair_share"] == pytest.approx(1 / 3)


def test_slices_do_not_change_statistics():
    import pyarrow as pa

    texts = ["Ab cd " * i for i in range(40)] + [None, ""]
    whole = np.concatenate([statistics(d, o) for _, _, d, o in slices(pa.array(texts))])
    parts = np.concatenate([statistics(d, o) for _, _, d, o in slices(pa.array(["cut", *texts])[1:], 50)])
    assert np.array_equal(whole, parts)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    t = fit_trees(x[:3000], y[:3000])
    assert ((t.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_flattened_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4)).astype(np.float32)
    t = fit_trees(x, (x[:, 1] > 0.4).astype(float), rounds=8)
    for row, score in zip(x[:50], t.score(x[:50])):
        total = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scores = quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = scores.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_quality_of_odd_rows(spark, odd, odd_rows, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 0, 0), (None, 1, 0), (4, None, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_scores(odd, labels))
    assert len(got) == len(odd_rows) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) for r in got)
    assert rows_of(quality_scores(clashing, labels)) == got
    assert rows_of(quality_scores(odd, labels)) == got
    assert quality_scores(empty, labels).count() == 0
    none = quality_scores(odd, labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and {r.score for r in none} == {0.5}


def test_held_out_is_never_learned(spark, odd):
    import zlib

    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2) for i in range(30)], "doc_id long, quality int")
    assert rows_of(quality_scores(odd, labels)) == rows_of(quality_scores(odd, flipped))
    assert {r.doc_id for r in odd.where(held_out(odd.doc_id)).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0} & {r.doc_id for r in odd.collect()}


def plain_statistics(text):
    """FEATURES of one text, one by one."""
    raw = (text or "").encode()
    n, words = len(raw), [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw.split()]
    count = lambda test: sum(map(bool, map(test, raw)))
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    digit, blank, stop = (lambda c: 48 <= c <= 57), (lambda c: c == 32 or 9 <= c <= 13), (lambda c: chr(c) in ".,;:?'\"()-")
    size, w, pairs = max(n, 1), max(len(words), 1), list(zip(words, words[1:]))
    symbols = count(lambda c: c < 128 and not (letter(c) or digit(c) or blank(c) or stop(c)))
    bare = sum(not any(letter(c) or digit(c) for c in x) for x in words)
    top = max(map(words.count, set(words)), default=0)
    return np.array([
        np.log1p(n), np.log1p(len(words)), (n - count(blank)) / w, count(lambda c: 65 <= c <= 90) / size / max(count(letter) / size, 1e-9), symbols / size, count(stop) / size, count(digit) / size,
        count(lambda c: c >= 128) / size, count(blank) / size, raw.count(b"\n") / size, sum(a == b for a, b in pairs) / w, len(set(words)) / w, len(set(pairs)) / max(len(words) - 1, 1), top / w, bare / w,
    ]).astype(np.float32)


def test_scores_of_the_query_against_brute_force(spark):
    """Every score of the query from plain statistics, the labels outside the fold and a walk through each tree."""
    import zlib

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    x = {i: plain_statistics(t) for i, t in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    learned = sorted((tuple(x[i].tolist()[::-1]), labels[i]) for i in labels if i in docs and i not in held)
    t = fit_trees(np.array([k[::-1] for k, _ in learned], np.float32), np.array([y for _, y in learned], np.float64))
    got = quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    assert len(got) == len(docs)
    for r in got:
        total = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if x[r.doc_id][t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        score = 1 / (1 + np.exp(-total))
        assert r.score == pytest.approx(score, rel=1e-9) and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id in held)


def test_candidate_groups_do_not_grow_with_the_corpus(spark):
    """At five words and 0.8: parts of unlinked texts join no groups, whatever the number of documents."""
    largest, per_set = [], []
    for sf in ("0.01", "0.1"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", F.col("doc_id").alias("doc_key"), F.lit(1).cast("long").alias("digest"), "text")
        full = docs.mapInArrow(J._profile(5, 8, 10, 7), f"doc_id long, {J.PROFILE}").persist()
        rough = J._candidates(full, 8, 10, J.COMMON_SETS, J.BLOCK_SETS)
        groups = sorted(r["count"] for r in rough.groupBy("comp").count().collect())
        linked = J.near_duplicates(docs.select("doc_id", "text"), 5, 8, 10)
        classes = linked.groupBy("component_id").count().agg(F.max("count")).first()[0]
        largest.append(groups[-1] - classes)
        per_set.append(sum(groups) / full.count())
        full.unpersist()
    assert max(largest) <= 3 and per_set[1] <= 1.5 * per_set[0] + 0.01
