"""Exact dedup, sharding, mixing, decontamination, licences: odd rows against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import blocks, sharding
from palimpsest.llm.decontaminate import PatternGroup, Searcher, _loads, contamination, drop_contaminated, words_of
from palimpsest.llm.exact_dedup import CuckooFilter, CuckooIndex, apply_changes, digests, exact_dedup, live_index
from palimpsest.llm.licenses import RULES, SENTENCES, scan_licenses
from palimpsest.llm.licenses import oracle as license_oracle
from palimpsest.llm.mixing import mix, repeat_mixed, source_targets
from palimpsest.storage import materialize

rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def test_spread_join_meets_every_key(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HOT_KEYS", 5)
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "warm", *"abcdefgh"]), i) for i in range(400)]
    counts = Counter(k for k, _ in rows)
    left = spark.createDataFrame(rows, "key string, n int")
    table = spark.createDataFrame([(k, c, k.upper()) for k, c in counts.items()] + [("unused", 0, "x")], "key string, rows long, name string")
    joined = blocks.spread_join(left, table, "key")
    assert sorted((r.key, r.n, r.name) for r in joined.collect()) == sorted((k, n, k.upper()) for k, n in rows)
    assert blocks.spread_join(left.limit(0), table.limit(0), "key").count() == 0


def test_filters_let_all_members_through(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FILTER_BITS", 1 << 12)
    keys = spark.range(0, 600, 3).selectExpr("id", "cast(id as string) as s")
    every = spark.range(6000).selectExpr("id", "cast(id as string) as s")
    through = {r.id for r in every.where(blocks.maybe_in(keys, "id", "s")).collect()}
    assert set(range(0, 600, 3)) <= through and len(through) < 1000
    assert every.where(blocks.maybe_in(keys.limit(0), "id")).count() == 0


def test_free_names():
    assert blocks.free_names(["Hits", "hits_", "x"], "hits", "x", "y") == ["hits__", "x_", "y"] and blocks.free_names([], "a", "a") == ["a", "a_"]


def test_exact_dedup(odd, odd_rows, clashing):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[t or ""].append(i)
    want = []
    for i, t, *_ in odd_rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(exact_dedup(odd)) == sorted(want, key=repr)
    assert rows_of(exact_dedup(clashing)) == sorted(want, key=repr)


def test_live_index_of_odd_rows(spark):
    kinds = "doc_id long, text_sha256 string"
    a, b, c = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c"))
    rows = spark.createDataFrame([(5, a), (5, a), (None, a), (9, b), (None, c), (None, c), (3, None)], kinds).repartition(3)
    stored = spark.createDataFrame([(a, 4, 7), (b, 2, 20), (None, 1, 1)], "text_sha256 string, group_size long, keep_id long")
    deletes = spark.createDataFrame([(b,), (b,), (None,), ("0" * 64,)], "text_sha256 string")
    none = rows.limit(0)
    names = ("digest", "step", "slice", "rows", "largest", "group_size", "keep_id")
    clash = lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
    got = lambda *t: sorted(tuple(r) for r in live_index(*t).collect())
    fresh = sorted([(a, 3, 5), (b, 1, 9), (c, 2, None)], key=repr)
    assert got(rows) == got(clash(rows)) == got(rows, stored.limit(0), deletes) == sorted(fresh)
    merged = sorted([(a, 7, 7), (b, 1, 9), (c, 2, None)])
    assert got(rows, stored, deletes) == got(clash(rows), clash(stored), clash(deletes)) == merged
    assert got(none) == [] and got(none, stored, deletes) == [(a, 4, 7)]
    assert live_index(none).columns == ["text_sha256", "group_size", "keep_id"]


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup(empty).count() == 0


def test_cuckoo_filter_has_no_false_negatives():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    f = CuckooFilter(6000)
    assert all(f.insert(k) for k in keys)
    assert all(f.contains(k) for k in keys)
    for k in keys[:2500]:
        assert f.delete(k)
    assert all(f.contains(k) for k in keys[2500:])
    wrong = sum(f.contains(hashlib.sha256(b"no%d" % i).digest()) for i in range(20_000))
    assert wrong < 40


def test_cuckoo_index_resizes_and_verifies():
    index = CuckooIndex(16)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.insert(k, [1, i])
    assert index.resizes > 0
    assert all(index.get(k) == [1, i] for i, k in enumerate(keys))
    assert index.delete(keys[0]) and not index.delete(keys[0])
    assert index.get(keys[0]) is None and index.count == 2999
    # same print and homes, other digest: the stored key decides
    twin = keys[1][:10] + bytes(22)
    assert index.filter.contains(twin) and index.get(twin) is None and index.false_hits >= 1


def test_index_changes(spark, odd):
    rows = digests(odd)
    index = apply_changes(spark.createDataFrame([], "text_sha256 string, group_size long, keep_id long"), rows, None)
    assert index.agg(F.sum("group_size")).first()[0] == odd.count()
    gone = index.orderBy("text_sha256").limit(2)
    again = apply_changes(apply_changes(index, None, gone), rows.join(gone.select("text_sha256"), "text_sha256", "left_semi"), None)
    assert rows_of(again) == rows_of(index)


def test_changes_go_through_the_index(spark, monkeypatch):
    """Deletions and insertions in many slices against a dict, and by the index's own methods."""
    from palimpsest.llm import exact_dedup as X

    monkeypatch.setattr(X, "FLUSH_KEYS", 40)
    rng = random.Random(1)
    name = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    live: dict[str, tuple] = {}
    index = spark.createDataFrame([], "text_sha256 string, group_size long, keep_id long")
    for _ in range(3):
        new = [(rng.choice([None, rng.randrange(1000)]), name(rng.randrange(150))) for _ in range(300)] + [(1, None)]
        gone = [name(rng.randrange(200)) for _ in range(60)] + [None]
        index = apply_changes(index, spark.createDataFrame(new, "doc_id long, text_sha256 string"), spark.createDataFrame([(g,) for g in gone], "text_sha256 string"))
        live = {k: v for k, v in live.items() if k not in gone}
        for i, k in new:
            if k:
                n, most = live.get(k, (0, None))
                live[k] = (n + 1, max((x for x in (i, most) if x is not None), default=None))
        assert rows_of(index) == sorted(((k, *v) for k, v in live.items()), key=repr)
        index = spark.createDataFrame(index.collect(), index.schema)
    done = []
    monkeypatch.setattr(CuckooIndex, "delete", lambda self, key, real=CuckooIndex.delete: done.append(real(self, key)) or done[-1])
    batch = pa.RecordBatch.from_pylist([{"slice": 0, "step": s, "digest": bytes.fromhex(name(i)), "rows": 1, "largest": i} for s, i in ((0, 1), (0, 2), (1, 1), (1, 3), (2, 2))])
    (out,) = X._slice_indexes([batch])
    assert done == [True, False] and [(r["group_size"], r["keep_id"]) for r in out.to_pylist()] == [(2, 2)]


def test_smallest_capacity_is_optimal(monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([8, rng.randrange(9, 400), rng.randrange(9, 9000)]) for _ in range(rng.choice([1, 2, 24, 300]))]
        ranges = sharding.Ranges([(i, 0, s, 1, s) for i, s in enumerate(sizes)])
        shards = rng.choice([1, 3, 24])
        best = ranges.smallest(False, shards)
        need, fill = 1, 0
        for s in sizes:
            if fill + s > best:
                need, fill = need + 1, 0
            fill += s
        assert need <= shards
        tight = best - 1
        need, fill = 1, 0
        for s in sizes:
            if fill + s > tight:
                need, fill = need + 1, 0
            fill += s
        assert need > shards or tight < max(sizes)


def test_shards_are_near_equal_beside_a_large_group():
    rng = random.Random(5)
    for case in range(300):
        sizes = [rng.randrange(9, 90) for _ in range(rng.choice([1, 5, 23, 24, 25, 3000]))]
        if case % 3:
            sizes.insert(rng.choice([0, len(sizes) // 2, len(sizes)]), sum(sizes) // 2)
        ranges, shards = sharding.Ranges([(i, 0, s, 1, s) for i, s in enumerate(sizes)]), 24
        best = ranges.smallest(False, shards)
        starts = ranges.even(best, shards)
        got = [sum(sizes[i:j]) for i, j in zip([0, *starts], [*starts, len(sizes)], strict=True)]
        assert len(got) == min(shards, len(sizes)) and max(got) <= best and min(got) > 0 and sum(got) == sum(sizes)
        if len(sizes) >= 3000:
            assert sorted(got)[-2] < 1.1 * sum(sorted(got)[:-1]) / 23


@pytest.mark.parametrize("skew", [False, True])
def test_sharding_leaves_no_shard_empty(spark, skew):
    docs = spark.range(2000).selectExpr("id as doc_id", f"if({skew} and id % 3 = 0, 'one text', concat('text no ', id)) as text")
    sizes = {r.shard: r.s for r in sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    others = sorted(sizes.values())[: 23 if skew else 24]
    assert len(sizes) == 24 and others[-1] < 1.25 * others[1]


@pytest.mark.parametrize("bits", [1, 14])
def test_sharding(odd, odd_rows, clashing, monkeypatch, bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    got = sharding.shard_documents(clashing if bits == 1 else odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    where = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        where[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard is None and r.law == "bytes"
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_the_optimum_for_whole_groups(odd, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MAX_RANGES", 4)
    groups = odd.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"))
    sizes = [r.size for r in groups.orderBy("h").collect()]
    for shards in (1, 2, 5, 24):
        assert sharding.find_cuts(groups, shards)[1] == sharding.Ranges([(i, 0, s, 1, s) for i, s in enumerate(sizes)]).smallest(False, shards)


def test_shards_of_the_query_against_brute_force(spark):
    """The query's shards are contiguous in hash order, whole groups, and no larger than the least capacity that any contiguous cut reaches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sharding.shard_documents(docs).join(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "doc_id").orderBy("h").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.h, []).append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values())
    order = [g[0].shard for g in groups.values()]
    assert order == sorted(order) and set(order) == set(range(24))
    sizes = [sum(r["size"] for r in g) for g in groups.values()]
    ends = [0, *itertools.accumulate(sizes)]
    best = [0, *[float("inf")] * len(sizes)]  # least possible maximum over the first j groups, by dynamic programming over shards
    for _ in range(24):
        best = [0, *[min(max(best[i], ends[j] - ends[i]) for i in range(j)) for j in range(1, len(ends))]]
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert sharding.find_cuts(spark.createDataFrame(list(zip(groups, sizes)), "h long, size long"))[1] == best[-1] and max(load.values()) <= best[-1]


def test_slots_do_not_depend_on_settings(spark, odd):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(((r.shard, r.slot, r.doc_id, r.text_crc32) for r in sharding.shard_documents(odd.repartition(int(n) // 40 + 1)).collect()), key=repr))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sharding_empty(empty):
    assert sharding.shard_documents(empty).count() == 0


def filled(sizes, weights, share=Fraction(3, 2), most=2):
    """Targets by repeating what the contract says: by weight, what is above ``most`` times a size is shared again."""
    out, left = {}, share * sum(sizes)
    while open_ := [i for i in range(len(sizes)) if i not in out]:
        part = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = [i for i in open_ if part[i] > most * sizes[i]]
        out |= {i: Fraction(most * sizes[i]) for i in full} if full else part
        left -= sum(out[i] for i in full)
    return [out[i] for i in range(len(sizes))]


def test_targets_fill_like_water(spark):
    rng = random.Random(5)
    for case in range(6):
        n = (1, 2, 5, 12, 40, 25)[case]
        sizes = [rng.choice([0, rng.randrange(1, 10), rng.randrange(1, 10_000), rng.randrange(1, 1 << 40)]) for _ in range(n)]
        rows = spark.createDataFrame([(f"={i:03}", s) for i, s in enumerate(sizes)] + [(f"={i:03}", 0) for i in range(n)], "key string, size long")
        weights = [(5, 2, 1), (1,), (3, 7)][case % 3]
        got = source_targets(rows, weights).orderBy("key").collect()
        want = filled(sizes, [weights[i % len(weights)] for i in range(n)])
        for r, size, target in zip(got, sizes, want, strict=True):
            assert (r.rows, r.source_size) == (2, size) and r.target == pytest.approx(float(target), rel=1e-14)
            assert r.whole == (int(target) // size if size else 0) and r.rest == int(target) - r.whole * size


def test_mix(odd, odd_rows, clashing):
    got = mix(odd).collect()
    assert rows_of(mix(clashing)) == sorted(map(tuple, got), key=repr)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in odd_rows)
    source = {i: s for i, _, _, s, _ in odd_rows if i is not None} | {None: None}
    totals, taken, target = Counter(), Counter(), {}
    for r in got:
        totals[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r["size"]
    assert all(r.source_size == totals[source[r.doc_id]] for r in got)
    by_id = Counter()
    for r in got:
        by_id[r.doc_id] += r["size"]
    largest = {s: max(by_id[r.doc_id] for r in got if source[r.doc_id] == s) for s in totals}
    assert all(abs(target[s] - taken[s]) <= largest[s] / 2 + 1 for s in totals)
    repeated = Counter((r.doc_id, r.text) for r in repeat_mixed(odd).collect())
    times = {r.doc_id: r.repeats for r in got}
    assert repeated == Counter({(i, t): times[i] * k for (i, t), k in Counter((i, t) for i, t, *_ in odd_rows).items() if times[i]})
    assert repeat_mixed(clashing).columns == clashing.columns and repeat_mixed(clashing).count() == sum(repeated.values())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mix_comes_near_its_targets(spark, sf):
    """By half of a source's boundary document at most: with the sources' own documents, the bound holds for the largest."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most / 2 + 1


def test_mix_is_nested(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "case when id % 3 = 0 then 'a' else 'b' end as source")
    small = {r.doc_id for r in mix(docs, share=(1, 4)).where("taken > 0").collect()}
    large = {r.doc_id for r in mix(docs, share=(1, 2)).where("taken > 0").collect()}
    assert small < large


def test_mix_empty(empty):
    assert mix(empty).count() == 0


def brute_contamination(docs, items, window=10):
    pats = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            pats[tuple(w[i : i + window])].update([] if item is None else [str(item)])
    out = []
    for i, t in docs:
        w, hit, ids = words_of(t), set(), set()
        for k in {len(p) for p in pats}:
            for j in range(len(w) - k + 1):
                if (owners := pats.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    ids |= owners
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark, odd, odd_rows, clashing):
    long = odd_rows[21][1]
    items = [(1, " ".join(long.split()[5:40])), (2, " ".join(long.split()[20:30]).upper()), (10, "a"), (3, None), (4, "!?"), (5, "zug zug"), (5, "zug zug"), (6, " ".join(odd_rows[-6][1].split()[:15])), (None, "it s")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("__words", F.lit(1))
    want = brute_contamination([r[:2] for r in odd_rows], items)
    assert rows_of(contamination(odd, bench)) == want
    assert rows_of(contamination(clashing, bench)) == want
    clean = {r.doc_id for r in drop_contaminated(odd, bench).collect()}
    assert clean == {r[0] for r in want if not r[5]}
    left = drop_contaminated(clashing, bench)
    assert left.columns == clashing.columns and Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in want if not r[5])
    assert {r["__hits"] for r in left.collect()} == {1} and drop_contaminated(clashing.limit(0), bench).count() == 0


def test_contamination_in_parts(spark, odd, odd_rows, clashing, monkeypatch):
    """Many passes find what one does, and write hits only."""
    from palimpsest.llm import decontaminate

    long = odd_rows[21][1].split()
    items = [(i, " ".join(long[i : i + 12])) for i in range(0, 30, 3)] + [(None, odd_rows[20][1]), (77, "a"), (78, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination([r[:2] for r in odd_rows], items)
    written = []
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    assert rows_of(contamination(odd, bench)) == want and not written
    for n in (100, 1):
        assert rows_of(contamination(odd, bench, part_bytes=n)) == want
    assert len(written) > 10 and {c for df in written for c in df.columns} == {"digest", "hits", "items"}
    clean = Counter(r[0] for r in want if not r[5])
    left = drop_contaminated(clashing, bench, part_bytes=100)
    assert left.columns == clashing.columns and Counter(r.doc_id for r in left.collect()) == clean
    assert Counter(r.doc_id for r in drop_contaminated(clashing, bench).collect()) == clean


def test_contamination_empty(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd, bench).where("contaminated or n_items > 0").count() == 0
    assert contamination(empty, bench).count() == 0


def test_wu_manber_finds_what_find_finds():
    import numpy as np

    rng = random.Random(1)
    for _ in range(40):
        text = bytes(rng.choice(b"ab ") for _ in range(3000))
        pats = sorted({text[i : i + n] for i, n in ((rng.randrange(2900), rng.choice([3, 5, 9, 26, 60])) for _ in range(20))})
        low = min(map(len, pats))
        group = PatternGroup(pats, 2 if low < 8 else 4)
        data = np.frombuffer(text, np.uint8)
        want = {(m.start(), k) for k, p in enumerate(pats) for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
        assert set(group.search(data, _loads(data), text)) == want


def test_searcher_shift_skips():
    s = Searcher([(1, " ".join(f"word{i}" for i in range(30)))])
    assert s.groups[0][0].shift.max() > 20


def test_licenses(odd, odd_rows, clashing, spark, empty):
    assert rows_of(scan_licenses(odd)) == rows_of(scan_licenses(clashing))
    assert scan_licenses(odd).where("n_known > 0").count() == 0 and scan_licenses(odd).count() == len(odd_rows)
    assert scan_licenses(empty).count() == 0
    texts = [
        ("Licensed under the Apache License, Version 2.0.\nyou may not use this file except in compliance with the License.", "Apache-2.0", "", 2),
        ("Intro text here. RELEASED UNDER THE MIT LICENSE! More.\nAll rights reserved.", "MIT,LicenseRef-All-Rights-Reserved", "", 2),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later", "", 2),
        ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "MIT,CC-BY-NC-4.0", "", 2),
        ("this program is free software. Something between. you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "", "gpl_free,gpl3_terms", 2),
        ("Released under the MIT License.\nReleased under the MIT License.\nReleased under the MIT License.", "MIT", "", 3),
        ("We are released under the MIT License.", "", "", 0),
    ]
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.unmatched, r.n_known) for r in scan_licenses(docs).collect()}
    assert got == {i: t[1:] for i, t in enumerate(texts)}
    assert all(set(body) <= set(SENTENCES.values()) for _, body in RULES)


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licenses_wrapped(spark):
    commented = lambda text, mark: "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())
    mit, bsd = "mit_grant mit_notice mit_warranty", "bsd_head bsd_source bsd_binary bsd_name"
    texts = [
        (MIT, f"- {mit} -", "MIT"),
        (MIT.replace("\n", "\r\n"), f"- {mit} -", "MIT"),
        *[(commented(MIT, mark), f"- {mit} -", "MIT") for mark in ("#", " *", "//", ";;", "--")],
        ("/*\n" + commented(BSD, " *") + " */\nint x;\n", f"{bsd} -", "BSD-3-Clause"),
        (ISC, "isc_grant", "ISC"),
        (GPL, "gpl_free gpl3_terms", "GPL-3.0-or-later"),
        (BSD, bsd, "BSD-3-Clause"),
        (" ".join(BSD.split()), bsd, "BSD-3-Clause"),
        (BSD[: BSD.index("3. ")], "bsd_head bsd_source bsd_binary", "BSD-2-Clause"),
        *[(BSD.replace("1. ", a).replace("2. ", b).replace("3. ", c), bsd, "BSD-3-Clause") for a, b, c in [("(a) ", "(b) ", "(c) "), ("1) ", "2) ", "3) "), ("* ", "* ", "* ")]],
        ("Intro without an end\nReleased under the MIT License\nmore", "- mit -", "MIT"),
        ("This project is\nlicensed under the MIT License.", "mit", "MIT"),
        ("Licensed under the GNU General Public License, version\n3. Other words.", "gpl3 -", "GPL-3.0-only"),
        ("Licensed under\n\nthe MIT License", "-", ""),
        ("1. Words.\n2. Words.", "-", ""),
        ("A.\nAll rights reserved.", "- reserved", "LicenseRef-All-Rights-Reserved"),
        ("Copyright (c) 2001, Some One. All rights reserved.\n\n" + BSD, f"- reserved {bsd}", "BSD-3-Clause"),
        ("***\n", "-", ""),
        (".\n \n", "", ""),
    ]
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in scan_licenses(docs).collect()}
    assert got == {i: t[1:] for i, t in enumerate(texts)}


#: Public notices as their authors recommend them, or their first lines, and the licences that they stand for.
NOTICES = [
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
    (" * SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "GPL-2.0-only WITH Linux-syscall-note,BSD-3-Clause"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT,Apache-2.0"),
    ("/* SPDX-License-Identifier: LGPL-2.1+ */", "LGPL-2.1-or-later"),
    ("// SPDX-License-Identifier: GPL-2.0+\n// SPDX-License-Identifier: GPL-2.0", "GPL-2.0-or-later,GPL-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n", "GPL-2.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "AGPL-3.0-or-later"),
    ("Foo Bar is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("//          Copyright Joe Coder 2004 - 2006.\n// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt or copy at\n//          https://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ("To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide. This software is distributed without any warranty.", "CC0-1.0"),
    ("To the extent possible under law, Jane Q. Doe has waived all copyright and related or neighboring rights to This Work.", "CC0-1.0"),
    (" * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n", "EPL-2.0"),
    ("Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file\ndistributed with this work for additional information\nregarding copyright ownership.  The ASF licenses this file\nto you under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.  You may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    (BSD.replace("the copyright holder", "Google Inc."), "BSD-3-Clause"),
    (BSD.replace("Neither the name of the copyright holder nor the names of its\n   contributors", "The name of the author").replace("may be", "may not be"), "BSD-3-Clause"),
    (BSD.replace("Neither the name of the copyright holder nor the names of its\n   contributors", "Neither the names of"), "BSD-2-Clause"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("SPDX-License-Identifier: NONE", ""),
    ("the tag SPDX-License-Identifier: is followed by more", "is"),
    ("Neither the name of " + "very " * 20 + "long names nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ""),
]


def oracle_rows(rows):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    cursor = con.execute(license_oracle())
    at = [[c[0] for c in cursor.description].index(c) for c in ("doc_id", "n_known", "sentence_ids", "licenses", "unmatched")]
    return sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_public_notices(spark):
    commented = lambda text, mark: "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())
    forms = [(f(t), want) for t, want in NOTICES for f in (lambda t: t, lambda t: commented(t, "#"), lambda t: commented(t, " *"), lambda t: t.replace("\n", "\r\n"))]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert [(forms[i][0], got[i]) for i in range(len(forms)) if got[i] != forms[i][1]] == []


def test_sql_has_the_operators_own_rule(spark, odd, odd_rows):
    rng = random.Random(9)
    parts = [t for t, _ in NOTICES] + [MIT, ISC, GPL, BSD, "Some words.", "1. A list (b) of: marks;", "é. ñ!", "..", "All rights reserved", "version\n3. x", "ſpdx K License"]
    texts = []
    for _ in range(300):
        words = rng.choice([" ", "\n", "\n\n", ". "]).join(rng.sample(parts, rng.randrange(1, 4))).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            words.insert(rng.randrange(len(words)), rng.choice(["\n", "word", "\n# ", "(a)", "-", "x.", ":"]))
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, r[1]) for i, r in enumerate(odd_rows)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_known", "sentence_ids", "licenses", "unmatched")
    assert rows_of(got) == oracle_rows(rows)


def test_long_pieces_and_many_lines(spark):
    """No pattern's depth grows with a text, be it one line or very many."""
    long = ["license " + "words of one line " * 100_000, "software\n" * 100_000, "license\n" + " \n" * 100_000 + "x", "license. " * 50_000, "1. license\n" * 50_000, "Foo is free software, " * 50_000, "license " + "é" * 500_000, "/" * 300_000 + " license"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long)] + [(100, long[0] + "\nReleased under the MIT License.\n")], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in scan_licenses(docs).collect()}
    assert got == {**{i: ("-", "") for i in range(len(long))}, 100: ("- mit", "MIT")}
