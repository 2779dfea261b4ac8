"""Source divergence against the definition, computed with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rows_of = lambda df: sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def brute(rows, least_docs, top=50):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            ranked = lambda x: sorted(x, key=lambda r: (-r[1], r[0].encode()))
            pairs = ranked((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s)
            terms = ranked((t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("least_docs", [1, 3, 1000])
def test_odd_rows(odd, odd_rows, clashing, empty, least_docs):
    want = brute(odd_rows, least_docs)
    assert rows_of(D.source_divergence(odd, least_docs)) == want
    assert rows_of(D.source_divergence(clashing, least_docs)) == want
    assert {r[2] for r in want} == ({"pair"} if least_docs == 1000 else {"pair", "term"})
    assert D.source_divergence(empty, least_docs).collect() == []


def test_ties_zeros_and_ranks(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "de", None])
        words = [rng.choice("aábBCcdéEfg") * rng.randrange(1, 4) for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words) if i % 40 else None, lang, rng.choice(["s", "t", "ü", "Z", "z", None, ""]), 0))
    rows += [(300, "", "xx", "only", 0), (301, None, "yy", "a", 0), (302, "1 2 3", "yy", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least, top in ((1, 3), (10, 50), (200, 50)):
        assert rows_of(D.source_divergence(docs, least, top)) == brute(rows, least, top)


def test_shares_of_counts_beyond_64_bits(spark):
    n, total, terms = 4 * 10**18 // 7, 4 * 10**18, 10**6
    row = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)


def test_joins_on_the_language_are_dealt_out(spark):
    many, few = spark.range(1000).selectExpr("'en' as lang", "id as term"), spark.createDataFrame([("en", "a"), ("en", "b"), ("de", "c")], "lang string, source string")
    joined = D.salted_join(many, few, "lang", "term")
    assert joined.count() == 2000 and joined.distinct().count() == 2000
    assert joined.columns == ["lang", "term", "source"]
