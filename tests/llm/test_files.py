"""WARC archives, token files, chat formatting, pipeline."""

import gzip
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import blocks as B
from palimpsest.llm import token_output as T
from palimpsest.llm import warc as W
from palimpsest.llm.chat import crossed_pairs, format_pairs, format_preferences
from palimpsest.llm.queries import tokenizer_path
from palimpsest.storage import new_path

rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
PAGES = [(1, "http://a/1", "x" * 2000), (2, "http://a/2\r\nX: y", "x" * 2000), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\n" * 200_000), (None, "u", "x" * 2000), (8, "u", "WARC/1.1\r\n\r\n" * 100), (8, "u", "WARC/1.1\r\n\r\n" * 100)]


def want_pages():
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = max((p for p, _, g in PAGES if (g or "") == (h or "") and p is not None), default=None)
        revisit = len(raw) >= 1000 and first != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_warc_round_trip(pages):
    assert rows_of(W.warc_round_trip(pages)) == want_pages()
    assert rows_of(W.warc_round_trip(pages.withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("x")).withColumn("chunk_no", F.lit(9)))) == want_pages()


def test_warc_chunks(spark, pages):
    folder = new_path(spark, "warc-test")
    manifest = W.write_warc(pages, folder, chunk_bytes=1000, file_bytes=300).collect()
    files = spark.createDataFrame(manifest)
    assert len(manifest) > 2 and sum(r.records for r in manifest) == len(PAGES)
    chunks = W.read_warc(files, folder, chunk_bytes=777).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: (r.record_id, r.chunk_no)):
        assert len(r.data or b"") <= 777
        if r.record_type == "response" and r.record_id != "8":
            whole[r.record_id] = whole.get(r.record_id, b"") + r.data
            assert r.sha1_so_far == hashlib.sha1(whole[r.record_id]).hexdigest() and r.bytes_so_far == len(whole[r.record_id])
    assert whole["7"] == PAGES[6][2].encode() and whole["5"] == b"" and set(whole) == {"2", "3", "4", "5", "6", "7"}


def test_payloads_of_revisits_stay_where_they_are(spark, monkeypatch):
    """The part that most rows go through has no exchange; what the filters get wrong is put right."""
    rows = [(i, "u", "y" * 1000 + str(i % 40)) for i in range(300)] + [(1000 + i, "u", "z" * 1000 + str(i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bits in (1 << 25, 64):
        monkeypatch.setattr(B, "FILTER_BITS", bits)
        large, revisits = W.find_revisits(pages)
        sure, doubted = W.responses(pages, large, revisits)
        assert "Exchange" not in sure._jdf.queryExecution().executedPlan().toString()
        assert revisits.count() == 260 and "html" not in revisits.columns
        kept = [r.page_id for part in (sure, doubted) for r in part.collect()]
        assert sorted(kept) == [*range(260, 300), *range(1000, 1300)]
        assert (bits > 64) == (len(doubted.collect()) == 0)


def test_warc_is_plain_warc(spark, pages):
    folder = new_path(spark, "warc-test")
    (first, *_) = W.write_warc(pages.where("page_id = 3").coalesce(1), folder).where("records > 0").collect()
    raw = gzip.decompress(open(first.file, "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"x" * 999 + b"\r\n\r\n")


def test_damaged_warc_is_an_error(spark, pages):
    folder = new_path(spark, "warc-test")
    (first, *_) = W.write_warc(pages.where("page_id = 7").coalesce(1), folder).where("records > 0").collect()
    raw = open(first.file, "rb").read()
    with pytest.raises(ValueError, match="truncated"):
        list(W.read_records(io.BytesIO(raw[: len(raw) // 2]), 1000, True))
    other = gzip.compress(gzip.decompress(raw).replace("é".encode(), "è".encode(), 1))
    with pytest.raises(ValueError, match="digest"):
        list(W.read_records(io.BytesIO(other), 1000, True))


def test_warc_empty(spark, pages):
    assert W.warc_round_trip(pages.limit(0)).count() == 0


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_is_exact(odd_rows):
    rng = np.random.default_rng(3)
    alphabet = list("ab' \n\t.,é 　​1") + [" s", "'s", "  ", "\r\n", "<|endoftext|>", " the", "漢字", "🙂"]
    texts = [r[1] for r in odd_rows] + ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(4000)]
    e = T.Encoder(tokenizer_path())
    got = [np.frombuffer(x, "<u2").tolist() for a in range(0, len(texts), 97) for x in e.encode([t or "" for t in texts[a : a + 97]])]
    assert got == encode(texts)


def test_token_round_trip(odd, odd_rows, clashing):
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [x + [0] for x in encode([r[1] for r in order])]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = T.token_round_trip(odd, tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((o[0], len(x), crc(x)) for o, x in zip(order, ids))
    assert rows_of(T.token_round_trip(clashing, tokenizer_path())) == sorted(map(tuple, got), key=repr)


def thue_morse(letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(4096))


def test_token_round_trip_of_constructed_texts(spark):
    """Texts that every polynomial hash modulo a power of two confuses, in one partition."""
    texts = [f"{'x' * 9}{thue_morse(ab)}{'y' * 9}" for ab in ("ab", "ba")]
    texts += [" ".join(texts), " ".join(texts[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for x in encode(texts)]
    assert [r.ids_crc32 for r in T.token_round_trip(docs, tokenizer_path()).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("group", [64, 1 << 21])
def test_pieces_of_one_hash_are_told_apart(odd_rows, monkeypatch, group):
    monkeypatch.setattr(T, "GROUP_BYTES", group)
    monkeypatch.setattr(T, "run_hashes", lambda data, load, starts, ends, key: (ends - starts).astype(np.uint64) % np.uint64(7))
    encoder = T.Encoder(tokenizer_path())
    texts = [r[1] or "" for r in odd_rows][:40]
    assert encoder.encode(texts) == encoder.whole(texts)


def test_token_files_give_single_documents(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('document number ', id, ' has ', repeat('some more words ', cast(id % 9 as int))) as text")
    folder = new_path(spark, "ids-test")
    manifest, dictionary = T.write_ids(docs, folder, tokenizer_path(), file_bytes=500)
    files = manifest.orderBy("part", "number").collect()
    assert len(files) > 4 and sum(f.docs for f in files) == 300
    fs, _ = pafs.FileSystem.from_uri(folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for f in files[:3]:
        with fs.open_input_file(f.file) as stream:
            reader = T.FileReader(stream, dictionary)
            i = len(reader.doc_ids) - 1
            assert reader.ids(i).tolist() == encode([texts[reader.doc_ids[i]]])[0] + [0]
    with fs.open_input_file(files[0].file) as stream, pytest.raises(ValueError, match="another dictionary"):
        T.FileReader(stream, dictionary + b"x")


def test_tokens_empty(empty):
    assert T.token_round_trip(empty, tokenizer_path()).count() == 0


def test_dictionary_helps_short_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = T.train_dictionary(docs, tokenizer_path())
    assert d
    import zstandard

    short = T.Encoder(tokenizer_path()).encode([r.text for r in docs.where("n_chars between 50 and 1000").limit(100).collect()])
    plain, shared = zstandard.ZstdCompressor(3), zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(d))
    assert sum(len(shared.compress(x)) for x in short) < 0.95 * sum(len(plain.compress(x)) for x in short)


TURN = "pair_id long, turn long, role string, text string"


def test_preferences(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (3, 1, None, None), (3, 0, "user", ""), (None, 0, "user", "lost"), (5, 0, "user", "q"), (5, 1, "assistant", "same")], TURN)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (4, 0, "user", "only here"), (3, 0, "user", ""), (5, 0, "user", "q"), (5, 1, "assistant", "same")], TURN)
    got = {r.pair_id: r for r in format_preferences(chosen.withColumn("a", F.lit(1)), rejected).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    r = got[1]
    assert (r.n_common, r.prompt) == (1, "<|im_start|>user\nhi<|im_end|>\n")
    assert (r.chosen, r.rejected) == ("<|im_start|>assistant\ngood<|im_end|>\n", "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\nwhy<|im_end|>\n")
    assert (r.chosen_mask, r.rejected_mask) == ("22:0,15:1", "22:0,14:1,17:0,14:0")
    assert sum(int(x.split(":")[0]) for x in r.rejected_mask.split(",")) == len(r.rejected)
    assert (got[2].n_common, got[2].prompt, got[2].rejected, got[2].rejected_mask) == (0, "", "", "")
    assert (got[3].n_common, got[3].chosen, got[3].rejected) == (1, "<|im_start|>\n<|im_end|>\n", "")
    assert got[4].chosen == "" and got[4].rejected
    assert (got[5].n_common, got[5].chosen, got[5].rejected) == (2, "", "")


def test_preferences_of_empty_tables(spark):
    none = spark.createDataFrame([], TURN)
    assert format_preferences(none, none).count() == 0


def test_crossed_pairs_against_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(c, int(k), ["user", "assistant", "system"][rng.integers(3)], f"t{rng.integers(3)}") for c in range(60) if c % 7 for k in range(rng.integers(1, 7))]
    rows += [(100, 0, None, None), (100, None, "user", "first"), (101, 0, "", ""), (101, 1, "user", "x" * 100_000), (200, 0, "user", "alone"), (200, 0, "user", "alone"), (-3, 0, "assistant", None), (None, 0, "user", "i")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = {}
    for i, k, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        if i is not None:
            turns.setdefault(i, []).append((r or "", t or ""))
    show = lambda x: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in x)
    want = {}
    for i, a in turns.items():
        keep = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % (len(a) + 1)
        b = a[:keep] + turns.get(i ^ 1, [])[keep:]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        want[i] = (n, show(a[:n]), show(a[n:]), show(b[n:]))
    clashing = c.withColumns({"a": F.lit(1), "b": F.lit(2), "turns": F.lit(3), "both": F.lit(4), "pair_id": F.lit(5), "keep": F.lit(6)})
    for table in (c, clashing):
        assert {r.pair_id: (r.n_common, r.prompt, r.chosen, r.rejected) for r in format_pairs(crossed_pairs(table)).collect()} == want
    early = [i for i, a in turns.items() if want[i][0] < len(a) - 1]
    assert len(early) > 10 and crossed_pairs(c.limit(0)).count() == 0


def test_pipeline_against_its_parts(spark):
    """Each stage of the pipeline against a plain version over its own input."""
    import corpus_pipeline as P
    from test_join_quality import brute
    from test_row_operators import brute_contamination

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("extra", F.lit(1))
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    kept = []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == P.COLUMNS
        kept.append(docs.collect())
        docs = spark.createDataFrame(kept[-1], docs.schema)
    ids = [[r.doc_id for r in k] for k in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert sum(labels.get(i) == 1 for i in ids[0]) >= 0.97 * sum(labels.values())
    assert set(ids[1]) == {a for a, _, c in brute([(r.doc_id, r.text) for r in kept[0]], 5, 8, 10) if a == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert set(ids[2]) == {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in kept[1]], bench) if not r[5]}
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 2
    assert abs(words(kept[3]) - 1.5 * words(kept[2])) < 0.15 * words(kept[2])
    last = P.STAGES[-1][1](spark, docs, d).collect()
    assert sorted(r.doc_id for r in last) == sorted(ids[3])
    assert Counter(r.n_tokens for r in last) == Counter(len(x) + 1 for x in encode([r.text for r in kept[3]]))


def test_pipeline_stages_on_odd_tables(spark, odd, odd_rows, clashing, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns of any name, empty tables: each stage against a plain version."""
    import corpus_pipeline as P
    from test_join_quality import brute
    from test_row_operators import brute_contamination

    d = str(tmp_path)
    long = odd_rows[21][1].split()
    items = [(1, " ".join(long[5:40])), (None, "it s"), (3, None)]
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/none/benchmark.parquet")
    plain = Counter(tuple(r) for r in odd_rows)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, odd, d)
        assert got.columns == P.COLUMNS
        rows = Counter(map(tuple, got.collect()))
        assert rows == Counter(map(tuple, stage(spark, clashing, d).collect()))
        assert set(rows) <= set(plain)
        nothing = stage(spark, empty, d)
        assert nothing.columns == P.COLUMNS and nothing.count() == 0
        if name == "quality_classifier":
            assert all(rows[r] in (0, plain[r]) for r in plain)
            assert stage(spark, odd, f"{d}/none").count() == sum(plain.values())
        elif name == "ngram_jaccard_join":
            # one row of each group, the one with the smallest id; all rows without words
            want = Counter(c for d_, n, c in brute([r[:2] for r in odd_rows], 5, 8, 10) if n)
            wordless = Counter(r for r in odd_rows if not (r[1] or "").split())
            assert Counter(r[0] for r in (rows - wordless).elements()) == Counter(dict.fromkeys(want, 1)) and not wordless - rows
        elif name == "benchmark_decontamination":
            hit = {i for i, *_, c in brute_contamination([(k, r[1]) for k, r in enumerate(odd_rows)], items) if c}
            assert rows == Counter(r for k, r in enumerate(odd_rows) if k not in hit) and hit
            assert stage(spark, odd, f"{d}/none").count() == sum(plain.values())
        else:
            assert all(rows[r] <= 2 * plain[r] for r in plain)
    last = P.STAGES[-1][1]
    assert last(spark, empty, d).count() == 0
    assert rows_of(last(spark, odd, d)) == rows_of(last(spark, clashing, d)) and last(spark, odd, d).count() == len(odd_rows)
