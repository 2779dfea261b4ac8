"""Tracks and samples, extensions by tables, the settings log, sums over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.types import extension_from_mime
from palimpsest.operators import extensions, packing, selection, settings_log, tracks
from palimpsest.settings import read_settings

rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 5, 1000]), rng.randrange(-5, 5)) for i in range(400)]
    rng.shuffle(rows)
    got = packing.running_sums(spark.createDataFrame(rows, "i int, a bigint, b bigint").repartition(6), ("a", "b"), "i")
    assert got.columns == ["i", "a", "b", "a_before", "a_total", "b_before", "b_total"]
    rows.sort()
    a = b = 0
    for r, (_, x, y) in zip(got.orderBy("i").collect(), rows, strict=True):
        assert (r.a_before, r.b_before) == (a, b)
        a, b = a + (x or 0), b + y
    assert (r.a_total, r.b_total) == (a, b)
    assert packing.running_sums(got.select("i", "a", "b").limit(0), ("a",), "i").collect() == []


TRACKS = [("u", 0, "video/mp4"), ("u", 1, None), ("u", 2, "audio/aac"), ("u", 3, "application/mett"), ("v", 5, "audio/aac"), ("w", 0, "text/vtt")]


@pytest.fixture(scope="module")
def track_rows(spark):
    return spark.createDataFrame(TRACKS + TRACKS[:1], "uri string, track int, mime_type string")


def test_track_map(track_rows):
    assert rows_of(tracks.track_map(track_rows)) == [("u", 0, 0), ("u", 2, 1), ("v", 5, 0)]
    assert rows_of(tracks.without_tracks(track_rows)) == [("w", tracks.NO_TRACKS)]
    assert tracks.track_map(track_rows.limit(0)).collect() == []


def test_sample_map_against_one_pass(spark, track_rows):
    """Copying the ranges of old sample bytes gives the bytes of the samples that stay, in order."""
    rng = random.Random(4)
    samples = [(uri, n, rng.choice([t for u, t, _ in TRACKS if u == uri]), rng.choice([0, 1, 2, 7, None]), rng.choice([None, 0, 1, 2, 3, 5])) for uri in "uvw" for n in range(120)]
    table = spark.createDataFrame(samples, "uri string, sample_no int, track int, size_bytes bigint, flags int").repartition(5)
    placed = tracks.sample_map(table, tracks.track_map(track_rows), "sample_no")
    new = {("u", 0): 0, ("u", 2): 1, ("v", 5): 0}
    old_at, new_at, want = {}, {}, []
    media = {u: b"" for u in "uvw"}
    kept = {u: b"" for u in "uvw"}
    for uri, n, track, size, flags in samples:
        data = rng.randbytes(size or 0)
        if (uri, track) in new:
            want.append((uri, n, track, size, flags, new[uri, track], old_at.get(uri, 0), new_at.get(uri, 0), (flags or 0) & 1))
            new_at[uri] = new_at.get(uri, 0) + len(data)
            kept[uri] += data
        old_at[uri] = old_at.get(uri, 0) + len(data)
        media[uri] += data
    got = placed.select("uri", "sample_no", "track", "size_bytes", "flags", "new_track", "old_start", "new_start", "new_flags")
    assert rows_of(got) == sorted(want, key=repr)
    ranges = tracks.copied_ranges(placed).collect()
    out = {u: bytearray(len(b)) for u, b in kept.items()}
    for r in ranges:
        out[r.uri][r.new_start : r.new_start + r.length] = media[r.uri][r.old_start : r.old_start + r.length]
    assert {u: bytes(b) for u, b in out.items()} == kept
    assert sum(r.n_samples for r in ranges) == len(want) and len(ranges) < len(want)
    assert sum(r.n_key_frames for r in ranges) == sum(w[-1] for w in want)


def test_rules_by_prefix_are_the_chain(spark):
    types = ["image/jpeg", "image/jpegx", "image/png", "video/mp4", "audio/mpeg", "application/pdf", "text/plain", "", None, "image"]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(types * 2)], "i int, mime_type string")
    chain = files.select("i", extension_from_mime(F.col("mime_type")).alias("e"))
    table = extensions.by_prefix(files, extensions.fixed_rules(spark))
    pdf = F.when(F.col("mime_type") == "application/pdf", ".pdf").otherwise(".bin")
    assert rows_of(table.select("i", F.coalesce("extension", pdf).alias("e"))) == rows_of(chain)


def test_first_and_longest_prefix(spark):
    rules = spark.createDataFrame([("a", ".1", 3), ("ab", ".2", 5), ("abc", ".3", 4), ("", ".0", 9), ("ab", ".9", 6), (None, ".x", 0)], "prefix string, extension string, rule_ord int")
    files = spark.createDataFrame([("abcd",), ("ab",), ("x",), (None,), ("",)], "mime_type string")
    assert rows_of(extensions.by_prefix(files, rules)) == sorted([("abcd", ".1"), ("ab", ".1"), ("x", ".0"), (None, None), ("", ".0")], key=repr)
    assert rows_of(extensions.by_prefix(files, rules, longest=True)) == sorted([("abcd", ".3"), ("ab", ".2"), ("x", ".0"), (None, None), ("", ".0")], key=repr)


def made_by_joins(df):
    """The most rows that a join of ``df`` makes when it runs."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in name else node.child() if name == "ReusedExchange" else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_many_rules_of_one_prefix_meet_types_once(spark):
    rules = spark.range(300).selectExpr("'a' as prefix", "concat('.', 299 - id) as extension", "cast(id as int) as rule_ord").unionByName(spark.createDataFrame([("ab", ".b", 500)], "prefix string, extension string, rule_ord int"))
    files = spark.range(200).selectExpr("concat('ab', id) as mime_type")
    for longest, extension in ((False, ".299"), (True, ".b")):
        found = extensions.by_prefix(files, rules, longest)
        assert made_by_joins(found) <= 2 * 200
        assert {r.extension for r in found.collect()} == {extension}


def test_prefixes_of_any_length(spark):
    rules = spark.createDataFrame([("x" * 300, ".long", 0), ("x", ".short", 1), ("\U0001f600", ".face", 2)], "prefix string, extension string, rule_ord int")
    files = spark.createDataFrame([("x" * 400,), ("x" * 299,), ("\U0001f600/y",), (None,)], "mime_type string")
    want = sorted([("x" * 400, ".long"), ("x" * 299, ".short"), ("\U0001f600/y", ".face"), (None, None)], key=repr)
    assert rows_of(extensions.by_prefix(files, rules)) == want and rows_of(extensions.by_prefix(files, rules, longest=True)) == want
    assert rows_of(extensions.by_prefix(files, rules.limit(0))) == sorted([(t, None) for t, _ in want], key=repr)


def test_extension_of_known_types(spark):
    files = spark.createDataFrame([("http://h/a.HTM", "text/html"), ("http://h/a.HTM", "x/y"), ("http://h/a", None), ("b.tar.GZ", None)], "uri string, mime_type string")
    got = extensions.extension_of(files, extensions.public_types(spark))
    assert rows_of(got.select("uri", "extension")) == sorted([("http://h/a.HTM", ".html"), ("http://h/a.HTM", ".htm"), ("http://h/a", ""), ("b.tar.GZ", ".gz")])
    public = {r.mime_type: r.extension for r in extensions.public_types(spark).collect()}
    assert public["application/pdf"] == ".pdf" and public["image/png"] == ".png" and len(public) > 80


def test_settings_log(spark, tmp_path):
    log = str(tmp_path / "log")
    edits = lambda *rows: spark.createDataFrame(list(rows), settings_log.EDITS)
    state = lambda upto=None: {(r.profile, r.key): (r.value, r.version) for r in settings_log.current(spark, log, upto).collect()}
    assert state() == {}
    assert settings_log.append_edits(log, edits((1, "language", "DE", 0), (1, "language", "FR", 1), (2, "oled_mode", "true", 0))) == 1
    assert settings_log.append_edits(log, edits((2, "oled_mode", None, 0), (1, "default_suffix", "", 0), (3, "language", "a", 0), (3, "language", "b", 0))) == 2
    want = {(1, "language"): ("FR", 1), (1, "default_suffix"): ("", 2), (3, "language"): ("b", 2)}
    assert state() == want and state(1) == {(1, "language"): ("FR", 1), (2, "oled_mode"): ("true", 1)}
    assert settings_log.compact(spark, log, keep=1) == 2 and state() == want
    assert settings_log.compact(spark, log) == 2 and state() == want  # nothing new: the same state
    assert settings_log.append_edits(log, edits((1, "language", None, 0), (2, "oled_mode", "false", 0))) == 3
    want = {(1, "default_suffix"): ("", 2), (3, "language"): ("b", 2), (2, "oled_mode"): ("false", 3)}
    assert state() == want
    assert settings_log.compact(spark, log) == 3 and state() == want
    options = {(r.profile, r.option): r.value for r in read_settings(settings_log.current(spark, log)).collect()}
    assert options[1, "default_suffix"] == "" and options[2, "oled_mode"] == "false" and options[3, "language"] == "b" and options[3, "default_suffix"] == "_processed"


def test_share_bundles(spark):
    rows = [(1, "b", "image/png", 2), (1, "a", "image/png", 1), (2, "c", None, 1), (3, "d", "x/y", 1), (4, "e", "x/y", 2), (4, "f", None, 1), (5, None, "x/y", 1), (6, "g", "x/y", 1), (6, "h", "z/y", 1)]
    files = spark.createDataFrame(rows, "share int, uri string, mime_type string, file_ord int")
    got = {r.share: (r.action, r.mime_type, r.n_files, r.uris) for r in selection.share_bundles(files, "share").collect()}
    assert got == {
        1: ("SEND_MULTIPLE", "image/png", 2, ["a", "b"]), 2: ("SEND", "*/*", 1, ["c"]), 3: ("SEND", "x/y", 1, ["d"]), 4: ("SEND_MULTIPLE", "*/*", 2, ["f", "e"]), 6: ("SEND_MULTIPLE", "*/*", 2, ["g", "h"]),
    }
    assert selection.share_bundles(files.limit(0), "share").collect() == []
