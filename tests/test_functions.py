"""Names, types, labels and seeded choices."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import functions as fn
from palimpsest import tags
from palimpsest.functions import labels, seeded
from palimpsest.operators.pools import MAKERS, POOLS

NOW = 1234


def run(spark, values, column, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


NAMES = {
    "../../../etc/passwd": "passwd", r"C:\Windows\System32\cmd.exe": "cmd.exe", "my file!@#$%^&*().jpg": "my_file__________.jpg", None: "unknown_1234", "   ": "unknown_1234",
    ".bashrc": "file_1234_.bashrc", "...": "file_1234", "folder/../folder2/filename.txt": "filename.txt", "a/b/": "b", "a\\": "file_1234", "///": "file_1234", "..": "file_1234",
    "emoji😀.png": "emoji_.png", "é.jpg": "_.jpg", "a.b.tar.gz": "a.b.tar.gz", "noext": "noext", "\t\n": "unknown_1234", " ": "unknown_1234", " ": "unknown_1234", "a\nb.txt": "a_b.txt", "": "unknown_1234",
}


def test_sanitize_filename(spark):
    assert run(spark, list(NAMES), fn.sanitize_filename(F.col("x"), NOW)) == list(NAMES.values())


def test_sanitize_simple(spark):
    assert run(spark, ["my-prefix!", "a b/c", ""], fn.sanitize_simple(F.col("x"))) == ["my-prefix_", "a_b_c", ""]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=50))
def test_names_are_always_safe(spark, names):
    for name in run(spark, names, fn.sanitize_filename(F.col("x"), NOW)):
        assert re.fullmatch(r"[a-zA-Z0-9_-][a-zA-Z0-9._-]*", name)


def test_output_name(spark):
    assert run(spark, ["photo.png", "noext", ".hidden", "a.b.c", "x y.j g"], fn.output_name(F.col("x"), "PRE_", "_POST")) == ["PRE_photo_POST.png", "PRE_noext_POST", "PRE_.hidden_POST", "PRE_a.b_POST.c", "PRE_x_y_POST.j_g"]


def test_random_names_are_unique_and_repeatable(spark):
    df = spark.range(20_000).select(fn.output_name(F.lit("test.jpg"), random=fn.random_base(F.col("id").cast("string"), "s", NOW)).alias("n"))
    assert df.distinct().count() == 20_000
    assert df.where(~F.col("n").rlike(r"^file_1234_[0-9a-f]{16}\.jpg$")).count() == 0
    assert sorted(r.n for r in df.repartition(7).limit(50).collect()) != []


def test_types(spark):
    mimes = ["image/jpeg", "image/heif", "image/x", "video/mp4", "video/x", "audio/x-m4a", "application/pdf", "application/pdfx", "text/plain", None, "IMAGE/PNG"]
    assert run(spark, mimes, fn.media_class(F.col("x"))) == ["image", "image", "image", "video", "video", "audio", "pdf", "other", "other", "other", "other"]
    assert run(spark, mimes, fn.extension_from_mime(F.col("x"))) == [".jpg", ".heic", ".bin", ".mp4", ".bin", ".m4a", ".pdf", ".bin", ".bin", ".bin", ".bin"]
    uris = ["content://a/b.PNG?x=1.z#q", "http://host.com", "http://host.com/a.b/c", "c.tar.GZ", "nothing", "a.", None]
    assert run(spark, uris, fn.extension_from_uri(F.col("x"))) == [".png", "", ".b/c", ".gz", "", ".", ""]
    assert run(spark, ["content://x", "http:x", "none", None], fn.uri_scheme(F.col("x"))) == ["content", "http", None, None]


def test_labels(spark):
    assert run(spark, [0, 1023, 1024, 1536, 1048576, 10485760], fn.size_label(F.col("x")), "x long") == ["0 Bytes", "1023 Bytes", "1.0 KB", "1.5 KB", "1.0 MB", "10.0 MB"]
    assert run(spark, ["1999", "x", None, "-1500", "99999999999999999999", " 5"], fn.duration_label(F.col("x"))) == ["1s", "0s", "0s", "-1s", "0s", "0s"]
    assert run(spark, [0.0, -0.5, 3.0], fn.hemisphere(F.col("x"), "N", "S"), "x double") == ["N", "S", "N"]
    assert run(spark, ["1.5", "abc", None, "1e3"], fn.parse_double(F.col("x"))) == [1.5, None, None, 1000.0]
    assert run(spark, [1.5], fn.location_text(F.col("x"), F.col("x")), "x double") == ["1.5, 1.5"]
    assert run(spark, ["1920", None], fn.resolution_label(F.col("x"), F.lit("3"))) == ["1920x3", None]


def test_coordinates_are_plain_numbers(spark):
    numbers = [0.0, 0.0005, -0.0001, 0.0009, 0.00123, 0.001, -12.3456, 180.0, -1.25e-5, 1.5e-12, None]
    want = ["0.0", "0.0005", "-0.0001", "0.0009", "0.00123", "0.001", "-12.3456", "180.0", "-0.0000125", "0.0000000000015", None]
    assert run(spark, numbers, labels.plain(F.col("x")), "x double") == want
    assert run(spark, numbers, F.expr(labels.plain_sql("x")), "x double") == want
    assert run(spark, ["7/1,30/1,1/2", None], F.expr(labels.plain_sql("x"))) == ["7/1,30/1,1/2", None]
    assert run(spark, [-0.0003], fn.location_text(F.col("x"), F.lit(0.0004)), "x double") == ["-0.0003, 0.0004"]


def test_choices_are_spread_and_independent(spark):
    df = spark.range(6000).select(fn.picked("s", F.col("id").cast("string"), "f", list("abcde")).alias("a"), fn.picked("s", F.col("id").cast("string"), "g", list("abcde")).alias("b"))
    counts = [r["count"] for r in df.groupBy("a", "b").count().collect()]
    assert len(counts) == 25 and 160 < min(counts) and max(counts) < 330
    order = spark.range(500).select(fn.shuffled("s", F.col("id").cast("string"), "k", list("xyz")).alias("o"))
    assert order.distinct().count() == 6 and order.where("size(array_distinct(o)) < 3").count() == 0
    low = spark.range(2000).select(fn.whole("s", F.col("id").cast("string"), "w", -3, 4).alias("w"))
    assert {r.w for r in low.distinct().collect()} == set(range(-3, 4))


def test_fixed_lists_and_pools():
    assert (len(tags.PREVIEW_TAGS), len(tags.PRIVACY_TAGS), len(tags.LEAK_TAGS), len(tags.IMAGE_TARGETS)) == (30, 53, 7, 18)
    assert len(set(tags.PRIVACY_TAGS)) == 53 and set(tags.LEAK_TAGS) <= set(tags.PRIVACY_TAGS)
    lists = [v for v in vars(POOLS).values() if isinstance(v, tuple)] + [*POOLS.models.values(), *POOLS.software.values()]
    assert all(len(set(v)) == len(v) > 1 and all(x.strip() == x and x for x in v) for v in lists)
    assert POOLS.aperture == ("1.4", "2.0", "2.8", "4.0", "5.6", "8.0", "11", "16") and POOLS.exposure[:3] == ("1/2", "1/4", "1/8")
    assert set(MAKERS) == set(POOLS.models)


@pytest.mark.parametrize("n", [1, 5])
def test_choice_or_error(spark, n):
    from palimpsest.settings import FOLDERS, choice_or, choice_or_error

    assert run(spark, ["UNIFIED", "x", None], choice_or(F.col("x"), FOLDERS, "SPLIT")) == ["UNIFIED", "SPLIT", "SPLIT"]
    with pytest.raises(Exception, match="no such folder"):
        run(spark, ["x"] * n, choice_or_error(F.col("x"), FOLDERS, "folder"))


def test_choices_as_text_are_those_on_columns(spark):
    odd = ["it's", 'a "b"', "back\\slash\\", "${x} %s", "ü 文", ""]
    seed, key, field = "s'1\\", F.col("id").cast("string"), "f'"
    rows = spark.range(300).withColumn("k", F.when(F.col("id") > 0, key))
    pairs = [
        (seeded.hash32(seed, F.col("k"), field), seeded.hash32_sql(seed, "k", field)),
        (seeded.whole(seed, F.col("k"), field, -5, 9), seeded.whole_sql(seed, "k", field, -5, 9)),
        (seeded.picked(seed, F.col("k"), field, odd), seeded.picked_sql(seed, "k", field, odd)),
        (seeded.chosen(seed, F.col("k"), field, F.array(*map(F.lit, odd))), seeded.chosen_sql(seed, "k", field, seeded.listed(odd))),
        (seeded.shuffled(seed, F.col("k"), field, odd), seeded.shuffled_sql(seed, "k", field, odd)),
    ]
    agreed = rows.select(*[F.count_if(a.eqNullSafe(F.expr(b))).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    assert list(agreed) == [300] * len(pairs)
