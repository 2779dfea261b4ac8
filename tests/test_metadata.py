"""Reading, stripping, replacing, comparing, planning, routing."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import tags
from palimpsest.operators import metadata as md
from palimpsest.operators import output, selection
from palimpsest.operators.plans import FIELDS, MEDIA, PDF, REQUIRED, generate_plans, known_places, plans_from_json, plans_near, plans_to_json, require_plans, update_locations
from palimpsest.operators.pools import POOLS
from palimpsest.settings import Settings, read_settings

ATTRS = "uri string, entry_ord int, key string, value string"
FILES = "uri string, mime_type string"
rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("i", "image/png"), ("bare", "image/jpeg"), ("v", "video/mp4"), ("a", "audio/mpeg"), ("p", "application/pdf"), ("t", "text/plain"), ("n", None)], FILES)


@pytest.fixture(scope="module")
def attrs(spark):
    rows = [("i", 1, "Make", "First"), ("i", 2, "Make", "Second"), ("i", 3, "Artist", " "), ("i", 4, "MakerNote", "secret"), ("i", 5, "Orientation", "6"), ("i", 6, "ImageWidth", "10"), ("i", 7, "JPEGInterchangeFormat", "4711"),
            ("i", 8, "GPSDateStamp", "2020"), ("v", 1, "HasVideo", "yes"), ("v", 2, "Width", "4"), ("v", 3, "Height", "3"), ("v", 4, "DurationMs", "2500"), ("v", 5, "Location", "+1-1/"), ("a", 1, "Title", "song"),
            ("a", 2, "HasVideo", "no"), ("a", 3, "Width", "4"), ("a", 4, "Height", "3"), ("p", 1, "Author", "me"), ("p", 2, "PageCount", "3"), ("p", 3, "Xmp", "x"), ("t", 1, "Make", "no image")]
    return spark.createDataFrame(rows, ATTRS)


@pytest.fixture(scope="module")
def plans(files):
    return generate_plans(files)


def by_uri(df):
    out = {}
    for r in df.orderBy("uri", "entry_ord").collect():
        out.setdefault(r.uri, []).append((r.key, r.value))
    return out


def test_entries(spark, files, attrs):
    got = by_uri(md.metadata_entries(files, attrs, spark.createDataFrame([("bare", "broken")], "uri string, error string")))
    assert [k for k, _ in got["i"]] == ["ImageWidth", "Make", "Make", "Orientation", "GPSDateStamp"]
    assert sorted(got["i"]) == [("GPSDateStamp", "2020"), ("ImageWidth", "10"), ("Make", "First"), ("Make", "Second"), ("Orientation", "6")]
    assert got["bare"] == [("Error", "Could not read metadata: broken")]
    assert got["v"] == [("Location (Raw)", "+1-1/"), ("Resolution", "4x3"), ("Duration", "2s")]
    assert got["a"] == [("Title", "song")]
    assert got["p"] == [("Page Count", "3"), ("Author", "me")]
    assert got["t"] == [("Info", "Metadata preview not yet supported for text/plain")] and got["n"] == [("Info", "Metadata preview not yet supported for ")]
    assert by_uri(md.metadata_entries(files, attrs))["bare"] == [("Info", tags.NO_EXIF)]


def test_strip(files, attrs):
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(md.strip_image(files, attrs)) == ["ImageWidth", "Orientation"]
    assert keys(md.strip_image(files, attrs, keep_orientation=False, thumbnail="KEEP_ORIGINAL")) == ["ImageWidth", "JPEGInterchangeFormat"]
    assert keys(md.strip_image(files, attrs, strict=False)) == ["ImageWidth", "MakerNote", "Orientation"]
    assert keys(md.strip_pdf(files, attrs)) == ["PageCount"] and keys(md.strip_pdf(files, attrs, strict=False)) == ["PageCount", "Xmp"]
    assert keys(md.strip_media(files, attrs)) == sorted(["HasVideo", "Width", "Height", "DurationMs", "HasVideo", "Width", "Height"])


def test_strip_is_idempotent_and_leaves_no_listed_tag(files, attrs):
    once = md.strip_image(files, attrs)
    assert rows_of(md.strip_image(files, once)) == rows_of(once)
    assert not {r.key for r in md.strip_image(files, attrs, strict=False).collect()} & set(tags.PRIVACY_TAGS)


def test_poison(files, attrs, plans):
    plan = {r.uri: r for r in plans.collect()}
    image = dict(by_uri(md.poison_image(files, attrs, plans))["i"])
    assert image["Make"] == plan["i"].make and image["DateTimeDigitized"] == plan["i"].dateTime and "MakerNote" not in image and "GPSDateStamp" not in image
    listed = dict(by_uri(md.poison_image(files, attrs, plans, strict=False))["i"])
    assert listed["GPSDateStamp"] == "2020" and listed["MakerNote"] == "secret" and "Artist" not in listed
    assert dict(by_uri(md.poison_pdf(files, attrs, plans))["p"])["Author"] == plan["p"].author
    media = dict(by_uri(md.poison_media(files, attrs, plans))["v"])
    assert re.fullmatch(r"[+-]\d+\.\d{4}[+-]\d+\.\d{4}/", media["Location"]) and "Title" not in media
    assert abs(float(re.match(r"[+-]\d+\.\d+", media["Location"])[0]) - plan["v"].latitude) < 1e-3
    assert md.leak_audit(attrs.where("uri = 'i'"), md.poison_image(files, attrs, plans)).count() == 0
    assert {r.key for r in md.leak_audit(attrs.where("uri = 'i'"), md.poison_image(files, attrs, plans, strict=False)).collect()} == {"MakerNote", "GPSDateStamp"}


def test_last_and_first(attrs):
    assert by_uri(md.last_wins(attrs.where("uri = 'i' and key = 'Make'")))["i"] == [("Make", "Second")]
    assert [tuple(r) for r in md.first_match(attrs, "Make").where("uri = 'i'").collect()] == [("i", "First")]


def test_diff(spark):
    old = spark.createDataFrame([("u", 1, "same", "1"), ("u", 2, "old", "2"), ("u", 3, "other", "3")], ATTRS)
    new = spark.createDataFrame([("u", 1, "other", "4"), ("u", 2, "same", "1"), ("u", 3, "new", "5"), ("w", 1, "x", "y")], ATTRS)
    got = [tuple(r) for r in md.diff(old, new).orderBy("uri", "entry_ord").select("uri", "key", "change_kind", "value").collect()]
    assert got == [("u", "same", "UNCHANGED", "[UNCHANGED] 1"), ("u", "old", "UNCHANGED", "[UNCHANGED] 2"), ("u", "other", "CHANGED", "[CHANGED] 3  →  4"), ("u", "new", "ADDED", "[ADDED] 5"), ("w", "x", "ADDED", "[ADDED] y")]


PAIRS = st.lists(st.tuples(st.sampled_from("uv"), st.sampled_from("abcd"), st.sampled_from("12")), max_size=12, unique_by=lambda t: t[:2])


@settings(max_examples=15, deadline=None)
@given(PAIRS, PAIRS)
def test_diff_splits_the_union_of_keys(spark, a, b):
    frame = lambda x: spark.createDataFrame([(u, i, k, v) for i, (u, k, v) in enumerate(x)], ATTRS)
    got = {(r.uri, r.key): r for r in md.diff(frame(a), frame(b)).collect()}
    old, new = {(u, k): v for u, k, v in a}, {(u, k): v for u, k, v in b}
    assert set(got) == set(old) | set(new)
    for k, r in got.items():
        want = "ADDED" if k not in old else "UNCHANGED" if k not in new or old[k] == new[k] else "CHANGED"
        assert (r.change_kind, r.old_value, r.new_value) == (want, old.get(k), new.get(k))


def test_previews(files, attrs, plans):
    strict = dict(by_uri(md.remove_preview(files, attrs))["i"])
    assert strict["ImageWidth"] == "10" and strict["Orientation"] == "6" and strict["GPSDateStamp"] == "2020  →  [REMOVED]"
    assert dict(by_uri(md.remove_preview(files, attrs, strict=False))["p"])["Page Count"] == "3  →  [REMOVED]"
    assert by_uri(md.remove_preview(files, attrs.where("uri <> 'v'")))["v"] == [("Info", tags.NOTHING_TO_REMOVE)]
    shown = by_uri(md.poison_preview(files, attrs, plans.where("uri <> 'p'"), strict=False))
    assert shown["p"] == [("Info", tags.NO_PLAN)]
    image = dict(shown["i"])
    assert image["Orientation"] == "[UNCHANGED] 6" and image["Make"].startswith("[CHANGED] Second") and image["Model"].startswith("[ADDED] ")
    assert "Album" in dict(shown["a"]) and "Album" not in dict(shown["v"]) and "Director" in dict(shown["v"])


def test_plans(plans, files):
    plan = {r.uri: r.asDict() for r in plans.collect()}
    for p in plan.values():
        assert all(p[f] for f in REQUIRED)
        assert re.fullmatch(r"\d{4}:\d{2}:\d{2} (0[6-9]|1\d|2[0-2]):\d{2}:\d{2}", p["dateTime"]) and 2020 <= int(p["dateTime"][:4]) <= 2023
        assert -80 <= p["latitude"] < 80 and -170 <= p["longitude"] < 170
        assert p["latitudeRef"] == ("N" if p["latitude"] >= 0 else "S") and p["longitudeRef"] == ("E" if p["longitude"] >= 0 else "W")
    assert all(plan["a"][f] for f in MEDIA) and not any(plan["a"][f] for f in PDF)
    assert plan["v"]["album"] is None and plan["v"]["trackNumber"] is None and re.fullmatch(r"\d{8}T\d{6}\.000Z", plan["v"]["mediaDate"])
    assert all(plan["p"][f] for f in PDF) and len(set(plan["p"]["keywords"].split(", "))) == 3
    assert not any(plan["i"][f] for f in (*MEDIA, *PDF)) and not any(plan["n"][f] for f in (*MEDIA, *PDF))
    assert rows_of(generate_plans(files.repartition(5))) == rows_of(plans)
    assert rows_of(generate_plans(files, Settings(seed="1"))) != rows_of(plans)


def test_known_places_move_a_little(spark):
    f = spark.createDataFrame([(str(i), "image/png", 10.0 if i % 2 else None, 20.0) for i in range(200)], FILES + ", lat double, lon double")
    for r in generate_plans(f, latitude=F.col("lat"), longitude=F.col("lon")).collect():
        if int(r.uri) % 2:
            assert 0.00199 < abs(r.latitude - 10) < 0.01001 and 0.00199 < abs(r.longitude - 20) < 0.01001
        else:
            assert abs(r.longitude - 20) > 0.0101 or abs(r.latitude - 10) > 0.0101


def test_locations_are_set_and_missing_plans_made(spark, files, plans):
    edits = spark.createDataFrame([("i", -1.0, -2.0), ("p", 3.0, 4.0), ("ghost", 5.0, 6.0)], "uri string, latitude double, longitude double")
    got = {r.uri: r for r in update_locations(plans.where("uri <> 'p'"), edits, files).collect()}
    assert (got["i"].latitude, got["i"].latitudeRef, got["i"].longitudeRef) == (-1.0, "S", "W")
    assert got["p"].longitude == 4.0 and got["p"].author and "ghost" not in got and len(got) == 7


def test_required_plans(files, plans):
    some = plans.where("uri = 'i'")
    loose = {r.uri: (r.status, r.error) for r in require_plans(files, some, strict=False).collect()}
    assert loose["i"] == ("ok", None) and loose["p"] == ("error", "no replacement plan for p")
    with pytest.raises(Exception, match="no replacement plan"):
        require_plans(files, some).collect()
    assert require_plans(files.where("uri = 'i'"), some).first().plan.make


def test_plan_store(spark, plans):
    stored = plans_to_json(plans)
    assert rows_of(plans_from_json(stored)) == rows_of(plans.select("uri", "mime_type", *FIELDS))
    damaged = spark.createDataFrame([("x", "{"), ("y", None), ("z", "[]")], "uri string, json string")
    assert plans_from_json(damaged).count() == 0


def test_selection(spark):
    f = spark.createDataFrame([("a", 2, "image/png", None), ("b", 1, "image/png", 5), ("a", 1, None, 7)], "uri string, file_ord int, mime_type string, size_bytes long")
    assert rows_of(selection.distinct_uris(f)) == [("a", 1, None, 7), ("b", 1, "image/png", 5)] or rows_of(selection.distinct_uris(f))[1][0] == "b"
    assert tuple(selection.selection_summary(f).first()) == (3, 12) and tuple(selection.selection_summary(f.limit(0)).first()) == (0, 0)
    assert [r.uri for r in selection.remove_from_selection(f, spark.createDataFrame([("a",), ("a",)], "uri string")).collect()] == ["b"]
    kinds = lambda *m: spark.createDataFrame([(1, x) for x in m], "g int, mime_type string")
    assert selection.share_mime(kinds("x/y", "x/y"), "g").first().mime_type == "x/y"
    for odd in (("x/y", "x/z"), ("x/y", None), (None, None)):
        assert selection.share_mime(kinds(*odd), "g").first().mime_type == "*/*"
    r = spark.createDataFrame([("ok", "o"), ("error", None), ("ok", "p")], "status string, output_path string")
    assert tuple(selection.job_progress(r).first()) == (2, 1, 3, 66) and tuple(selection.job_progress(r.limit(0)).first()) == (0, 0, 0, 0)
    assert tuple(selection.saved_message(r, where=" to custom folder").first()) == (2, "Saved 2 file(s) to custom folder")
    assert tuple(selection.saved_message(r.where("output_path is null")).first()) == (0, "Failed to save files") and tuple(selection.saved_message(r.limit(0)).first()) == (0, None)
    assert selection.share_action(f).first().action == "SEND_MULTIPLE" and selection.share_signature(f.where("file_ord = 1 or uri = 'a'")).first().signature == "a|b|a"


def test_languages(spark):
    known = spark.createDataFrame([("en", "ENGLISH", 1), ("en", "OTHER", 2)], "code string, language string, language_ord int")
    assert rows_of(selection.language_of(spark.createDataFrame([("en",), ("xx",), (None,)], "code string"), known)) == sorted([("en", "ENGLISH"), ("xx", "SYSTEM"), (None, "SYSTEM")], key=repr)


def test_routes(spark, files):
    got = {r.uri: (r.relative_path, r.sink, r.collection) for r in output.route(files).collect()}
    assert got["i"] == ("Pictures/Processed", "media", "Images") and got["v"][0] == "Movies/Processed" and got["a"] == ("Music/Processed", "media", "Downloads") and got["n"][0] == "Documents/Processed"
    one = {r.uri: (r.configured_path, r.sub_path, r.relative_path, r.sink) for r in output.route(files, Settings(folder_structure="UNIFIED", unified_saving_path="content://t/")).collect()}
    assert one["p"] == ("content://t/", "Documents", "content://t/Documents", "tree")
    flat = output.route(files, Settings(folder_structure="UNIFIED", use_subfolders_in_unified=False, unified_saving_path=None)).first()
    assert (flat.configured_path, flat.sub_path, flat.relative_path) == (None, None, "Download/Processed")


def test_names_are_made_unique(spark):
    f = spark.createDataFrame([("u1", "a.png", "d"), ("u2", "a.png", "d"), ("u3", "a.png", "e"), ("u4", "b", "d"), ("u5", "b", "d")], "uri string, display_name string, relative_path string")
    named = output.name_outputs(f)
    assert rows_of(output.collisions(named)) == [("d", "a_processed.png", 2, "u1"), ("d", "b_processed", 2, "u4")]
    unique = output.unique_names(named)
    names = {r.uri: r.output_name for r in unique.collect()}
    assert (names["u1"], names["u3"], names["u4"]) == ("a_processed.png", "a_processed.png", "b_processed")
    assert re.fullmatch(r"a_processed_[0-9a-f]{16}\.png", names["u2"]) and re.fullmatch(r"b_processed_[0-9a-f]{16}", names["u5"])
    assert output.collisions(unique).count() == 0
    hidden = output.name_outputs(f, Settings(use_random_file_names=True))
    assert output.collisions(hidden).count() == 0


def test_strict_previews_show_what_replacing_does(spark, files, attrs, plans):
    plan = {r.uri: r for r in plans.collect()}
    shown = {k: dict(v) for k, v in by_uri(md.poison_preview(files, attrs, plans.where("uri <> 'p'"))).items()}
    assert shown["p"] == {"Info": tags.NO_PLAN} and "t" not in shown and "n" not in shown
    assert shown["i"]["GPSDateStamp"] == "2020  →  [REMOVED]" and shown["i"]["Orientation"] == "[UNCHANGED] 6" and "Info" not in shown["bare"]
    assert shown["v"]["Location (Raw)"].startswith("[CHANGED] +1-1/  →  ") and not {"Title", "Director", "Location"} & set(shown["v"])
    assert shown["a"]["Title"] == "song  →  [REMOVED]"
    # a preview is the difference of what is shown before and after
    for kind, apply in (("image", md.poison_image), ("audio", md.poison_media), ("application", md.poison_pdf)):
        some = files.where(f"mime_type like '{kind}/%'")
        old, new = md.metadata_entries(some, attrs).where("entry_ord > 0"), md.metadata_entries(some, apply(some, attrs, plans)).where("entry_ord > 0")
        want = {(r.uri, r.key, r.old_value, r.new_value) for r in md.diff(old, new).collect()}
        assert {(r.uri, r.key, r.old_value, r.new_value) for r in md.poison_preview(some, attrs, plans).collect()} == want
    assert plan["p"].subject == {r.key: r.new_value for r in md.poison_preview(files, attrs, plans).where("uri = 'p'").collect()}["Subject"]


def test_known_places(spark):
    files = spark.createDataFrame([(u, m) for u, m in (("i", "image/png"), ("j", "image/png"), ("k", "image/png"), ("v", "video/mp4"), ("w", "video/mp4"), ("p", "application/pdf"))], FILES)
    rows = [("i", "GPSLatitude", "45/1,30/1,0/1"), ("i", "GPSLatitudeRef", "S"), ("i", "GPSLongitude", "7.25"), ("i", "GPSLongitudeRef", "E"), ("j", "GPSLatitude", "1/0,0/1,0/1"), ("j", "GPSLongitude", "1/1,0/1,0/1"),
            ("k", "GPSLatitude", "5/1,0/1,0/1"), ("v", "Location", "+1.5-2.25+10/"), ("w", "Location", "nowhere"), ("p", "GPSLatitude", "1"), ("p", "GPSLongitude", "1")]
    attrs = spark.createDataFrame([(u, i, k, v) for i, (u, k, v) in enumerate(rows)], ATTRS)
    assert rows_of(known_places(files, attrs)) == [("i", -45.5, 7.25), ("v", 1.5, -2.25)]
    near = {r.uri: r for r in plans_near(files, attrs, Settings(use_nearby_scramble=True)).collect()}
    assert 0.0019 < abs(near["i"].latitude + 45.5) < 0.011 and near["i"].latitudeRef == "S" and 0.0019 < abs(near["v"].longitude + 2.25) < 0.011
    assert rows_of(plans_near(files, attrs)) == rows_of(generate_plans(files))


def test_dates_are_never_after_now(spark):
    files = spark.range(3000).select(F.col("id").cast("string").alias("uri"), F.lit("video/mp4").alias("mime_type"))
    s = Settings(now_ms=1_672_600_000_000)  # 2023-01-01 19:06:40
    got = generate_plans(files, s).agg(F.max("dateTime"), F.max("mediaDate"), F.count(F.when(F.col("dateTime") == "2023:01:01 19:06:40", 1))).first()
    assert got[0] == "2023:01:01 19:06:40" and got[1] == "20230101T190640.000Z" and got[2] > 300


def test_unknown_makers_get_other_models(spark):
    files = spark.createDataFrame([("a", "image/png", "Canon"), ("b", "image/png", "Nobody"), ("c", "image/png", None)], FILES + ", maker string")
    got = {r.uri: r for r in generate_plans(files, make=F.col("maker")).collect()}
    assert got["a"].model in POOLS.models["Canon"] and got["b"].make == "Nobody" and got["b"].model in POOLS.other_models and got["b"].software in POOLS.other_software
    assert got["c"].make in POOLS.makes and got["c"].model in POOLS.models[got["c"].make]


def test_saved_uris_and_first_files(spark):
    r = spark.createDataFrame([(1, 2, "b"), (1, 1, "c"), (1, 3, None), (2, 1, None)], "g int, file_ord int, output_path string")
    assert rows_of(selection.saved_uris(r, "g")) == [(1, 2, ["c", "b"]), (2, 0, [])]
    f = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (1, 1, "y"), (2, 7, "q")], "g int, file_ord int, uri string")
    assert rows_of(selection.first_file(f, "g")) == [(1, "y"), (2, "q")]


def test_settings(spark):
    stored = spark.createDataFrame([("a", "default_saving_path", "Old"), ("a", "folder_structure", "nonsense"), ("a", "oled_mode", "true"), ("a", "pictures_saving_path", "Mine"), ("b", "x", "y")], "profile string, key string, value string")
    got = {(r.profile, r.option): r.value for r in read_settings(stored).collect()}
    assert len(got) == 44
    assert (got["a", "unified_saving_path"], got["a", "pictures_saving_path"], got["a", "music_saving_path"]) == ("Old", "Mine", "Music/Processed")
    assert (got["a", "folder_structure"], got["a", "oled_mode"], got["b", "oled_mode"], got["b", "shared_files_custom_path"]) == ("SPLIT", "true", "false", None)


def test_tracks_and_annotations(spark):
    t = spark.createDataFrame([([("video/avc",), ("text/x",), ("audio/aac",)],)], "t array<struct<mime:string>>")
    assert [x.mime for x in t.select(md.keep_tracks(F.col("t")).alias("k")).first().k] == ["video/avc", "audio/aac"]
    with pytest.raises(Exception, match="no usable track"):
        t.select(md.keep_tracks(F.filter("t", lambda x: x["mime"] == "text/x"))).collect()
    a = spark.createDataFrame([([("Link", None), ("Stamp", None), (None, "Watermark"), ("Watermark", "x"), (None, None)],)], "a array<struct<subtype:string,intent:string>>")
    assert [tuple(x) for x in a.select(md.keep_annotations(F.col("a")).alias("k")).first().k] == [("Link", None), (None, None)]


def small_places(spark):
    """Files whose plans draw coordinates within 0.001 of zero: latitudes 0.0002 and 0.0003 for images, longitude -0.0003 for a video."""
    files = spark.createDataFrame([("content://docs/549641", "image/png"), ("content://docs/579650", "image/heic"), ("content://docs/67700", "video/mp4")], FILES)
    return files, spark.createDataFrame([("content://docs/549641", 1, "GPSLatitude", "45/1,30/1,0/1")], ATTRS), generate_plans(files)


def test_small_coordinates_in_previews(spark):
    got = {(r.uri, r.key): (r.change_kind, r.new_value, r.value) for r in md.poison_preview(*small_places(spark), strict=False).collect()}
    assert got["content://docs/549641", "GPSLatitude"] == ("CHANGED", "0.0002", f"[CHANGED] 45/1,30/1,0/1{tags.ARROW}0.0002")
    assert got["content://docs/579650", "GPSLatitude"] == ("ADDED", "0.0003", "[ADDED] 0.0003")
    assert got["content://docs/67700", "Location"] == ("ADDED", "-0.303, -0.0003", "[ADDED] -0.303, -0.0003")


def test_small_coordinates_in_strict_previews(spark):
    got = {(r.uri, r.key): (r.change_kind, r.new_value, r.value) for r in md.poison_preview(*small_places(spark)).collect()}
    assert got["content://docs/549641", "GPSLatitude"] == ("CHANGED", "0.0002", f"[CHANGED] 45/1,30/1,0/1{tags.ARROW}0.0002")
    assert got["content://docs/579650", "GPSLatitude"] == ("ADDED", "0.0003", "[ADDED] 0.0003")


def test_small_coordinates_in_replaced_images(spark):
    got = {r.uri: r.value for r in md.poison_image(*small_places(spark)).where("key = 'GPSLatitude'").collect()}
    assert got == {"content://docs/549641": "0.0002", "content://docs/579650": "0.0003"}


def test_small_coordinates_in_listed_images(spark):
    got = {r.uri: r.value for r in md.poison_image(*small_places(spark), strict=False).where("key = 'GPSLatitude'").collect()}
    assert got == {"content://docs/549641": "0.0002", "content://docs/579650": "0.0003"}
