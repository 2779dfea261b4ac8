"""Replacement plans: one row of fake values per file, from seeded choices."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.labels import degrees, hemisphere, point
from palimpsest.functions.seeded import chosen_sql, hash32, listed, picked_sql, quoted, shuffled_sql, whole, whole_sql
from palimpsest.functions.types import media_class
from palimpsest.operators.pools import POOLS, Pools
from palimpsest.settings import Settings

REQUIRED = ("dateTime", "make", "model", "software", "imageDescription", "userComment", "photographicSensitivity", "exposureTime", "fNumber", "focalLength", "whiteBalance", "flash")
PLACE = ("latitude", "longitude", "latitudeRef", "longitudeRef")
MEDIA = ("title", "artist", "album", "genre", "trackNumber", "year", "mediaDate")
PDF = ("author", "creator", "producer", "pdfTitle", "subject", "keywords")
FIELDS = (*REQUIRED, *PLACE, *MEDIA, *PDF)
PLAN_TYPE = T.StructType([T.StructField(f, T.DoubleType() if f in PLACE[:2] else T.StringType()) for f in FIELDS])

#: Steps of 1e-4 degrees in which places are drawn, and of 1e-6 degrees by which a known place is moved.
LATITUDE, LONGITUDE, NEAR = 800_000, 1_700_000, (2_000, 10_000)


def _date(s: Settings, field: str, hours: tuple[int, int], iso: bool) -> str:
    """A moment of this and the three calendar years before, days up to 28; never after ``now_ms``."""
    part = lambda name, low, high: f"cast({whole_sql(s.seed, 'uri', f'{field}.{name}', low, high)} as string)"
    two = lambda *p: f"lpad({part(*p)}, 2, '0')"
    day = (part("year", s.now_year - 3, s.now_year + 1), two("month", 1, 13), two("day", 1, 29))
    time = (two("hour", *hours), two("minute", 0, 60), two("second", 0, 60))
    if iso:
        moment = f"concat({', '.join(day)}, 'T', {', '.join(time)}, '.000Z')"
    else:
        moment = f"concat(concat_ws(':', {', '.join(day)}), ' ', concat_ws(':', {', '.join(time)}))"
    return f"least({moment}, {quoted(now_text(s, iso))})"


def now_text(s: Settings, iso: bool) -> str:
    """The settings' time (UTC) as media or images write it."""
    return datetime.fromtimestamp(s.now_ms // 1000, UTC).strftime("%Y%m%dT%H%M%S.000Z" if iso else "%Y:%m:%d %H:%M:%S")


def nearby(seed: str, key: Column, degrees: Column, field: str) -> Column:
    """A known coordinate moved by 0.002 to 0.01 degrees either way."""
    offset = whole(seed, key, f"{field}.offset", *NEAR) / F.lit(1_000_000.0)
    return degrees + offset * F.when(hash32(seed, key, f"{field}.sign") % 2 == 0, 1).otherwise(-1)


def _place(s: Settings, key: Column, field: str, half: int, known: Column) -> Column:
    free = whole(s.seed, key, field, -half, half) / F.lit(10_000.0)
    return F.coalesce(nearby(s.seed, key, known, field), free)


def generate_plans(files: DataFrame, settings: Settings | None = None, pools: Pools = POOLS, latitude: Column | None = None, longitude: Column | None = None, make: Column | None = None) -> DataFrame:
    """(uri, mime_type, FIELDS) for every row of ``files`` (uri, mime_type).

    Every plan has the image fields; audio, video and PDF types have theirs besides, others are null. With a known
    ``latitude`` and ``longitude`` (columns of ``files``) the place is near it. ``make`` is a column of makers to keep; one that the pools
    don't have gets their other models and software. A row depends on the seed, its uri and these.
    """
    s = settings or Settings()
    pick = lambda field, options: picked_sql(s.seed, "uri", field, options)
    table = lambda lists: f"map({', '.join(f'{quoted(m)}, {listed(v)}' for m, v in lists.items())})"
    of_make = lambda field, lists, others: f"coalesce({chosen_sql(s.seed, 'uri', field, f'try_element_at({table(lists)}, make)')}, {pick(field, others)})"
    by_kind = lambda **of: f"CASE __kind {' '.join(f'WHEN {quoted(k)} THEN {c}' for k, c in of.items())} END"
    subject, place, hour, remark = (pick(f, o) for f, o in (("scene", pools.subjects), ("location", pools.places), ("hour", pools.hours), ("comment", pools.remarks)))
    before = lambda years: f"cast({s.now_year} - {whole_sql(s.seed, 'uri', 'year', 0, years)} as string)"
    date = _date(s, "mediaDate", (0, 24), iso=True)
    columns = {
        "dateTime": _date(s, "dateTime", (6, 23), iso=False),
        "make": "make",
        "model": of_make("model", pools.models, pools.other_models),
        "software": of_make("software", pools.software, pools.other_software),
        "imageDescription": f"CASE {whole_sql(s.seed, 'uri', 'imageDescription', 0, 3)} WHEN 0 THEN concat({subject}, ', ', {place}) WHEN 1 THEN concat_ws(' ', {place}, {hour}) ELSE concat_ws(' ', {subject}, {hour}) END",
        "userComment": remark,
        "photographicSensitivity": pick("iso", pools.iso), "exposureTime": pick("exposure", pools.exposure), "fNumber": pick("aperture", pools.aperture),
        "focalLength": pick("focal", pools.focal), "whiteBalance": pick("balance", pools.balance), "flash": pick("flash", pools.flash),
        "latitudeRef": "null", "longitudeRef": "null",
        "title": by_kind(audio=pick("title", pools.audio_titles), video=pick("title", pools.video_titles)),
        "artist": by_kind(audio=pick("artist", pools.audio_artists), video=pick("artist", pools.video_directors)),
        "album": by_kind(audio=pick("album", pools.audio_albums)),
        "genre": by_kind(audio=pick("genre", pools.audio_genres), video=pick("genre", pools.video_genres)),
        "trackNumber": by_kind(audio=f"cast({whole_sql(s.seed, 'uri', 'track', 1, 15)} as string)"),
        "year": by_kind(audio=before(5), video=before(10)),
        "mediaDate": by_kind(audio=date, video=date),
        "author": by_kind(pdf=pick("author", pools.authors)), "creator": by_kind(pdf=pick("creator", pools.pdf_tools)),
        "producer": by_kind(pdf=pick("producer", pools.pdf_tools)), "pdfTitle": by_kind(pdf=pick("pdfTitle", pools.pdf_titles)),
        "subject": by_kind(pdf=quoted(pools.subject)),
        "keywords": by_kind(pdf=f"array_join(slice({shuffled_sql(s.seed, 'uri', 'keywords', pools.keywords)}, 1, 3), ', ')"),
    }
    places = {"latitude": _place(s, F.col("uri"), "latitude", LATITUDE, F.col("__latitude")), "longitude": _place(s, F.col("uri"), "longitude", LONGITUDE, F.col("__longitude"))}
    none = F.lit(None).cast("double")
    both = F.lit(False) if latitude is None or longitude is None else latitude.isNotNull() & longitude.isNotNull()
    known = [none if c is None else F.when(both, c) for c in (latitude, longitude)]
    makes = F.expr(pick("make", pools.makes))
    makes = makes if make is None else F.coalesce(make, makes)
    plans = files.select("uri", "mime_type", media_class(F.col("mime_type")).alias("__kind"), makes.alias("make"), known[0].alias("__latitude"), known[1].alias("__longitude"))
    plans = plans.select("uri", "mime_type", *[places[f].alias(f) if f in places else F.expr(f"{columns[f]} as {f}") for f in FIELDS])
    return plans.withColumns({"latitudeRef": hemisphere(F.col("latitude"), "N", "S"), "longitudeRef": hemisphere(F.col("longitude"), "E", "W")}).select("uri", "mime_type", *FIELDS)


def known_places(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(uri, latitude, longitude) of the image and media files whose metadata say where they were taken; of repeated keys the last counts."""
    of = lambda key: F.max_by("value", F.when(F.col("key") == key, F.col("entry_ord")))
    keys = ("GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "Location")
    held = attributes.where(F.col("key").isin(*keys)).groupBy("uri").agg(*[of(k).alias(k) for k in keys])
    kind = media_class(F.col("mime_type"))
    side = lambda name, which: F.when(kind == "image", degrees(F.col(f"GPS{name}"), F.col(f"GPS{name}Ref"))).when(kind.isin("video", "audio"), point(F.col("Location"), which))
    found = files.select("uri", "mime_type").join(held, "uri").select("uri", side("Latitude", 1).alias("latitude"), side("Longitude", 2).alias("longitude"))
    return found.where("latitude is not null and longitude is not null")


def plans_near(files: DataFrame, attributes: DataFrame, settings: Settings | None = None, pools: Pools = POOLS) -> DataFrame:
    """:func:`generate_plans`; with the option ``use_nearby_scramble``, places near those that the files' metadata name."""
    if not (settings or Settings()).use_nearby_scramble:
        return generate_plans(files, settings, pools)
    known = known_places(files, attributes).withColumnsRenamed({"latitude": "__known_lat", "longitude": "__known_lon"})
    placed = files.select("uri", "mime_type").join(known, "uri", "left")
    return generate_plans(placed, settings, pools, latitude=F.col("__known_lat"), longitude=F.col("__known_lon"))


def update_locations(plans: DataFrame, edits: DataFrame, files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``plans`` with the places of ``edits`` (uri, latitude, longitude); a file of ``files`` without a plan gets one first.

    Edits of files that aren't there do nothing; of repeated edits of a file the one with the largest place counts.
    """
    missing = files.join(plans.select("uri"), "uri", "left_anti").join(edits.select("uri").distinct(), "uri", "left_semi")
    every = plans.unionByName(generate_plans(missing.select("uri", "mime_type"), settings))
    last = edits.groupBy("uri").agg(F.max(F.struct("latitude", "longitude")).alias("__edit"))
    joined = every.join(last, "uri", "left")
    lat, lon = F.coalesce("__edit.latitude", "latitude"), F.coalesce("__edit.longitude", "longitude")
    moved = joined.withColumns({"latitude": lat, "longitude": lon}).withColumns({"latitudeRef": hemisphere(F.col("latitude"), "N", "S"), "longitudeRef": hemisphere(F.col("longitude"), "E", "W")})
    return moved.select("uri", "mime_type", *FIELDS)


def require_plans(files: DataFrame, plans: DataFrame, strict: bool = True) -> DataFrame:
    """``files`` joined with their plans as a column plan. A file without one is an error (``strict``) or has status and error columns."""
    nested = plans.select("uri", F.struct(*FIELDS).alias("plan"))
    joined = files.join(nested, "uri", "left")
    message = F.concat(F.lit("no replacement plan for "), F.coalesce("uri", F.lit("null")))
    if strict:
        return joined.withColumn("plan", F.when(F.col("plan").isNull(), F.raise_error(message).cast(PLAN_TYPE)).otherwise(F.col("plan")))
    return joined.withColumns({"status": F.when(F.col("plan").isNull(), "error").otherwise("ok"), "error": F.when(F.col("plan").isNull(), message)})


def plans_to_json(plans: DataFrame) -> DataFrame:
    """(uri, json): each plan as one JSON object; null fields are left out."""
    return plans.select("uri", F.to_json(F.struct("mime_type", *FIELDS)).alias("json"))


def plans_from_json(stored: DataFrame) -> DataFrame:
    """The plans of (uri, json). A row that is no plan is left out, so a damaged store yields fewer plans, not an error."""
    kind = T.StructType([T.StructField("mime_type", T.StringType()), *PLAN_TYPE.fields])
    read = stored.select("uri", F.from_json("json", kind, {"mode": "PERMISSIVE"}).alias("p")).where("p.make is not null")
    return read.select("uri", "p.*").select("uri", "mime_type", *FIELDS)
