"""One query per operator of the metadata engine, and the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest import functions as fn
from palimpsest import tags
from palimpsest.functions.types import begins, media_class
from palimpsest.operators import metadata as md
from palimpsest.operators import extensions, incremental, output, packing, selection, settings_log, tracks
from palimpsest.operators.plans import FIELDS, generate_plans, nearby, plans_from_json, plans_near, plans_to_json, require_plans, update_locations
from palimpsest.operators.pools import POOLS
from palimpsest.plans import adapter
from palimpsest.plans.adapter import CTES, attributes, files
from palimpsest.settings import Settings, read_settings
from palimpsest.sources import sinks
from palimpsest.sources.catalog_source import file_catalog
from palimpsest.sources.chunks import chunk_digests, content_chunks, read_chunks
from palimpsest.sources.files import read_attributes, rewrite_files
from palimpsest.storage import local_or_uri, materialize, new_path
from palimpsest.streaming.shares import handle_shares

SETTINGS = Settings()
NOW, SEED, YEAR = SETTINGS.now_ms, SETTINGS.seed, SETTINGS.now_year


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- DuckDB building blocks -------------------------------------------------------------------------------------------

def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(names) -> str:
    return "(" + ", ".join(map(_text, names)) + ")"


def _array(names) -> str:
    return "[" + ", ".join(map(_text, names)) + "]"


CLASS = "CASE WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video' WHEN mime_type LIKE 'audio/%' THEN 'audio' WHEN mime_type = 'application/pdf' THEN 'pdf' ELSE 'other' END"
BLANK = "(value IS NULL OR trim(value) = '')"
WITH = f"WITH {CTES},\nk AS (SELECT *, {CLASS} AS kind FROM files),\na AS (SELECT attrs.*, kind FROM attrs JOIN k USING (uri))"


def _hash(field: str, key: str = "uri") -> str:
    return f"('0x' || substr(md5('{SEED}:' || {key} || ':{field}'), 1, 8))::BIGINT"


def _pick(field: str, options) -> str:
    return f"{_array(options)}[{_hash(field)} % {len(options)} + 1]"


def _range(field: str, low: int, high: int) -> str:
    return f"({_hash(field)} % {high - low} + {low})"


def _two(field: str, low: int, high: int) -> str:
    return f"lpad({_range(field, low, high)}::VARCHAR, 2, '0')"


def _date(field: str, hours: tuple[int, int], iso: bool) -> str:
    parts = [f"{_range(field + '.year', YEAR - 3, YEAR + 1)}::VARCHAR", *[_two(f"{field}.{n}", a, b) for n, a, b in (("month", 1, 13), ("day", 1, 29), ("hour", *hours), ("minute", 0, 60), ("second", 0, 60))]]
    y, mo, d, h, mi, s = parts
    moment = f"{y} || {mo} || {d} || 'T' || {h} || {mi} || {s} || '.000Z'" if iso else f"{y} || ':' || {mo} || ':' || {d} || ' ' || {h} || ':' || {mi} || ':' || {s}"
    return f"least({moment}, strftime(make_timestamp({NOW} * 1000), '{'%Y%m%dT%H%M%S.000Z' if iso else '%Y:%m:%d %H:%M:%S'}'))"


def _by_make(field: str, lists: dict, others) -> str:
    return "CASE make " + " ".join(f"WHEN {_text(m)} THEN {_pick(field, v)}" for m, v in lists.items()) + f" ELSE {_pick(field, others)} END"


def _only(kind: str, e: str) -> str:
    return f"CASE WHEN kind = '{kind}' THEN {e} END"


def _either(field: str, audio, video) -> str:
    return f"CASE kind WHEN 'audio' THEN {_pick(field, audio)} WHEN 'video' THEN {_pick(field, video)} END"


P = POOLS
_SUBJECT, _PLACE, _HOUR = _pick("scene", P.subjects), _pick("location", P.places), _pick("hour", P.hours)
PLAN_SQL = {
    "dateTime": _date("dateTime", (6, 23), False),
    "make": "make",
    "model": _by_make("model", P.models, P.other_models),
    "software": _by_make("software", P.software, P.other_software),
    "imageDescription": f"CASE {_hash('imageDescription')} % 3 WHEN 0 THEN {_SUBJECT} || ', ' || {_PLACE} WHEN 1 THEN {_PLACE} || ' ' || {_HOUR} ELSE {_SUBJECT} || ' ' || {_HOUR} END",
    "userComment": _pick("comment", P.remarks),
    "photographicSensitivity": _pick("iso", P.iso), "exposureTime": _pick("exposure", P.exposure), "fNumber": _pick("aperture", P.aperture),
    "focalLength": _pick("focal", P.focal), "whiteBalance": _pick("balance", P.balance), "flash": _pick("flash", P.flash),
    "latitude": f"{_range('latitude', -800000, 800000)} / 10000.0::DOUBLE", "longitude": f"{_range('longitude', -1700000, 1700000)} / 10000.0::DOUBLE",
    "latitudeRef": f"CASE WHEN {_range('latitude', -800000, 800000)} >= 0 THEN 'N' ELSE 'S' END", "longitudeRef": f"CASE WHEN {_range('longitude', -1700000, 1700000)} >= 0 THEN 'E' ELSE 'W' END",
    "title": _either("title", P.audio_titles, P.video_titles), "artist": _either("artist", P.audio_artists, P.video_directors),
    "album": _only("audio", _pick("album", P.audio_albums)), "genre": _either("genre", P.audio_genres, P.video_genres),
    "trackNumber": _only("audio", f"{_range('track', 1, 15)}::VARCHAR"),
    "year": f"CASE kind WHEN 'audio' THEN ({YEAR} - {_range('year', 0, 5)})::VARCHAR WHEN 'video' THEN ({YEAR} - {_range('year', 0, 10)})::VARCHAR END",
    "mediaDate": f"CASE WHEN kind IN ('audio', 'video') THEN {_date('mediaDate', (0, 24), True)} END",
    "author": _only("pdf", _pick("author", P.authors)), "creator": _only("pdf", _pick("creator", P.pdf_tools)), "producer": _only("pdf", _pick("producer", P.pdf_tools)),
    "pdfTitle": _only("pdf", _pick("pdfTitle", P.pdf_titles)), "subject": _only("pdf", _text(P.subject)),
    "keywords": _only("pdf", "array_to_string(list_transform(list_sort([" + ", ".join(f"{{'h': {_hash(f'keywords{i}')}, 'i': {i}, 'x': {_text(x)}}}" for i, x in enumerate(P.keywords)) + "])[1:3], lambda p: p.x), ', ')"),
}
PLANS = f"m AS (SELECT *, {_pick('make', P.makes)} AS make FROM k),\np AS (SELECT uri, mime_type, kind, " + ", ".join(f"{PLAN_SQL[f]} AS {f}" for f in FIELDS) + " FROM m)"


def _targets(source: str, targets) -> str:
    return f"SELECT uri, unnest([" + ", ".join(f"{{'ord': {i}, 'key': '{k}', 'value': {f}::VARCHAR}}" for i, (k, f) in enumerate(targets, 1)) + f"], recursive := true) FROM {source}"


ENTRIES = f"""
img AS (SELECT uri, list_position({_array(tags.PREVIEW_TAGS)}, key) AS entry_ord, key, value FROM a WHERE kind = 'image' AND key IN {_in(tags.PREVIEW_TAGS)} AND NOT {BLANK}),
w AS (SELECT uri, max(CASE key WHEN 'Title' THEN value END) AS title, max(CASE key WHEN 'Artist' THEN value END) AS artist, max(CASE key WHEN 'Album' THEN value END) AS album, max(CASE key WHEN 'Date' THEN value END) AS dat,
      max(CASE key WHEN 'Location' THEN value END) AS loc, max(CASE key WHEN 'HasVideo' THEN value END) AS hv, max(CASE key WHEN 'Width' THEN value END) AS wid, max(CASE key WHEN 'Height' THEN value END) AS hei, max(CASE key WHEN 'DurationMs' THEN value END) AS dur
      FROM a WHERE kind IN ('video', 'audio') GROUP BY uri),
med AS (SELECT * FROM (SELECT uri, unnest([{{'entry_ord': 1, 'key': 'Title', 'value': title}}, {{'entry_ord': 2, 'key': 'Artist', 'value': artist}}, {{'entry_ord': 3, 'key': 'Album', 'value': album}}, {{'entry_ord': 4, 'key': 'Date', 'value': dat}},
      {{'entry_ord': 5, 'key': 'Location (Raw)', 'value': loc}}, {{'entry_ord': 6, 'key': 'Resolution', 'value': CASE WHEN hv = 'yes' THEN wid || 'x' || hei END}},
      {{'entry_ord': 7, 'key': 'Duration', 'value': CASE WHEN dur IS NOT NULL THEN (coalesce(try_cast(dur AS BIGINT), 0) // 1000)::VARCHAR || 's' END}}], recursive := true) FROM w) WHERE value IS NOT NULL),
pdf AS (SELECT uri, list_position({_array(("PageCount", *tags.PDF_KEYS))}, key) AS entry_ord, CASE key WHEN 'PageCount' THEN 'Page Count' ELSE key END AS key, value FROM a WHERE kind = 'pdf' AND key IN {_in(("PageCount", *tags.PDF_KEYS))}),
e AS (SELECT * FROM img UNION ALL SELECT uri, 0, 'Info', '{tags.NO_EXIF}' FROM k WHERE kind = 'image' AND uri NOT IN (SELECT uri FROM img)
      UNION ALL SELECT * FROM med UNION ALL SELECT * FROM pdf
      UNION ALL SELECT uri, 0, 'Info', '{tags.UNSUPPORTED}' || coalesce(mime_type, '') FROM k WHERE kind = 'other')"""


def _sanitized(c: str) -> str:
    last = f"regexp_extract(regexp_extract(regexp_replace({c}, '/+$', ''), '[^/]*$'), '[^\\\\]*$')"
    safe = f"regexp_replace({last}, '[^a-zA-Z0-9._-]', '_', 'g')"
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'unknown_{NOW}' WHEN regexp_full_match({safe}, '\\.*') THEN 'file_{NOW}' WHEN starts_with({safe}, '.') THEN 'file_{NOW}_' || {safe} ELSE {safe} END"


# ---- queries ----------------------------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^([^:]*):', 1) = 'https'")
def scheme_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"))
    return selection.content_uris(pages, "https").withColumnRenamed("uri", "url")


@query(f"WITH {CTES} SELECT uri, {_sanitized('display_name')} AS display_name, mime_type, size_bytes, file_ord FROM files")
def catalog_scan(spark, sf_dir):
    return files(spark, sf_dir).withColumn("display_name", fn.sanitize_filename(F.col("display_name"), NOW))


@query(f"WITH {CTES} SELECT uri, file_ord, mime_type FROM files")
def distinct_uris(spark, sf_dir):
    one = files(spark, sf_dir).select("uri", "file_ord", "mime_type")
    again = one.withColumns({"file_ord": F.col("file_ord") + 1_000_000, "mime_type": F.lit("other/again")})
    return selection.distinct_uris(again.unionByName(one))


@query(f"WITH {CTES} SELECT uri, mime_type, {CLASS} AS mime_class FROM files")
def mime_class(spark, sf_dir):
    return files(spark, sf_dir).select("uri", "mime_type", media_class(F.col("mime_type")).alias("mime_class"))


@query(
    f"WITH {CTES} SELECT uri, CASE " + " ".join(f"WHEN mime_type LIKE '{m}%' THEN '{e}'" for m, e in tags.EXTENSIONS) + " WHEN mime_type = 'application/pdf' THEN '.pdf' ELSE '.bin' END AS extension FROM files"
)
def ext_from_mime(spark, sf_dir):
    return files(spark, sf_dir).select("uri", fn.extension_from_mime(F.col("mime_type")).alias("extension"))


@query(
    "WITH u AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)', 3) AS path FROM pages) "
    "SELECT page_id, CASE WHEN contains(path, '.') THEN '.' || lower(regexp_extract(path, '[^.]*$')) ELSE '' END AS extension FROM u"
)
def ext_from_uri(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.extension_from_uri(F.col("url")).alias("extension"))


@query(f"SELECT page_id, {_sanitized('url')} AS name FROM pages")
def sanitize_filename(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.sanitize_filename(F.col("url"), NOW).alias("name"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM part")
def sanitize_simple(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", fn.sanitize_simple(F.col("p_name")).alias("name"))


_SPLIT = "regexp_full_match(display_name, '(?s).+\\.[^.]*')"


@query(
    f"WITH {CTES} SELECT uri, regexp_replace('PRE ' || CASE WHEN {_SPLIT} THEN regexp_extract(display_name, '(?s)^(.+)\\.[^.]*$', 1) || '_post' || regexp_extract(display_name, '\\.[^.]*$') ELSE display_name || '_post' END, '[^a-zA-Z0-9._-]', '_', 'g') AS output_name, "
    f"'file_{NOW}_' || substr(md5('{SEED}:' || uri || ':name'), 1, 16) || CASE WHEN {_SPLIT} THEN regexp_replace(regexp_extract(display_name, '\\.[^.]*$'), '[^a-zA-Z0-9._-]', '_', 'g') ELSE '' END AS random_name FROM files"
)
def output_name(spark, sf_dir):
    name, random = F.col("display_name"), fn.random_base(F.col("uri"), SEED, NOW)
    return files(spark, sf_dir).select("uri", fn.output_name(name, "PRE ", "_post").alias("output_name"), fn.output_name(name, random=random).alias("random_name"))


def _route_sql(path: str, sub: str, structure: str) -> str:
    return (
        f"SELECT '{structure}' AS structure, uri, {path} AS configured_path, {sub} AS sub_path, "
        f"CASE WHEN {sub} IS NULL THEN {path} WHEN ends_with({path}, '/') THEN {path} || {sub} ELSE {path} || '/' || {sub} END AS relative_path, "
        f"CASE WHEN starts_with({path}, 'content://') THEN 'tree' ELSE 'media' END AS sink, CASE kind WHEN 'image' THEN 'Images' WHEN 'video' THEN 'Video' ELSE 'Downloads' END AS collection FROM k"
    )


_FOLDER = "CASE kind WHEN 'image' THEN 'Pictures' WHEN 'video' THEN 'Movies' WHEN 'audio' THEN 'Music' ELSE 'Documents' END"


@query(
    f"{WITH} {_route_sql(f'({_FOLDER}) || ' + _text('/Processed'), 'CAST(NULL AS VARCHAR)', 'SPLIT')} UNION ALL {_route_sql(_text('content://tree/1/'), f'({_FOLDER})', 'UNIFIED')}"
)
def route_output(spark, sf_dir):
    parts = [output.route(files(spark, sf_dir), s).select(F.lit(s.folder_structure).alias("structure"), "uri", "configured_path", "sub_path", "relative_path", "sink", "collection") for s in (Settings(), Settings(folder_structure="UNIFIED", unified_saving_path="content://tree/1/"))]
    return parts[0].unionByName(parts[1])


@query(f"{WITH} SELECT uri, list_position({_array(tags.PREVIEW_TAGS)}, key)::INT AS entry_ord, key, value FROM a WHERE key IN {_in(tags.PREVIEW_TAGS)} AND NOT {BLANK}")
def project_tags(spark, sf_dir):
    return md.project_tags(attributes(spark, sf_dir))


@query(f"{WITH}, {ENTRIES} SELECT uri, entry_ord::INT AS entry_ord, key, value FROM e")
def metadata_entries(spark, sf_dir):
    return md.metadata_entries(files(spark, sf_dir), attributes(spark, sf_dir))


_IMAGE_KEPT = f"kind = 'image' AND NOT (key = 'Orientation' AND {BLANK}) AND key NOT IN {_in(tags.THUMBNAIL_TAGS)}"


@query(f"{WITH} SELECT uri, key, value FROM a WHERE {_IMAGE_KEPT} AND key IN {_in((*tags.STRUCTURE_TAGS, 'Orientation'))}")
def strip_image(spark, sf_dir):
    return md.strip_image(files(spark, sf_dir), attributes(spark, sf_dir)).select("uri", "key", "value")


@query(f"{WITH} SELECT uri, key, value FROM a WHERE kind = 'image' AND key <> 'Orientation' AND key NOT IN {_in(tags.PRIVACY_TAGS)}")
def strip_image_listed(spark, sf_dir):
    return md.strip_image(files(spark, sf_dir), attributes(spark, sf_dir), keep_orientation=False, thumbnail="KEEP_ORIGINAL", strict=False).select("uri", "key", "value")


@query(f"{WITH} SELECT uri, key, value FROM a WHERE kind = 'pdf' AND key NOT IN {_in((*tags.PDF_KEYS, 'Xmp'))}")
def strip_pdf(spark, sf_dir):
    return md.strip_pdf(files(spark, sf_dir), attributes(spark, sf_dir)).select("uri", "key", "value")


@query(f"{WITH} SELECT uri, key, value FROM a WHERE kind IN ('video', 'audio') AND key IN ('HasVideo', 'Width', 'Height', 'DurationMs')")
def strip_media(spark, sf_dir):
    return md.strip_media(files(spark, sf_dir), attributes(spark, sf_dir)).select("uri", "key", "value")


_TRACKS = "[CASE WHEN l_returnflag = 'R' THEN 'text/' ELSE 'video/' END || l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'application/' ELSE 'audio/' END || l_shipmode_, 'audio/aac']"


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'aac' ELSE 'opus' END AS l_shipmode_, l_returnflag, l_linestatus FROM lineitem), "
    f"k AS (SELECT l_orderkey, l_linenumber, list_filter({_TRACKS}, lambda m: starts_with(m, 'video/') OR starts_with(m, 'audio/')) AS kept FROM t) "
    "SELECT l_orderkey, l_linenumber, array_to_string(kept, ',') AS kept, len(kept)::INT AS n_kept FROM k"
)
def keep_tracks(spark, sf_dir):
    """Tracks of which one to three are video or audio."""
    name = F.when(F.col("l_linenumber") % 3 == 0, "meta").when(F.col("l_linenumber") % 3 == 1, "aac").otherwise("opus")
    first = F.concat(F.when(F.col("l_returnflag") == "R", "text/").otherwise("video/"), "l_returnflag")
    second = F.concat(F.when(F.col("l_linestatus") == "O", "application/").otherwise("audio/"), name)
    tracks = F.array(*[F.struct(m.alias("mime")) for m in (first, second, F.lit("audio/aac"))])
    kept = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", md.keep_tracks(tracks).alias("kept"))
    return kept.select("l_orderkey", "l_linenumber", F.array_join(F.transform("kept", lambda x: x["mime"]), ",").alias("kept"), F.size("kept").alias("n_kept"))


#: Small files made of a customer's name, as hexadecimal digits that Spark and DuckDB put together alike: a JPEG with a comment, an MP3 with a
#: tag at its end, a WebP with an XMP packet, a plain text, and a JPEG that is cut short.
_NAME, _LENGTH = "hex(c_name)", "length(c_name)"
_BYTE = "lpad(hex({0}), 2, '0')"
_PICTURE = f"'3001009D012A2C01C800' || {_NAME} || CASE WHEN {_LENGTH} % 2 = 1 THEN '00' ELSE '' END"
_CHUNK = f"hex('VP8 ') || {_BYTE.format(f'({_LENGTH} + 10)')} || '000000' || {_PICTURE}"
_CHUNK_SIZE = f"(8 + 10 + {_LENGTH} + {_LENGTH} % 2)"
_XMP = f"hex('XMP ') || {_BYTE.format(f'({_LENGTH} * 2)')} || '000000' || {_NAME} || {_NAME}"
_FILES = (
    ("image/jpeg", f"'FFD8FFFE00' || {_BYTE.format(f'({_LENGTH} + 2)')} || {_NAME} || 'FFDA00040000' || {_NAME} || 'FFD9'"),
    ("audio/mpeg", f"'FFFB9064' || {_NAME} || hex('TAG') || {_NAME} || repeat('00', 125 - {_LENGTH})"),
    ("image/webp", f"hex('RIFF') || {_BYTE.format(f'(4 + {_CHUNK_SIZE} + 8 + {_LENGTH} * 2)')} || '000000' || hex('WEBP') || {_CHUNK} || {_XMP}"),
    ("text/plain", _NAME),
    ("image/jpeg", "'FFD8FFFE00'"),
)
_FILE_COLUMNS = (
    "c_custkey AS n", "'file:' || CAST(c_custkey AS STRING) AS uri", "c_name",
    "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(_FILES)) + " END AS mime_type",
    "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(_FILES)) + " END AS digits",
)
_FILE_TABLE = f"SELECT {', '.join(_FILE_COLUMNS)} FROM customer"


def _small_files(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr(*_FILE_COLUMNS).select("uri", "mime_type", F.unhex("digits").alias("content"))


@query(
    f"WITH f AS ({_FILE_TABLE}) SELECT uri, 'UserComment' AS key, c_name AS value FROM f WHERE n % 5 = 0 UNION ALL SELECT uri, 'Title', c_name FROM f WHERE n % 5 = 1 UNION ALL SELECT uri, 'HasVideo', 'no' FROM f WHERE n % 5 = 1 "
    "UNION ALL SELECT uri, 'ImageWidth', '300' FROM f WHERE n % 5 = 2 UNION ALL SELECT uri, 'ImageLength', '200' FROM f WHERE n % 5 = 2 UNION ALL SELECT uri, 'Xmp', c_name || c_name FROM f WHERE n % 5 = 2"
)
def read_file_bytes(spark, sf_dir):
    """What the readers find in the bytes of files; the one that is cut short is an error, not a row here."""
    return read_attributes(_small_files(spark, sf_dir))[0].select("uri", "key", "value")


@query(
    f"WITH f AS ({_FILE_TABLE}) SELECT uri, CASE n % 5 WHEN 0 THEN 'FFD8FFDA00040000' || {_NAME} || 'FFD9' WHEN 1 THEN 'FFFB9064' || {_NAME} "
    f"WHEN 2 THEN hex('RIFF') || {_BYTE.format(f'(4 + {_CHUNK_SIZE})')} || '000000' || hex('WEBP') || {_CHUNK} WHEN 3 THEN {_NAME} END AS digits, CASE WHEN n % 5 = 4 THEN 'error' ELSE 'ok' END AS status FROM f"
)
def rewrite_file_bytes(spark, sf_dir):
    """The bytes of files without metadata; the one that is cut short has an error and no bytes."""
    return rewrite_files(_small_files(spark, sf_dir)).select("uri", F.hex("content").alias("digits"), "status")


@query("SELECT p_partkey, (CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 0 ELSE 1 END + 1)::INT AS n_kept FROM part")
def keep_annotations(spark, sf_dir):
    size = F.col("p_size")
    one = F.struct(F.when(size % 3 == 0, "Stamp").otherwise("Link").alias("subtype"), F.when(size % 5 == 0, "Watermark").alias("intent"))
    two = F.struct(F.lit(None).cast("string").alias("subtype"), F.lit("Note").alias("intent"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(md.keep_annotations(F.array(one, two))).alias("n_kept"))


def _plan_query(kind: str) -> None:
    @query(f"{WITH}, {PLANS} SELECT uri, {', '.join(FIELDS)} FROM p WHERE kind = '{kind}'")
    def run(spark, sf_dir):
        chosen = files(spark, sf_dir).where(media_class(F.col("mime_type")) == kind)
        return generate_plans(chosen, SETTINGS).select("uri", *FIELDS)

    QUERIES[f"poison_plan_{kind}"] = QUERIES.pop("run")
    ORACLES[f"poison_plan_{kind}"] = ORACLES.pop("run")


for _kind in ("image", "audio", "video", "pdf"):
    _plan_query(_kind)


@query(
    "WITH k AS (SELECT c_name AS uri, CASE WHEN c_custkey % 4 > 0 THEN " + f"{_array(P.makes)}[c_custkey % {len(P.makes)} + 1] ELSE c_name END AS make FROM customer) "
    f"SELECT uri, make, {PLAN_SQL['model']} AS model, {PLAN_SQL['software']} AS software FROM k"
)
def device_of_make(spark, sf_dir):
    """Models and software of makers, a quarter of which the pools don't know."""
    known = F.element_at(F.array(*map(F.lit, P.makes)), (F.col("c_custkey") % len(P.makes) + 1).cast("int"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("uri"), F.lit("image/jpeg").alias("mime_type"), F.when(F.col("c_custkey") % 4 > 0, known).otherwise(F.col("c_name")).alias("made_by"))
    return generate_plans(c, SETTINGS, make=F.col("made_by")).select("uri", "make", "model", "software")


def _near_sql(c: str, field: str) -> str:
    return f"{c} + {_range(field + '.offset', 2000, 10000)} / 1000000.0::DOUBLE * CASE WHEN {_hash(field + '.sign')} % 2 = 0 THEN 1 ELSE -1 END"


@query(
    "WITH c AS (SELECT c_name AS uri, (c_custkey % 160 - 80)::DOUBLE AS lat, (c_custkey % 340 - 170)::DOUBLE AS lon FROM customer), "
    f"n AS (SELECT uri, {_near_sql('lat', 'latitude')} AS latitude, {_near_sql('lon', 'longitude')} AS longitude FROM c) "
    "SELECT *, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS latitude_ref, CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS longitude_ref FROM n"
)
def nearby_scramble(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("uri"), (F.col("c_custkey") % 160 - 80).cast("double").alias("lat"), (F.col("c_custkey") % 340 - 170).cast("double").alias("lon"))
    n = c.select("uri", nearby(SEED, F.col("uri"), F.col("lat"), "latitude").alias("latitude"), nearby(SEED, F.col("uri"), F.col("lon"), "longitude").alias("longitude"))
    return n.select("*", fn.hemisphere(F.col("latitude"), "N", "S").alias("latitude_ref"), fn.hemisphere(F.col("longitude"), "E", "W").alias("longitude_ref"))


def _poisoned(kind: str, targets, kept: str) -> str:
    return f"{WITH}, {PLANS}, t AS ({_targets(f'(SELECT * FROM p WHERE kind = {_text(kind)})', targets)}) SELECT uri, key, value FROM t UNION ALL SELECT uri, key, value FROM a WHERE {kept} AND key NOT IN {_in(k for k, _ in targets)}"


@query(_poisoned("image", tags.IMAGE_TARGETS, f"{_IMAGE_KEPT} AND key IN {_in((*tags.STRUCTURE_TAGS, 'Orientation'))}"))
def poison_apply_image(spark, sf_dir):
    f = files(spark, sf_dir)
    return md.poison_image(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS)).select("uri", "key", "value")


@query(_poisoned("image", tags.IMAGE_TARGETS, f"{_IMAGE_KEPT} AND key NOT IN {_in(tags.LEAK_TAGS)}"))
def poison_apply_image_listed(spark, sf_dir):
    f = files(spark, sf_dir)
    return md.poison_image(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS), strict=False).select("uri", "key", "value")


@query(_poisoned("pdf", tags.PDF_TARGETS, f"kind = 'pdf' AND key NOT IN {_in((*tags.PDF_KEYS, 'Xmp'))}"))
def poison_apply_pdf(spark, sf_dir):
    f = files(spark, sf_dir)
    return md.poison_pdf(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS)).select("uri", "key", "value")


@query(
    f"{WITH}, {PLANS} SELECT uri, 'Location' AS key, printf('%+.4f%+.4f/', latitude::FLOAT::DOUBLE, longitude::FLOAT::DOUBLE) AS value FROM p WHERE kind IN ('video', 'audio') "
    "UNION ALL SELECT uri, key, value FROM a WHERE kind IN ('video', 'audio') AND key IN ('HasVideo', 'Width', 'Height', 'DurationMs')"
)
def poison_apply_media(spark, sf_dir):
    f = files(spark, sf_dir)
    return md.poison_media(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS)).select("uri", "key", "value")


@query(
    f"{WITH}, {PLANS}, x AS (SELECT uri, CASE WHEN file_ord % 3 = 0 THEN (file_ord % 90 - 45)::DOUBLE ELSE latitude END AS latitude, CASE WHEN file_ord % 3 = 0 THEN (file_ord % 180 - 90)::DOUBLE ELSE longitude END AS longitude, p.make "
    "FROM p JOIN files USING (uri) WHERE file_ord % 3 = 0 OR file_ord % 2 = 0) SELECT uri, make, latitude, longitude, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS latitudeRef, CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS longitudeRef FROM x"
)
def plan_location_upsert(spark, sf_dir):
    f = files(spark, sf_dir)
    planned = generate_plans(f.where("file_ord % 2 = 0"), SETTINGS)
    edits = f.where("file_ord % 3 = 0").select("uri", (F.col("file_ord") % 90 - 45).cast("double").alias("latitude"), (F.col("file_ord") % 180 - 90).cast("double").alias("longitude"))
    return update_locations(planned, edits, f, SETTINGS).select("uri", "make", "latitude", "longitude", "latitudeRef", "longitudeRef")


@query(f"{WITH}, {ENTRIES} SELECT uri, key, value || '{tags.ARROW}[REMOVED]' AS value FROM e UNION ALL SELECT uri, 'Info', '{tags.NOTHING_TO_REMOVE}' FROM k WHERE uri NOT IN (SELECT uri FROM e)")
def change_preview_remove(spark, sf_dir):
    f = files(spark, sf_dir)
    return md.remove_preview(f, attributes(spark, sf_dir), strict=False).select("uri", "key", "value")


_PREVIEW = f"""t AS (SELECT * FROM ({_targets("(SELECT * FROM p WHERE kind = 'image')", tags.IMAGE_TARGETS)}
  UNION ALL {_targets("(SELECT *, latitude::VARCHAR || ', ' || longitude::VARCHAR AS place FROM p WHERE kind = 'video')", (("Location", "place"), *tags.VIDEO_TARGETS))}
  UNION ALL {_targets("(SELECT *, latitude::VARCHAR || ', ' || longitude::VARCHAR AS place FROM p WHERE kind = 'audio')", (("Location", "place"), *tags.AUDIO_TARGETS))}
  UNION ALL {_targets("(SELECT * FROM p WHERE kind = 'pdf')", tags.PDF_PREVIEW_TARGETS)}
  UNION ALL SELECT uri, 19, 'Orientation', value FROM img WHERE key = 'Orientation') WHERE value IS NOT NULL),
cur AS (SELECT uri, key, arg_max(value, entry_ord * 1000 + rn) AS value FROM (SELECT *, row_number() OVER (PARTITION BY uri, key ORDER BY value = 'Second maker') AS rn FROM e) GROUP BY uri, key),
df AS (SELECT coalesce(c.uri, t.uri) AS uri, coalesce(c.key, t.key) AS key, c.value AS old_value, t.value AS new_value,
  CASE WHEN c.value IS NULL THEN 'ADDED' WHEN t.value IS NULL OR t.value = c.value THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_kind
  FROM cur c FULL JOIN t ON c.uri = t.uri AND c.key = t.key)"""


@query(
    f"{WITH}, {PLANS}, {ENTRIES}, {_PREVIEW} SELECT uri, key, change_kind, old_value, new_value, CASE change_kind WHEN 'ADDED' THEN '[ADDED] ' || new_value WHEN 'UNCHANGED' THEN '[UNCHANGED] ' || old_value ELSE '[CHANGED] ' || old_value || '{tags.ARROW}' || new_value END AS value FROM df"
)
def change_preview_poison(spark, sf_dir):
    f = files(spark, sf_dir)
    shown = md.poison_preview(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS), strict=False)
    return shown.select("uri", "key", "change_kind", "old_value", "new_value", "value")


@query(f"{WITH}, {PLANS}, {ENTRIES}, {_PREVIEW} SELECT kind AS mime_class, change_kind, count(*) AS n_entries, count(DISTINCT df.uri) AS n_files FROM df JOIN k USING (uri) GROUP BY ALL")
def change_counts(spark, sf_dir):
    """Catalogue, entries, plans, diff and counts: the flagship."""
    f = files(spark, sf_dir)
    return md.change_counts(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS), strict=False)


_MEDIA_PLACE = "printf('%+.4f%+.4f/', latitude::FLOAT::DOUBLE, longitude::FLOAT::DOUBLE)"
_REAL = f"""ti AS ({_targets("(SELECT * FROM p WHERE kind = 'image')", tags.IMAGE_TARGETS)}), tp AS ({_targets("(SELECT * FROM p WHERE kind = 'pdf')", tags.PDF_TARGETS)}),
nw AS (SELECT uri, key, value FROM ti WHERE key IN {_in(tags.PREVIEW_TAGS)} AND NOT {BLANK}
  UNION ALL SELECT uri, key, value FROM a WHERE {_IMAGE_KEPT} AND NOT {BLANK} AND key IN {_in([k for k in (*tags.STRUCTURE_TAGS, "Orientation") if k in tags.PREVIEW_TAGS])}
  UNION ALL SELECT uri, 'Location (Raw)', {_MEDIA_PLACE} FROM p WHERE kind IN ('video', 'audio')
  UNION ALL SELECT uri, key, value FROM med WHERE key IN ('Resolution', 'Duration')
  UNION ALL SELECT uri, key, value FROM tp UNION ALL SELECT uri, key, value FROM pdf WHERE key = 'Page Count'),
cur AS (SELECT uri, key, arg_max(value, entry_ord * 1000 + rn) AS value FROM (SELECT *, row_number() OVER (PARTITION BY uri, key ORDER BY value = 'Second maker') AS rn FROM e WHERE entry_ord > 0) GROUP BY uri, key),
df AS (SELECT coalesce(c.uri, n.uri) AS uri, coalesce(c.key, n.key) AS key, c.value AS old_value, n.value AS new_value,
  CASE WHEN c.value IS NULL THEN 'ADDED' WHEN n.value IS NULL THEN 'REMOVED' WHEN n.value = c.value THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_kind
  FROM cur c FULL JOIN nw n ON c.uri = n.uri AND c.key = n.key)"""


@query(
    f"{WITH}, {PLANS}, {ENTRIES}, {_REAL} SELECT uri, key, change_kind, old_value, new_value, CASE change_kind WHEN 'ADDED' THEN '[ADDED] ' || new_value WHEN 'UNCHANGED' THEN '[UNCHANGED] ' || old_value "
    f"WHEN 'REMOVED' THEN old_value || '{tags.ARROW}[REMOVED]' ELSE '[CHANGED] ' || old_value || '{tags.ARROW}' || new_value END AS value FROM df"
)
def change_preview_poison_strict(spark, sf_dir):
    """What replacing really changes: entries before against entries of what replacing leaves."""
    f = files(spark, sf_dir)
    shown = md.poison_preview(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS))
    return shown.select("uri", "key", "change_kind", "old_value", "new_value", "value")


@query(f"{WITH}, {PLANS}, {ENTRIES}, {_REAL} SELECT kind AS mime_class, change_kind, count(*) AS n_entries, count(DISTINCT df.uri) AS n_files FROM df JOIN k USING (uri) GROUP BY ALL")
def change_counts_strict(spark, sf_dir):
    f = files(spark, sf_dir)
    return md.change_counts(f, attributes(spark, sf_dir), generate_plans(f, SETTINGS))


@query(
    f"{WITH}, {ENTRIES} SELECT uri, key, CASE WHEN entry_ord = 0 OR key IN ('Page Count', 'Resolution', 'Duration') OR (kind = 'image' AND key IN {_in((*tags.STRUCTURE_TAGS, 'Orientation'))}) THEN value ELSE value || '{tags.ARROW}[REMOVED]' END AS value "
    f"FROM e JOIN k USING (uri) UNION ALL SELECT uri, 'Info', '{tags.NOTHING_TO_REMOVE}' FROM k WHERE uri NOT IN (SELECT uri FROM e)"
)
def change_preview_remove_strict(spark, sf_dir):
    """What stripping really removes."""
    f = files(spark, sf_dir)
    return md.remove_preview(f, attributes(spark, sf_dir)).select("uri", "key", "value")


_DEGREES = "(split_part(split_part({0}, ',', 1), '/', 1)::DOUBLE / split_part(split_part({0}, ',', 1), '/', 2)::DOUBLE + split_part(split_part({0}, ',', 2), '/', 1)::DOUBLE / split_part(split_part({0}, ',', 2), '/', 2)::DOUBLE / 60 + split_part(split_part({0}, ',', 3), '/', 1)::DOUBLE / split_part(split_part({0}, ',', 3), '/', 2)::DOUBLE / 3600)"


@query(
    f"{WITH}, {PLANS}, g AS (SELECT uri, max(CASE WHEN key = 'GPSLatitude' THEN value END) AS la, max(CASE WHEN key = 'GPSLongitude' THEN value END) AS lo, max(CASE WHEN key = 'GPSLongitudeRef' THEN value END) AS we, max(CASE WHEN key = 'Location' THEN value END) AS place FROM a GROUP BY uri), "
    f"known AS (SELECT uri, {_DEGREES.format('la')} AS lat, CASE WHEN we = 'W' THEN -1 ELSE 1 END * {_DEGREES.format('lo')} AS lon FROM g WHERE la LIKE '%,%' AND lo LIKE '%,%' "
    "UNION ALL SELECT uri, regexp_extract(place, '^([+-][0-9.]+)([+-][0-9.]+)', 1)::DOUBLE, regexp_extract(place, '^([+-][0-9.]+)([+-][0-9.]+)', 2)::DOUBLE FROM g WHERE place IS NOT NULL), "
    f"n AS (SELECT p.uri, CASE WHEN lat IS NULL THEN latitude ELSE {_near_sql('lat', 'latitude').replace('uri', 'p.uri')} END AS latitude, CASE WHEN lat IS NULL THEN longitude ELSE {_near_sql('lon', 'longitude').replace('uri', 'p.uri')} END AS longitude FROM p LEFT JOIN known ON known.uri = p.uri) "
    "SELECT *, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS latitude_ref, CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS longitude_ref FROM n"
)
def nearby_from_metadata(spark, sf_dir):
    """Plans whose place is near the one that the file's own metadata name, if they name one."""
    near = plans_near(files(spark, sf_dir), attributes(spark, sf_dir), Settings(use_nearby_scramble=True))
    return near.select("uri", "latitude", "longitude", F.col("latitudeRef").alias("latitude_ref"), F.col("longitudeRef").alias("longitude_ref"))


@query("SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_saved, coalesce(string_agg(CASE WHEN o_orderstatus = 'F' THEN 'out/' || o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey), '') AS uris FROM orders GROUP BY o_custkey")
def saved_uris(spark, sf_dir):
    results = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("file_ord"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"))).alias("output_path"))
    return selection.saved_uris(results, "o_custkey").withColumn("uris", F.array_join("uris", ","))


@query(f"WITH {CTES} SELECT {CLASS} AS mime_class, arg_min(uri, file_ord) AS uri FROM files GROUP BY ALL")
def first_file(spark, sf_dir):
    return selection.first_file(files(spark, sf_dir).withColumn("mime_class", media_class(F.col("mime_type"))), "mime_class")


@query(f"WITH {CTES} SELECT count(*) AS n_files, coalesce(sum(coalesce(size_bytes, 0)), 0)::BIGINT AS total_size FROM files")
def selection_summary(spark, sf_dir):
    return selection.selection_summary(files(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN n_chars / 1048576::DOUBLE WHEN n_chars >= 1024 THEN n_chars / 1024::DOUBLE ELSE n_chars::DOUBLE END AS number, CASE WHEN n_chars >= 1048576 THEN 'MB' WHEN n_chars >= 1024 THEN 'KB' ELSE 'Bytes' END AS unit FROM documents")
def size_number(spark, sf_dir):
    number, unit = fn.size_number(F.col("n_chars"))
    return _table(spark, sf_dir, "documents").select("doc_id", number.alias("number"), unit.alias("unit"))


@query()
def size_label(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fn.size_label(F.col("n_chars")).alias("label"))


@query(f"WITH {CTES}, g AS (SELECT file_ord % 97 % 9 AS grp, CASE WHEN file_ord % 97 % 9 < 5 THEN 'image/png' ELSE mime_type END AS mime_type FROM files) SELECT grp, CASE WHEN count(DISTINCT mime_type) = 1 AND count(mime_type) = count(*) THEN max(mime_type) ELSE '*/*' END AS mime_type FROM g GROUP BY grp")
def share_mime(spark, sf_dir):
    group = F.col("file_ord") % 97 % 9
    return selection.share_mime(files(spark, sf_dir).select(group.alias("grp"), F.when(group < 5, "image/png").otherwise(F.col("mime_type")).alias("mime_type")), "grp")


@query("SELECT user_id, count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS done, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS failed, count(*) AS total, count(*) FILTER (event_type IN ('click', 'view', 'purchase')) * 100 // count(*) AS percent FROM events GROUP BY user_id")
def job_progress(spark, sf_dir):
    results = _table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type").isin("click", "view", "purchase"), "ok").otherwise("error"))
    return selection.job_progress(results, "user_id")


@query("SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS n_saved, CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) > 0 THEN 'Saved ' || count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END)::VARCHAR || ' file(s)' ELSE 'Failed to save files' END AS message FROM orders GROUP BY o_custkey")
def saved_message(spark, sf_dir):
    results = _table(spark, sf_dir, "orders").withColumn("output_path", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")))
    return selection.saved_message(results, "o_custkey")


@query("SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'SEND' ELSE 'SEND_MULTIPLE' END AS action, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS signature FROM orders GROUP BY o_custkey")
def share_signature(spark, sf_dir):
    shared = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("file_ord"), F.col("o_orderkey").cast("string").alias("uri"))
    return selection.share_action(shared, "o_custkey").join(selection.share_signature(shared, "o_custkey"), "o_custkey")


@query(f"{WITH} SELECT uri, key, value FROM a WHERE uri NOT IN (SELECT uri FROM files WHERE file_ord % 4 = 1)")
def remove_from_selection(spark, sf_dir):
    return selection.remove_from_selection(attributes(spark, sf_dir).select("uri", "key", "value"), files(spark, sf_dir).where("file_ord % 4 = 1"))


@query(f"{WITH} SELECT uri, arg_min(value, entry_ord) AS value FROM a WHERE key = 'Make' GROUP BY uri")
def first_match(spark, sf_dir):
    return md.first_match(attributes(spark, sf_dir), "Make")


@query(f"{WITH} SELECT uri, key, min(entry_ord)::INT AS entry_ord, arg_max(value, entry_ord) AS value FROM a GROUP BY uri, key")
def last_wins_map(spark, sf_dir):
    return md.last_wins(attributes(spark, sf_dir))


@query(f"{WITH}, {PLANS} SELECT uri, keywords FROM p WHERE kind = 'pdf'")
def keywords_pick3(spark, sf_dir):
    return generate_plans(files(spark, sf_dir).where(media_class(F.col("mime_type")) == "pdf"), SETTINGS).select("uri", "keywords")


@query(f"{WITH}, {PLANS} SELECT files.uri, CASE WHEN file_ord % 5 > 0 THEN make END AS make, CASE WHEN file_ord % 5 > 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN file_ord % 5 = 0 THEN 'no replacement plan for ' || files.uri END AS error FROM files JOIN p USING (uri)")
def plan_required_error(spark, sf_dir):
    f = files(spark, sf_dir)
    return require_plans(f, generate_plans(f.where("file_ord % 5 > 0"), SETTINGS), strict=False).select("uri", F.col("plan.make").alias("make"), "status", "error")


@query(f"{WITH}, {PLANS} SELECT uri, mime_type, make, latitude, keywords FROM p")
def plan_json_round_trip(spark, sf_dir):
    return plans_from_json(plans_to_json(generate_plans(files(spark, sf_dir), SETTINGS))).select("uri", "mime_type", "make", "latitude", "keywords")


def _stored_rows():
    return (
        ("folder_structure", "CASE WHEN c_custkey % 3 = 0 THEN 'UNIFIED' WHEN c_custkey % 3 = 1 THEN 'sideways' END"),
        ("default_saving_path", "CASE WHEN c_custkey % 2 = 0 THEN 'Old/' || c_mktsegment END"),
        ("pictures_saving_path", "CASE WHEN c_custkey % 5 = 0 THEN 'Mine' END"),
        ("music_saving_path", "CASE WHEN c_custkey % 7 = 0 THEN 'Tunes' END"),
        ("oled_mode", "CASE WHEN c_custkey % 4 = 0 THEN 'true' WHEN c_custkey % 4 = 1 THEN 'maybe' END"),
        ("default_suffix", "CASE WHEN c_custkey % 6 = 0 THEN '' END"),
    )


@query(
    "WITH s AS (SELECT c_custkey AS profile, " + ", ".join(f"{e} AS {k}" for k, e in _stored_rows()) + " FROM customer) SELECT profile, "
    "CASE WHEN folder_structure = 'UNIFIED' THEN 'UNIFIED' ELSE 'SPLIT' END AS folder_structure, coalesce(default_saving_path, 'Download/Processed') AS unified_saving_path, "
    "coalesce(pictures_saving_path, default_saving_path, 'Pictures/Processed') AS pictures_saving_path, coalesce(music_saving_path, 'Music/Processed') AS music_saving_path, "
    "CASE WHEN oled_mode = 'true' THEN 'true' ELSE 'false' END AS oled_mode, coalesce(default_suffix, '_processed') AS default_suffix, 22::BIGINT AS n_options FROM s"
)
def settings_defaults(spark, sf_dir):
    stored = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS profile", "inline(array(" + ", ".join(f"struct('{k}' AS key, {e} AS value)" for k, e in _stored_rows()) + "))")
    found = read_settings(stored)
    shown = ("folder_structure", "unified_saving_path", "pictures_saving_path", "music_saving_path", "oled_mode", "default_suffix")
    return found.groupBy("profile").agg(*[F.max(F.when(F.col("option") == o, F.col("value"))).alias(o) for o in shown], F.count(F.lit(1)).alias("n_options"))


@query("SELECT n_name AS code, CASE WHEN n_nationkey % 4 > 0 THEN 'LANG' || n_nationkey::VARCHAR ELSE 'SYSTEM' END AS language FROM nation")
def language_lookup(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    known = nation.where("n_nationkey % 4 > 0").select(F.col("n_name").alias("code"), F.concat(F.lit("LANG"), F.col("n_nationkey").cast("string")).alias("language"), F.col("n_nationkey").alias("language_ord"))
    twice = known.unionByName(known.withColumns({"language": F.lit("LATER"), "language_ord": F.col("language_ord") + 100}))
    return selection.language_of(nation.select(F.col("n_name").alias("code")), twice)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS number, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) * 997 // 1000 || 's' AS duration FROM events")
def lenient_numbers(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    ms = F.coalesce(fn.parse_long(k), F.lit(0)) * 997
    return _table(spark, sf_dir, "events").select("event_id", fn.parse_double(k).alias("number"), fn.duration_label(ms.cast("string")).alias("duration"))


@query(f"WITH {CTES}, n AS (SELECT uri, regexp_replace(source || '_processed.bin', '[^a-zA-Z0-9._-]', '_', 'g') AS output_name FROM (SELECT *, 'src' || (file_ord % 40)::VARCHAR AS source FROM files)) SELECT output_name, count(*) AS n_files, min(uri) AS first_uri FROM n GROUP BY output_name HAVING count(*) > 1")
def name_collisions(spark, sf_dir):
    named = output.name_outputs(files(spark, sf_dir).withColumn("display_name", F.concat(F.lit("src"), (F.col("file_ord") % 40).cast("string"), F.lit(".bin"))))
    return output.collisions(named.withColumn("relative_path", F.lit("out"))).select("output_name", "n_files", "first_uri")


@query(f"WITH {CTES}, d AS (SELECT uri, mime_type, file_ord FROM files WHERE file_ord % 6 > 0) SELECT uri, 'out/' || file_ord::VARCHAR AS output_path, mime_type FROM d")
def staged_results(spark, sf_dir):
    f = files(spark, sf_dir)
    done = f.where("file_ord % 6 > 0").select("uri", F.concat(F.lit("out/"), F.col("file_ord").cast("string")).alias("output_path"))
    return selection.processed_with_files(done, f.select("uri", "mime_type"))


_AUDIT_PUBLIC = (*tags.STRUCTURE_TAGS, "Orientation", "HasVideo", "Width", "Height", "DurationMs", "PageCount")


@query(
    f"{WITH}, old AS (SELECT DISTINCT uri, key, value FROM a WHERE kind = 'image' AND key NOT IN {_in(_AUDIT_PUBLIC)} AND NOT {BLANK}), "
    f"new AS (SELECT DISTINCT uri, key AS after_key, value FROM a WHERE {_IMAGE_KEPT} AND key NOT IN {_in((*tags.PRIVACY_TAGS, *_AUDIT_PUBLIC))}) SELECT uri, key, value, after_key FROM old JOIN new USING (uri, value)"
)
def leak_audit(spark, sf_dir):
    """What listed-tags stripping leaves of an image's values."""
    f, a = files(spark, sf_dir), attributes(spark, sf_dir)
    images = f.where(begins(F.col("mime_type"), "image/"))
    return md.leak_audit(a.join(images.select("uri"), "uri", "left_semi"), md.strip_image(f, a, strict=False))


@query("SELECT CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS VARCHAR) AS key WHERE false")
def leak_audit_strict(spark, sf_dir):
    """Strict stripping leaves nothing."""
    f, a = files(spark, sf_dir), attributes(spark, sf_dir)
    images = f.where(begins(F.col("mime_type"), "image/"))
    return md.leak_audit(a.join(images.select("uri"), "uri", "left_semi"), md.strip_image(f, a)).select("uri", "key")


# ---- files that last: saving, chunks, packing, incremental runs, shares ------------------------------------------------

_PAGE_URI = "'page/' || CAST(page_id AS STRING)"


def _page_results(spark, sf_dir, content: str = "CAST(html AS BINARY)"):
    """Every page as a result that is to be saved."""
    return _table(spark, sf_dir, "pages").selectExpr(f"{_PAGE_URI} AS uri", "'Pages/' || CAST(page_id % 7 AS STRING) AS relative_path", "'page_' || CAST(page_id AS STRING) || '.html' AS output_name", f"{content} AS content")


def _read_back(saved: DataFrame, chunk_bytes: int) -> DataFrame:
    """(uri, job, size_bytes, sha256) of saved files, from their bytes."""
    rows = saved.where("status = 'ok'").select(F.concat_ws("#", "job", "uri").alias("uri"), "output_path", "size_bytes")
    found = chunk_digests(read_chunks(rows, chunk_bytes, "output_path"))
    return found.select(F.substring_index("uri", "#", 1).alias("job"), F.expr("substring(uri, locate('#', uri) + 1)").alias("uri"), "size_bytes", "sha256")


@query(
    "WITH p AS (SELECT 'page/' || page_id::VARCHAR AS uri, 'Pages/' || (page_id % 7)::VARCHAR || '/page_' || page_id::VARCHAR AS stem, html FROM pages) "
    "SELECT 'first' AS job, uri, stem || '.html' AS place, strlen(html)::BIGINT AS size_bytes, sha256(html) AS sha256, CASE WHEN html IS NULL THEN 'error' ELSE 'ok' END AS status FROM p UNION ALL "
    "SELECT 'second', uri, CASE WHEN html IS NULL THEN stem || '.html' ELSE stem || '_' || substr(md5('second:' || uri), 1, 16) || '.html' END, strlen(html)::BIGINT, sha256(html), CASE WHEN html IS NULL THEN 'error' ELSE 'ok' END FROM p"
)
def saved_pages(spark, sf_dir):
    """Two jobs save all pages under the same names in one folder, the first one twice; sizes and digests are of the files' bytes."""
    folder, results = new_path(spark, "saved"), _page_results(spark, sf_dir)
    for job in ("first", "first", "second"):
        sinks.save_files(results, folder, job)
    saved = sinks.saved_files(spark, folder)
    return saved.select("job", "uri", "place", "status").join(_read_back(saved, 1000), ["job", "uri"], "left")


@query("SELECT count(html) AS done, count(*) - count(html) AS failed, count(*) AS total, coalesce(sum(strlen(html)), 0)::BIGINT AS bytes FROM (SELECT CASE WHEN page_id % 9 <> 4 THEN html END AS html FROM pages)")
def observed_progress(spark, sf_dir):
    """Progress as the writing job counts it; some results have no content."""
    progress = Observation("progress")
    sinks.save_files(_page_results(spark, sf_dir, "CASE WHEN page_id % 9 <> 4 THEN CAST(html AS BINARY) END"), new_path(spark, "observed"), "observed", progress)
    seen = progress.get
    return spark.createDataFrame([tuple(seen[c] for c in ("done", "failed", "total", "bytes"))], "done bigint, failed bigint, total bigint, bytes bigint")


@query("SELECT page_id, greatest(1, ceil(strlen(html) / 700.0))::INT AS n_chunks, strlen(html)::BIGINT AS size_bytes, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def chunked_copies(spark, sf_dir):
    """Pages written from rows of chunks, copied as streams, and read back by ranges."""
    made, copied = new_path(spark, "chunked"), new_path(spark, "copied")
    chunks = content_chunks(_page_results(spark, sf_dir), 700)
    saved = sinks.save_files(chunks, made, "chunked").where("status = 'ok'")
    copies = sinks.copy_files(saved.select(F.col("output_path").alias("uri"), F.lit("").alias("relative_path"), F.concat(F.regexp_extract("uri", "[0-9]+$", 0), F.lit(".html")).alias("output_name")), copied, "copied")
    read = read_chunks(copies.where("status = 'ok'").select(F.col("place").alias("uri"), "output_path", "size_bytes"), 700, "output_path")
    counted = read.groupBy("uri").agg(F.max("n_chunks").alias("n_chunks"))
    return chunk_digests(read).join(counted, "uri").select(F.regexp_extract("uri", "^[0-9]+", 0).cast("bigint").alias("page_id"), "n_chunks", "size_bytes", "sha256")


@query(
    f"WITH {CTES}, w AS (SELECT uri, file_ord, coalesce(size_bytes, 0) + 4096 AS weight FROM files), s AS (SELECT uri, weight, sum(weight) OVER (ORDER BY file_ord, uri) - weight AS before, sum(weight) OVER () AS total FROM w) "
    "SELECT uri, weight::BIGINT AS weight, least(31, before * 32 // total)::INT AS task FROM s"
)
def packed_tasks(spark, sf_dir):
    return packing.pack(files(spark, sf_dir), 32, "file_ord", "uri").select("uri", "weight", "task")


_ORD = "CAST(regexp_extract(uri, '[0-9]+$') AS BIGINT)"
_EDITED = f"key = 'Artist' AND {_ORD} % 10 = 3"


def _version(spark, sf_dir, second: bool):
    """Two versions of files and attributes: the second lacks some files, has others, and other artists."""
    found, held = files(spark, sf_dir).where(f"file_ord % 10 <> {4 if second else 5}"), attributes(spark, sf_dir)
    if second:
        held = held.withColumn("value", F.when(F.expr(_EDITED.replace("'[0-9]+$'", "'[0-9]+$', 0")), F.concat("value", F.lit(" edited"))).otherwise(F.col("value")))
    return found, held.join(found.select("uri"), "uri", "left_semi")


@query(
    f"WITH {CTES}, k AS (SELECT *, {CLASS} AS kind FROM files WHERE file_ord % 10 <> 4), a AS (SELECT uri, entry_ord, key, CASE WHEN {_EDITED} THEN value || ' edited' ELSE value END AS value, kind FROM attrs JOIN k USING (uri)), {ENTRIES}, "
    f"c AS (SELECT uri, CASE WHEN file_ord % 10 = 5 THEN 'new' WHEN uri IN (SELECT uri FROM attrs WHERE {_EDITED}) THEN 'changed' ELSE 'same' END AS change FROM k) SELECT uri, entry_ord::INT AS entry_ord, key, value, change FROM e JOIN c USING (uri)"
)
def incremental_entries(spark, sf_dir):
    """Entries of a second version of the files, of which only new and changed ones are read again."""
    store = new_path(spark, "entries")
    for second in (False, True):
        found, held = _version(spark, sf_dir, second)
        some = lambda df, uris: df.join(uris, "uri", "left_semi")
        results, changed = incremental.refresh(store, incremental.fingerprints(found, held), lambda uris, f=found, h=held: md.metadata_entries(some(f, uris), some(h, uris)))
    return results.join(changed, "uri").select("uri", "entry_ord", "key", "value", "change")


_SIGNATURE = "CAST(user_id AS STRING) || '|' || event_type || '|' || CAST(event_id % 3 AS STRING)"


@query(f"SELECT DISTINCT {_SIGNATURE} AS signature, 1::BIGINT AS n_handled FROM events")
def shares_handled_once(spark, sf_dir):
    """Events as shares that arrive in small batches, and again after a restart; how often each signature was handled."""
    arriving, out, checkpoint = (new_path(spark, n) for n in ("arriving", "handled", "shares"))
    shares = _table(spark, sf_dir, "events").selectExpr("event_id", f"{_SIGNATURE} AS signature")
    for late in (False, True):
        shares.where(f"event_id % 2 = {int(late)}").repartitionByRange(3, "event_id").write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(shares.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        handle_shares(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy("signature").agg(F.count(F.lit(1)).alias("n_handled"))


@query(
    "WITH l AS (SELECT 'out/' || page_id::VARCHAR || CASE page_id % 4 WHEN 0 THEN '/pending-1' WHEN 1 THEN '/_manifests/_staged-1/p' ELSE '/a' END AS path, page_id, page_id * 1000 AS modified_ms FROM pages) "
    "SELECT path, CASE page_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'staged' ELSE 'unlisted' END AS reason FROM l WHERE modified_ms < 200000 AND NOT (page_id % 4 = 2 AND page_id % 3 > 0)"
)
def swept_leftovers(spark, sf_dir):
    """Which files a sweep would delete, from a listing and manifests made of pages."""
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", "'out/' || page_id || CASE page_id % 4 WHEN 0 THEN '/pending-1' WHEN 1 THEN '/_manifests/_staged-1/p' ELSE '/a' END AS path", "page_id * 1000 AS modified_ms")
    return sinks.leftovers(pages.select("path", "modified_ms"), pages.where("page_id % 4 = 2 AND page_id % 3 > 0").select("path"), 200_000)


@query("SELECT 'page_' || page_id::VARCHAR || '.html' AS name, strlen(html)::BIGINT AS size_bytes, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL AND strlen(html) >= 2000 AND page_id % 7 = 3")
def catalog_source(spark, sf_dir):
    """Saved pages through the catalogue's data source: one folder's files of some size, with content."""
    folder = new_path(spark, "catalogue")
    sinks.save_files(_page_results(spark, sf_dir), folder, "pages")
    found = file_catalog(spark, folder, "path", "name", "extension", "size_bytes", "content")
    kept = found.where(F.startswith("path", F.lit(f"{local_or_uri(folder)}/Pages/3/")) & (F.col("size_bytes") >= 2000) & (F.col("extension") == "html"))
    return kept.select("name", "size_bytes", F.sha2("content", 256).alias("sha256"))


@query(
    f"WITH {CTES}, g AS (SELECT CASE WHEN file_ord % 9 < 4 THEN file_ord % 97 ELSE 1000 + file_ord % 3 END AS grp, CASE WHEN file_ord % 2 = 0 THEN 'image/png' ELSE mime_type END AS mime_type, uri, file_ord FROM files WHERE file_ord % 5 > 0) "
    "SELECT grp, CASE WHEN count(*) = 1 THEN 'SEND' ELSE 'SEND_MULTIPLE' END AS action, CASE WHEN count(DISTINCT mime_type) = 1 AND count(mime_type) = count(*) THEN max(mime_type) ELSE '*/*' END AS mime_type, "
    "count(*) AS n_files, true AS read_grant, string_agg(uri, '|' ORDER BY file_ord, uri) AS uris FROM g GROUP BY grp"
)
def share_bundles(spark, sf_dir):
    found = files(spark, sf_dir).selectExpr("CASE WHEN file_ord % 9 < 4 THEN file_ord % 97 ELSE 1000 + file_ord % 3 END AS grp", "CASE WHEN file_ord % 2 = 0 THEN 'image/png' ELSE mime_type END AS mime_type", "CASE WHEN file_ord % 5 > 0 THEN uri END AS uri", "file_ord")
    return selection.share_bundles(found, "grp").withColumn("uris", F.array_join("uris", "|"))


# ---- tracks, types and settings as tables -----------------------------------------------------------------------------

_TRACKS = (("video/mp4", 0), ("text/vtt", 1), ("audio/aac", 2), (None, 3), ("audio/opus", 4))
_SAMPLE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_SAMPLES = ("'file/' || CAST(l_orderkey % 40 AS STRING) AS uri", "CAST((l_partkey + l_orderkey % 3) % 5 AS INT) AS track", "CAST(l_quantity * 100 AS BIGINT) AS size_bytes", "l_linenumber AS flags")


def _samples(spark, sf_dir):
    """(samples, tracks): line items as samples of forty files; some files have no track that stays."""
    samples = _table(spark, sf_dir, "lineitem").selectExpr(*_SAMPLE_ORDER, *_SAMPLES)
    kinds = F.array(*[F.struct(F.lit(m).cast("string").alias("mime_type"), F.lit(t).alias("track")) for m, t in _TRACKS])
    held = samples.select("uri").distinct().select("uri", F.inline(kinds)).withColumn("mime_type", F.when(F.col("uri").endswith("7"), "text/vtt").otherwise(F.col("mime_type")))
    return samples, held


_TRACK_SQL = (
    f"WITH s AS (SELECT {', '.join(_SAMPLES)}, {', '.join(_SAMPLE_ORDER)} FROM lineitem), "
    "k(mime_type, track) AS (VALUES " + ", ".join(f"({_text(m) if m else 'NULL'}, {t})" for m, t in _TRACKS) + "), "
    "h AS (SELECT uri, track, CASE WHEN ends_with(uri, '7') THEN 'text/vtt' ELSE mime_type END AS mime_type FROM (SELECT DISTINCT uri FROM s), k), "
    "t AS (SELECT uri, track, row_number() OVER (PARTITION BY uri ORDER BY track) - 1 AS new_track FROM h WHERE mime_type LIKE 'video/%' OR mime_type LIKE 'audio/%')"
)


@query(f"{_TRACK_SQL} SELECT uri, track::INT AS track, new_track::INT AS new_track, NULL::VARCHAR AS error FROM t UNION ALL SELECT DISTINCT uri, NULL, NULL, '{tracks.NO_TRACKS}' FROM h WHERE uri NOT IN (SELECT uri FROM t)")
def track_map(spark, sf_dir):
    held = _samples(spark, sf_dir)[1]
    none = tracks.without_tracks(held).select("uri", F.lit(None).cast("int").alias("track"), F.lit(None).cast("int").alias("new_track"), "error")
    return tracks.track_map(held).withColumn("error", F.lit(None).cast("string")).unionByName(none)


@query(
    f"{_TRACK_SQL}, o AS (SELECT s.*, new_track, sum(size_bytes) OVER w - size_bytes AS old_start, sum(CASE WHEN new_track IS NULL THEN 0 ELSE size_bytes END) OVER w - CASE WHEN new_track IS NULL THEN 0 ELSE size_bytes END AS new_start "
    f"FROM s LEFT JOIN t USING (uri, track) WINDOW w AS (PARTITION BY uri ORDER BY {', '.join(_SAMPLE_ORDER)} ROWS UNBOUNDED PRECEDING)) "
    "SELECT uri, min(old_start)::BIGINT AS old_start, min(new_start)::BIGINT AS new_start, sum(size_bytes)::BIGINT AS length, count(*) AS n_samples, count(*) FILTER (flags & 1 <> 0) AS n_key_frames "
    "FROM o WHERE new_track IS NOT NULL GROUP BY uri, old_start - new_start"
)
def sample_ranges(spark, sf_dir):
    """Which bytes of each file are copied where when tracks go."""
    samples, held = _samples(spark, sf_dir)
    return tracks.copied_ranges(tracks.sample_map(samples, tracks.track_map(held), *_SAMPLE_ORDER))


@query(
    "WITH r AS (SELECT substr(md5(o_custkey::VARCHAR), 1, 1 + (o_orderkey % 4)::INT) AS prefix, '.e' || o_orderkey::VARCHAR AS extension, o_orderkey FROM orders WHERE o_orderkey % 7 > 0), "
    "t AS (SELECT DISTINCT md5(l_partkey::VARCHAR) AS mime_type FROM lineitem), f AS (SELECT mime_type, arg_min(extension, o_orderkey) AS first_rule, arg_max(extension, length(prefix) * 1000000000 - o_orderkey) AS longest FROM t JOIN r ON starts_with(mime_type, prefix) GROUP BY mime_type) "
    "SELECT mime_type, first_rule, longest, n FROM (SELECT md5(l_partkey::VARCHAR) AS mime_type, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN f USING (mime_type)"
)
def ext_by_rules(spark, sf_dir):
    """Extensions by some ten thousand rules for beginnings of types, by the first that fits and by the longest."""
    rules = _table(spark, sf_dir, "orders").where("o_orderkey % 7 > 0").selectExpr("substring(md5(CAST(o_custkey AS STRING)), 1, CAST(1 + o_orderkey % 4 AS INT)) AS prefix", "'.e' || o_orderkey AS extension", "o_orderkey AS rule_ord")
    types = _table(spark, sf_dir, "lineitem").selectExpr("md5(CAST(l_partkey AS STRING)) AS mime_type").groupBy("mime_type").agg(F.count(F.lit(1)).alias("n"))
    first = extensions.by_prefix(types, rules).withColumnRenamed("extension", "first_rule")
    return extensions.by_prefix(first, rules, longest=True).withColumnRenamed("extension", "longest")


_KNOWN_TYPES = (("text/html", ".html"), ("image/png", ".png"), ("text/html", ".htm"))


@query(
    "WITH t(mime_type, extension) AS (VALUES ('text/html', '.htm'), ('image/png', '.png')), p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'x/unknown' END AS mime_type, regexp_extract(url, '^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)', 3) AS path FROM pages) "
    "SELECT page_id, coalesce(extension, CASE WHEN contains(path, '.') THEN '.' || lower(regexp_extract(path, '[^.]*$')) ELSE '' END) AS extension FROM p LEFT JOIN t USING (mime_type)"
)
def ext_by_type(spark, sf_dir):
    """The extension of a file whose type is known, or else that in its uri."""
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", "url AS uri", "CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'x/unknown' END AS mime_type")
    return extensions.extension_of(pages, spark.createDataFrame(_KNOWN_TYPES, "mime_type string, extension string")).select("page_id", "extension")


_EDIT_KEYS = "CASE o_orderkey % 3 WHEN 0 THEN 'language' WHEN 1 THEN 'default_suffix' ELSE 'oled_mode' END"
_EDIT_VALUE = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"


@query(
    f"WITH e AS (SELECT o_custkey AS profile, {_EDIT_KEYS} AS key, {_EDIT_VALUE} AS value, o_orderkey % 4 + 1 AS version, o_orderkey FROM orders), "
    "c AS (SELECT profile, key, value, version FROM e QUALIFY row_number() OVER (PARTITION BY profile, key ORDER BY version DESC, o_orderkey DESC) = 1) "
    "SELECT phase, profile, key, value, version::BIGINT AS version FROM c, (VALUES ('log'), ('compacted')) a(phase) WHERE value IS NOT NULL"
)
def settings_log_state(spark, sf_dir):
    """Settings after four versions of edits, before and after compaction."""
    log, orders = new_path(spark, "settings"), _table(spark, sf_dir, "orders")
    for version in range(4):
        settings_log.append_edits(log, orders.where(f"o_orderkey % 4 = {version}").selectExpr("o_custkey AS profile", f"{_EDIT_KEYS} AS key", f"{_EDIT_VALUE} AS value", "o_orderkey AS edit_ord"))
    before = materialize(settings_log.current(spark, log).withColumn("phase", F.lit("log")), "settings-before")
    settings_log.compact(spark, log)
    return before.unionByName(settings_log.current(spark, log).withColumn("phase", F.lit("compacted")))


FLAGSHIP = change_counts
ADAPTER = adapter
