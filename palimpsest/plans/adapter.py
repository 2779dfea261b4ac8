"""File records derived from ``documents``, as the driver's tables hold no files.

The rules are SQL expressions that Spark and DuckDB read alike, so a query and its oracle start from the same records and
differ in everything that follows. Types cycle by doc_id; sizes, values and keys are missing or blank now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: MIME type and extension by doc_id % 8.
TYPES = (
    ("image/jpeg", ".jpg"), ("image/png", ".png"), ("image/heic", ".heic"), ("video/mp4", ".mp4"), ("audio/mpeg", ".mp3"),
    ("application/pdf", ".pdf"), ("text/plain", ".txt"), (None, ""),
)

_mime = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(TYPES) if m) + " END"
_extension = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(TYPES)) + " END"
_id, _n = "CAST(doc_id AS STRING)", "CAST(n_chars AS STRING)"
_moment = "'2023:0' || CAST(1 + doc_id % 9 AS STRING) || ':1' || CAST(doc_id % 10 AS STRING) || ' 10:00:00'"

#: Columns of the catalogue.
FILE_COLUMNS = {
    "file_ord": "CAST(doc_id AS INT)",
    "uri": f"'content://docs/' || {_id}",
    "display_name": f"source || '/' || lang || ' ' || {_id} || {_extension}",
    "mime_type": _mime,
    "size_bytes": "CASE WHEN doc_id % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE n_chars END",
}

IMAGE, MEDIA, PDF = "doc_id % 8 < 3", "doc_id % 8 IN (3, 4)", "doc_id % 8 = 5"
#: Attributes of files: (which, key, value); a null value is no attribute.
ATTRIBUTES = (
    (IMAGE, "Artist", "source"),
    (IMAGE, "Copyright", "CASE WHEN doc_id % 3 > 0 THEN '(c) ' || source END"),
    (IMAGE, "DateTime", _moment),
    (IMAGE, "DateTimeOriginal", _moment),
    (IMAGE, "ImageDescription", "CASE WHEN doc_id % 5 = 0 THEN '   ' ELSE lang || ' ' || source END"),
    (IMAGE, "ImageLength", _n),
    (IMAGE, "ImageWidth", _n),
    (IMAGE, "Make", "'Maker ' || CAST(doc_id % 4 AS STRING)"),
    (IMAGE, "Model", "'Model ' || CAST(doc_id % 16 AS STRING)"),
    (IMAGE, "Orientation", "CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 7 < 5 THEN CAST(1 + doc_id % 7 AS STRING) END"),
    (IMAGE, "Software", "lang"),
    (IMAGE, "GPSLatitude", "CASE WHEN doc_id % 2 = 0 THEN '45/1,30/1,0/1' END"),
    (IMAGE, "GPSLatitudeRef", "CASE WHEN doc_id % 2 = 0 THEN 'N' END"),
    (IMAGE, "GPSLongitude", "CASE WHEN doc_id % 4 = 0 THEN '7/1,' || CAST(doc_id % 60 AS STRING) || '/1,33/2' WHEN doc_id % 4 = 2 THEN 'unknown' END"),
    (IMAGE, "GPSLongitudeRef", "CASE WHEN doc_id % 4 = 0 THEN 'W' END"),
    (IMAGE, "GPSAltitude", "'120/1'"),
    (IMAGE, "GPSDateStamp", "'2023:01:01'"),
    (IMAGE, "LensModel", "'Lens ' || CAST(doc_id % 6 AS STRING)"),
    (IMAGE, "BodySerialNumber", f"'SN' || {_id}"),
    (IMAGE, "CameraOwnerName", "source"),
    (IMAGE, "MakerNote", f"'note ' || {_id}"),
    (IMAGE, "JPEGInterchangeFormat", "'100'"),
    (IMAGE, "JPEGInterchangeFormatLength", "'2000'"),
    (IMAGE, "Make", "CASE WHEN doc_id % 9 = 0 THEN 'Second maker' END"),
    (MEDIA, "Title", "source"),
    (MEDIA, "Artist", "CASE WHEN doc_id % 3 > 0 THEN lang END"),
    (MEDIA, "Album", "CASE WHEN doc_id % 8 = 4 THEN source || ' ' || lang END"),
    (MEDIA, "Date", "'20230101T000000.000Z'"),
    (MEDIA, "Location", "CASE WHEN doc_id % 5 > 1 THEN '+45.5000-120.2500/' END"),
    (MEDIA, "HasVideo", "CASE WHEN doc_id % 8 = 3 THEN 'yes' ELSE 'no' END"),
    (MEDIA, "Width", "CASE WHEN doc_id % 6 > 0 THEN '1920' END"),
    (MEDIA, "Height", "'1080'"),
    (MEDIA, "DurationMs", f"CASE WHEN doc_id % 13 = 0 THEN 'unknown' WHEN doc_id % 13 > 1 THEN {_n} END"),
    (PDF, "PageCount", "CAST(1 + doc_id % 50 AS STRING)"),
    (PDF, "Title", "source"),
    (PDF, "Author", "lang"),
    (PDF, "Subject", "CASE WHEN doc_id % 3 = 0 THEN 'about ' || lang END"),
    (PDF, "Creator", "'Writer'"),
    (PDF, "Xmp", "'<xmp>' || lang || '</xmp>'"),
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: file_ord, uri, display_name, mime_type, size_bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*[f"{e} AS {c}" for c, e in FILE_COLUMNS.items()])


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files hold: uri, entry_ord, key, value."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ", ".join(f"struct({i} AS entry_ord, '{k}' AS key, CASE WHEN {w} THEN {v} END AS value)" for i, (w, k, v) in enumerate(ATTRIBUTES, 1))
    return docs.selectExpr(f"{FILE_COLUMNS['uri']} AS uri", f"inline(array({rows}))").where(F.col("value").isNotNull())


#: The same records as DuckDB common table expressions: files and attrs.
CTES = (
    "files AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FILE_COLUMNS.items()) + " FROM documents),\nattrs AS (SELECT * FROM (SELECT "
    + FILE_COLUMNS["uri"] + " AS uri, unnest([" + ", ".join(f"{{'entry_ord': {i}, 'key': '{k}', 'value': CASE WHEN {w} THEN {v} END}}" for i, (w, k, v) in enumerate(ATTRIBUTES, 1))
    + "], recursive := true) FROM documents) WHERE value IS NOT NULL)"
)
