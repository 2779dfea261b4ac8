"""Files as Spark rows, by the binaryFile source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.names import sanitize_filename
from palimpsest.settings import Settings
from palimpsest.sources import codecs
from palimpsest.storage import ship

#: Types by extension, as the file source gives none.
TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "mp4": "video/mp4",
    "mov": "video/quicktime", "mp3": "audio/mpeg", "m4a": "audio/mp4", "ogg": "audio/ogg", "pdf": "application/pdf", "txt": "text/plain",
}
#: Larger files are error rows: a cell of a row batch holds less than 2 GB. A parameter of read_bytes.
MAX_BYTES = 1 << 30
#: Bytes of rewritten files after which a batch of them ends.
BATCH_BYTES = 4 << 20
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _typed(df: DataFrame, settings: Settings) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    mime = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), extension)
    return df.withColumns({"uri": F.col("path"), "display_name": sanitize_filename(F.col("path"), settings.now_ms), "mime_type": mime, "size_bytes": F.col("length")})


def _load(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """The files below ``paths``; none for no path."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


def catalog(spark: SparkSession, *paths: str, settings: Settings | None = None) -> DataFrame:
    """(uri, display_name, mime_type, size_bytes) of files; their bytes aren't read. A missing path is an error; Spark's file source lists no empty files."""
    return _typed(_load(spark, paths), settings or Settings()).select("uri", "display_name", "mime_type", "size_bytes")


def read_bytes(spark: SparkSession, *paths: str, settings: Settings | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The catalogue with a column content. Files above ``max_bytes`` have null content, which later is an error row, as a cell can't hold them."""
    found = _load(spark, paths)
    content = F.when(F.col("length") <= max_bytes, F.col("content"))
    return _typed(found, settings or Settings()).select("uri", "display_name", "mime_type", "size_bytes", content.alias("content"))


def _read_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uris, order, keys, values, errors = [], [], [], [], []
        for uri, mime, data in zip(*(batch.column(c).to_pylist() for c in ("uri", "mime_type", "content")), strict=True):
            try:
                rows = [(i, k, v, None) for i, (k, v) in enumerate(codecs.read(mime, data), 1)]
            except codecs.CodecError as e:
                rows = [(0, None, None, str(e))]
            for i, k, v, e in rows:
                uris.append(uri)
                order.append(i)
                keys.append(k)
                values.append(v)
                errors.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(order, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=["uri", "entry_ord", "key", "value", "error"])


def read_attributes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes, errors) of ``files`` with content: one bad file is a row of errors, never a failed job."""
    ship(files.sparkSession)
    rows = files.select("uri", "mime_type", "content").mapInArrow(_read_rows, "uri string, entry_ord int, key string, value string, error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("uri", "error")


def _rewrite_rows(keep_orientation: bool, thumbnail: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            uris, contents, errors = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(contents, pa.binary()), pa.array(["error" if e else "ok" for e in errors]), pa.array(errors, pa.string())], names=["uri", "content", "status", "error"])

        for batch in batches:
            done, held = [], 0
            for uri, mime, data, values in zip(*(batch.column(c).to_pylist() for c in ("uri", "mime_type", "content", "values")), strict=True):
                try:
                    new, error = codecs.rewrite(mime, data, {v["key"]: v["value"] for v in values or []}, keep_orientation, thumbnail), None
                except codecs.CodecError as e:
                    new, error = None, str(e)
                done.append((uri, new, error))
                held += len(new or b"")
                if held >= BATCH_BYTES:
                    yield rows(done)
                    done, held = [], 0
            if done:
                yield rows(done)

    return run


def rewrite_files(files: DataFrame, targets: DataFrame | None = None, keep_orientation: bool = True, thumbnail: str = "REMOVE") -> DataFrame:
    """(uri, content, status, error): ``files`` (uri, mime_type, content) without metadata, or with that of ``targets`` (uri, key, value).

    A file that can't be rewritten for certain has an error and no content: nothing leaves unstripped. Of repeated keys of a file the
    last counts, by entry_ord if ``targets`` has that column, and of those the largest value. ``thumbnail`` is REMOVE or KEEP_ORIGINAL.
    """
    ship(files.sparkSession)
    rows = files.select("uri", "mime_type", "content")
    if targets is None:
        rows = rows.withColumn("values", F.lit(None).cast("array<struct<key:string,value:string>>"))
    else:
        order = F.col("entry_ord") if "entry_ord" in targets.columns else F.lit(0)
        last = targets.where("key is not null and value is not null").groupBy("uri", "key").agg(F.max(F.struct(order.alias("at"), "value")).alias("last"))
        wanted = last.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("key", F.col("last.value").alias("value")))).alias("values"))
        rows = rows.join(wanted, "uri", "left")
    return rows.mapInArrow(_rewrite_rows(keep_orientation, thumbnail), "uri string, content binary, status string, error string")


def file_targets(plans: DataFrame) -> DataFrame:
    """What replacing writes into the bytes of each plan's file: (uri, key, value) with places as the formats hold them."""
    from palimpsest import tags
    from palimpsest.functions.types import media_class
    from palimpsest.operators.metadata import target_rows

    kind = media_class(F.col("mime_type"))

    def rational(c: str):
        ticks = F.round(F.abs(c) * 36_000_000).cast("bigint")
        whole = lambda x, n: F.floor(x / n).cast("bigint")
        return F.concat(whole(ticks, 36_000_000).cast("string"), F.lit("/1,"), (whole(ticks, 600_000) % 60).cast("string"), F.lit("/1,"), (ticks % 600_000).cast("string"), F.lit("/10000"))

    images = plans.where(kind == "image").withColumns({"latitude": rational("latitude"), "longitude": rational("longitude")})
    place = F.format_string("%+.4f%+.4f/", F.col("latitude").cast("float"), F.col("longitude").cast("float"))
    media = plans.where(kind.isin("video", "audio")).select("uri", F.lit(1).alias("entry_ord"), F.lit("Location").alias("key"), place.alias("value"))
    return target_rows(images, tags.IMAGE_TARGETS).unionByName(media).unionByName(target_rows(plans.where(kind == "pdf"), tags.PDF_TARGETS))
