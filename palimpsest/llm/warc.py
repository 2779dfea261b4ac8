"""WARC archives written from and read into a chunked record table.

A record is never held whole outside the cell it comes from: the writer takes
(record, chunk number, bytes) rows in order and streams them into a gzip member,
the reader streams members back into such rows, each with the SHA-1 of the
payload so far, so the last row of a record carries its digest and size.

Files go through ``pyarrow.fs`` to the shared folder. A task attempt writes a
file of its own name and reports it as a row; only files that a finished task
reported are in the manifest, so a lost executor's half-written file is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import lean, maybe_in, small_batches, spread_join
from palimpsest.storage import local_or_uri, materialize, new_path

CHUNK_BYTES = 256 << 10
MIN_REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
RECORD_URI = "urn:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

CHUNK_SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, chunk_no long, last boolean, data binary, bytes_so_far long, sha1_so_far string"


def _described(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest) of each row of ``pages``."""
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", url.cast("string").alias("url"), "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def find_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(large, revisits) from sizes and digests alone: rows (page_id, url, payload_bytes, payload_digest) of payloads of at least
    ``min_revisit`` bytes, and those of them that aren't the largest page_id of their payload, with that as refers_to."""
    large = materialize(_described(pages).drop("html").where(F.col("payload_bytes") >= min_revisit), "warc-large")
    same = ["payload_digest", "payload_bytes"]
    groups = large.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    grouped = spread_join(large, materialize(groups, "warc-groups"), *same).drop("rows")
    return large, materialize(grouped.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(*large.columns, "refers_to"), "warc-revisits")


def responses(pages: DataFrame, large: DataFrame, revisits: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> list[DataFrame]:
    """The rows of ``pages`` that keep their payload, as _described has them, in two parts, of which the second is empty or small.

    A filter over the revisits' keys lets all others stay where they are. Other keys that it takes for revisits are known from sizes and
    digests; without any, payloads are read once. Else a second filter, over those keys, tells which hits may be wrong, and only these few
    rows are read again and shuffled, to meet the revisits themselves.
    """
    key = ("page_id", "payload_digest")
    rows = _described(pages)
    hit = maybe_in(revisits, *key)
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["payload_digest"] == b["payload_digest"])
    suspects = large.where(hit).select(*key)
    innocent = materialize(suspects.join(revisits, same(suspects, revisits), "left_anti"), "warc-innocent")
    kept = rows.where((F.col("payload_bytes") < min_revisit) | ~hit)
    if innocent.isEmpty():
        return [kept, rows.limit(0)]
    doubted = rows.where((F.col("payload_bytes") >= min_revisit) & hit & maybe_in(innocent, *key))
    return [kept, doubted.join(revisits, same(doubted, revisits), "left_anti")]


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The payloads of ``pages`` (key, html) as rows (key, chunk_no, n_chunks, data); an empty payload is one empty chunk."""
    payload = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(chunk_bytes))).cast("int")
    cut = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return (
        payload.withColumn("n_chunks", n)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumn("data", cut)
        .drop("payload")
    )


def _id(value: object) -> str:
    return "" if value is None else str(value)


class _Gzip:
    """One gzip member per record into an open stream; counts what it wrote."""

    def __init__(self, out: object) -> None:
        self.out, self.at = out, 0

    def begin(self) -> None:
        self.z = zlib.compressobj(1, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        if part := self.z.compress(data):
            self.out.write(part)
            self.at += len(part)

    def end(self) -> None:
        part = self.z.flush()
        self.out.write(part)
        self.at += len(part)


def _header(row: dict) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{RECORD_URI}{_id(row['page_id'])}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}",
    ]
    if row["url"]:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if revisit:
        lines += [f"WARC-Refers-To: <{RECORD_URI}{_id(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        stream = gz = name = None
        files: list[tuple[str, int, int]] = []
        records = 0

        def close() -> None:
            nonlocal stream, records
            if stream is not None:
                stream.close()
                files.append((name, gz.at, records))
                stream, records = None, 0

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if stream is not None and gz.at >= file_bytes:
                        close()
                    if stream is None:
                        fs.create_dir(root, recursive=True)
                        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        stream = fs.open_output_stream(name, compression=None, buffer_size=1 << 20)
                        gz = _Gzip(stream)
                    gz.begin()
                    gz.write(_header(row))
                    records += 1
                gz.write(row["data"])
                if row["chunk_no"] == row["n_chunks"] - 1:
                    gz.write(b"\r\n\r\n")
                    gz.end()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())],
            names=["file", "bytes", "records"],
        )

    return write


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) under ``folder``; returns the manifest (file, bytes, records).

    Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id is a response with
    the payload, the others are revisits without it. Nulls: a null html is an empty payload; a null url leaves out the
    target; a null page_id is written as an empty id, below every id. Rows that repeat the largest page_id are all responses.
    Very long payloads are written in chunks of ``chunk_bytes``. Empty table: an empty manifest. Other columns aren't read.
    A payload is written by the task that reads it, revisits from digests alone; see :func:`responses`.
    """
    small_batches(pages.sparkSession)
    large, revisits = find_revisits(pages, min_revisit)
    none = F.lit(None).cast(pages.schema["page_id"].dataType)
    rows = revisits.select("page_id", "url", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", F.lit(None).cast("string").alias("html"))
    for part in responses(pages, large, revisits, min_revisit):
        rows = rows.unionByName(part.withColumns({"record_type": F.lit("response"), "refers_to": none}))
    return chunk_rows(rows, chunk_bytes).mapInArrow(lean(_writer(local_or_uri(folder), file_bytes)), "file string, bytes long, records long")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _inflated(stream: object, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, a bounded piece at a time."""
    z, rest, within = zlib.decompressobj(31), b"", False
    while data := rest or stream.read(step):
        if piece := z.decompress(data, step):
            yield piece
        rest, within = z.unconsumed_tail, True
        if z.eof:
            rest, z, within = z.unused_data, zlib.decompressobj(31), False
    if within:
        raise ValueError("truncated archive")


class _Feed:
    """Reads up to a mark or a number of bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.buffer = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer:
                    raise ValueError("truncated archive")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise ValueError("truncated archive")
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out


def read_records(stream: object, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA from one open archive, holding one chunk at a time. A revisit is one row with the digest of its header."""
    feed = _Feed(_inflated(stream))
    while (head := feed.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        block = int(f["content-length"])
        http = feed.until(b"\r\n\r\n")
        left = block - len(http) - 4
        record = f["warc-record-id"].strip("<>").removeprefix(RECORD_URI)
        about = (record, f["warc-type"], f["warc-refers-to"].strip("<>").removeprefix(RECORD_URI) if "warc-refers-to" in f else None, f.get("warc-target-uri"))
        if f["warc-type"] == "revisit":
            yield (*about, 0, True, None, int(f["warc-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"))
        else:
            digest, done, no = hashlib.sha1(), 0, 0
            while True:
                data = bytearray()
                while left and len(data) < chunk_bytes:
                    part = feed.take(min(left, chunk_bytes - len(data)))
                    data += part
                    left -= len(part)
                digest.update(data)
                done += len(data)
                yield (*about, no, not left, bytes(data) if with_data else None, done, digest.hexdigest())
                no += 1
                if not left:
                    break
            if digest.hexdigest() != f["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"record {record} doesn't have the digest of its header")
        if feed.until(b"\r\n\r\n"):
            raise ValueError(f"record {record} doesn't end where its header says")


def _reader(chunk_bytes: int, with_data: bool, last_only: bool, schema: pa.Schema, base: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(file, compression=None) as stream:
                    for row in read_records(stream, chunk_bytes, with_data):
                        if last_only and not row[5]:
                            continue
                        rows.append(row)
                        held += len(row[6] or b"") + 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return read


def read_warc(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True, last_only: bool = False) -> DataFrame:
    """The chunked record table (CHUNK_SCHEMA) of the archives in ``manifest``; ``last_only`` keeps each record's last row."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string())])
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(n).mapInArrow(lean(_reader(chunk_bytes, with_data, last_only, schema, local_or_uri(folder))), CHUNK_SCHEMA)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Nulls, empty and very long payloads, ties, repeated rows and empty tables are as in :func:`write_warc`.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = materialize(write_warc(pages, folder), "warc-manifest")
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast(pages.schema["page_id"].dataType))
    return read_warc(manifest, folder, with_data=False, last_only=True).select(
        number("record_id").alias("page_id"),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("sha1_so_far").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
