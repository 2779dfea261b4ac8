"""File content of any size as rows (uri, chunk_no, n_chunks, content).

A file's ranges are rows before a byte is read, so several tasks share a large file and none holds more than a chunk of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import local_or_uri, ship

CHUNK_BYTES = 4 << 20


def chunk_ranges(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` (uri, size_bytes, ...) with a row for each chunk: chunk_no, n_chunks, start, length. An empty file has one empty chunk, one of unknown size none."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size_bytes") / F.lit(chunk_bytes)).cast("int"))
    rows = files.where("size_bytes is not null").withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk_no").cast("bigint") * chunk_bytes
    return rows.withColumns({"start": start, "length": F.least(F.lit(chunk_bytes), F.col("size_bytes") - start)})


def _range_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        opened: tuple[str | None, pa.NativeFile | None, str | None] = (None, None, None)
        for i, (source, start, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "start", "length")), strict=True)):
            if source != opened[0]:
                if opened[1] is not None:
                    opened[1].close()
                try:
                    fs, path = pafs.FileSystem.from_uri(local_or_uri(source))
                    opened = (source, fs.open_input_file(path), None)
                except (OSError, pa.ArrowInvalid) as e:
                    opened = (source, None, str(e))
            content, error = None, opened[2]
            if error is None:
                try:
                    content = opened[1].read_at(length, start)
                    if len(content) != length:
                        content, error = None, f"{len(content)} of {length} bytes at {start}"
                except OSError as e:
                    error = str(e)
            columns = [batch.column(c)[i : i + 1] for c in ("uri", "chunk_no", "n_chunks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["uri", "chunk_no", "n_chunks", "content", "error"])
        if opened[1] is not None:
            opened[1].close()


def read_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, source: str = "uri") -> DataFrame:
    """(uri, chunk_no, n_chunks, content, error): the bytes of ``files`` (uri, size_bytes), read by ranges from the path or URI in ``source``.

    Ranges are dealt out, so a large file's are read by several tasks. A range that can't be read whole has an error and no content.
    """
    ship(files.sparkSession)
    ranges = chunk_ranges(files.select("uri", F.col(source).alias("source"), "size_bytes"), chunk_bytes)
    dealt = ranges.repartition("source", F.floor(F.col("chunk_no") / 16))
    return dealt.select("uri", "source", "chunk_no", "n_chunks", "start", "length").mapInArrow(_range_rows, "uri string, chunk_no int, n_chunks int, content binary, error string")


def content_chunks(contents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``contents`` (content: binary, ...) with a row for each chunk of the content: chunk_no, n_chunks, content. A null content is one null chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("content"), F.lit(0)) / F.lit(chunk_bytes)).cast("int"))
    rows = contents.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("content", F.substring("content", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))


def _digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by uri and chunk_no to a row of each file; a file may go on in the next batch."""
    now: tuple | None = None  # uri, chunks, chunks seen, bytes, digest

    def row(uri, n, seen, size, digest) -> tuple:
        whole = seen == n
        return uri, size if whole else None, digest.hexdigest() if whole else None, None if whole else f"{max(seen, 0)} of {n} chunks"

    for batch in batches:
        done = []
        for uri, number, n, content in zip(*(batch.column(c).to_pylist() for c in ("uri", "chunk_no", "n_chunks", "content")), strict=True):
            if now is None or now[0] != uri:
                if now is not None:
                    done.append(row(*now))
                now = (uri, n, 0, 0, hashlib.sha256())
            _, n, seen, size, digest = now
            if number == seen and content is not None:
                digest.update(content)
                now = (uri, n, seen + 1, size + len(content), digest)
            elif number >= seen:
                now = (uri, n, -1, size, digest)  # a piece is missing, so no later one fits either
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["uri", "size_bytes", "sha256", "error"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(*now), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["uri", "size_bytes", "sha256", "error"])


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(uri, size_bytes, sha256, error) of each file in ``chunks`` (uri, chunk_no, n_chunks, content): a running digest over its chunks in order.

    A chunk that occurs twice counts once; a file that lacks one has an error and neither size nor digest.
    """
    ship(chunks.sparkSession)
    ordered = chunks.select("uri", "chunk_no", "n_chunks", "content").repartition("uri").sortWithinPartitions("uri", "chunk_no")
    return ordered.mapInArrow(_digest_rows, "uri string, size_bytes bigint, sha256 string, error string")
