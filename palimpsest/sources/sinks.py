"""Saving results as files of their own names: drafts, atomic moves, a manifest for each job, sweeping of what is left over.

A task writes a file under a pending name and moves it to its own when it is whole. What a job has saved is a table below
``_manifests``, written by Spark, so that it lists files of finished tasks only, and put in its place by one rename when all of them
are done. Readers go by manifests: of a job that failed they see nothing, and running it again under its name replaces its files
and then lists them. A job that is listed isn't run again. Files that no manifest lists are swept away once they are old enough.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.names import split_name
from palimpsest.operators.selection import progress_metrics
from palimpsest.storage import delete, exists, local_or_uri, materialize, move_new, ship

MANIFESTS, STAGED, PENDING = "_manifests", "_staged-", "pending-"
SAVED = "uri string, place string, output_path string, size_bytes bigint, sha256 string, status string, error string"
_SAVED = pa.schema([("uri", pa.string()), ("place", pa.string()), ("output_path", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string()), ("status", pa.string()), ("error", pa.string())])
#: Bytes of a file that are in memory at a time when it is copied.
COPY_BYTES = 1 << 20


class Draft:
    """A file that is being written, chunk after chunk. What goes wrong is kept for its row and undoes the file."""

    def __init__(self, fs: pafs.FileSystem, root: str, uri: str, place: str, n_chunks: int | None = 1) -> None:
        self.fs, self.uri, self.place, self.n_chunks = fs, uri, place, n_chunks
        self.path = f"{root}/{place}"
        folder = self.path.rpartition("/")[0]
        self.draft, self.size, self.seen, self.error, self.out = f"{folder}/{PENDING}{uuid.uuid4().hex}", 0, 0, None, None
        self.digest = hashlib.sha256()
        try:
            fs.create_dir(folder, recursive=True)
            self.out = fs.open_output_stream(self.draft, compression=None)
        except OSError as e:
            self.error = str(e)

    @property
    def whole(self) -> bool:
        return self.seen == self.n_chunks

    def add(self, number: int, content: bytes | None) -> None:
        if self.error is None and content is None:
            self.error = "no content"
        if self.error is None and number != self.seen:
            self.error = f"chunk {number} instead of {self.seen}"
        self.seen += 1
        if self.error is None:
            try:
                self.out.write(content)
                self.size += len(content)
                self.digest.update(content)
            except OSError as e:
                self.error = str(e)

    def finish(self) -> tuple:
        """The file's row, after it was moved to its name, or away."""
        if self.error is None and self.n_chunks is not None and not self.whole:
            self.error = f"{self.seen} of {self.n_chunks} chunks"
        try:
            if self.out is not None:
                self.out.close()
            if self.error is None:
                self.fs.move(self.draft, self.path)
            elif self.out is not None:
                self.fs.delete_file(self.draft)
        except OSError as e:
            self.error = self.error or str(e)
        if self.error is not None:
            return self.uri, self.place, None, None, None, "error", self.error
        return self.uri, self.place, self.path, self.size, self.digest.hexdigest(), "ok", None


def saved_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SAVED), _SAVED, strict=True)], schema=_SAVED)


def _write_rows(base: str):
    """Rows (uri, place, chunk_no, n_chunks, content), chunks of a file one after the other, to a row of each file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        draft: Draft | None = None
        for batch in batches:
            done = []
            for uri, place, number, n, content in zip(*(batch.column(c).to_pylist() for c in ("uri", "place", "chunk_no", "n_chunks", "content")), strict=True):
                if draft is not None and (draft.uri != uri or draft.place != place):
                    done.append(draft.finish())
                    draft = None
                if draft is None:
                    draft = Draft(fs, root, uri, place, n)
                draft.add(number, content)
                if draft.whole:
                    done.append(draft.finish())
                    draft = None
            yield saved_batch(done)
        if draft is not None:
            yield saved_batch([draft.finish()])

    return run


def _copy_rows(base: str):
    """Rows (uri, place, source) to a row of each file, which is read and written by COPY_BYTES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for uri, place, source in zip(*(batch.column(c).to_pylist() for c in ("uri", "place", "source")), strict=True):
                draft = Draft(fs, root, uri, place, None)
                try:
                    whence, path = pafs.FileSystem.from_uri(local_or_uri(source))
                    with whence.open_input_stream(path, compression=None) as stream:
                        while draft.error is None and (part := stream.read(COPY_BYTES)):
                            draft.add(draft.seen, part)
                except (OSError, pa.ArrowInvalid) as e:
                    draft.error = draft.error or str(e)
                yield saved_batch([draft.finish()])

    return run


def place_of(folder: Column, name: Column) -> Column:
    """Where a file goes below a job's folder: steps up, empty steps and slashes of a name don't count."""
    parts = F.filter(F.split(F.coalesce(folder, F.lit("")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(F.array_append(parts, F.replace(name, F.lit("/"), F.lit("_"))), "/")


def write_files(results: DataFrame, folder: str) -> DataFrame:
    """(uri, output_path, status, error): ``results`` (uri, relative_path, output_name, content) as files below ``folder``, without a manifest.

    A file appears whole or not at all: it is written under a pending name and then moved, so a task that runs again replaces it
    with the same bytes. Make names unique before. The folder is one that all executors share.
    """
    ship(results.sparkSession)
    rows = results.select("uri", place_of(F.col("relative_path"), F.col("output_name")).alias("place"), F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks"), "content")
    return rows.mapInArrow(_write_rows(local_or_uri(folder)), SAVED).select("uri", "output_path", "status", "error")


def _manifest(base: str, job: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9.-][A-Za-z0-9._-]*", job):
        raise ValueError(f"no name for a job: {job}")
    return f"{base}/{MANIFESTS}/job={job}"


def saved_files(spark: SparkSession, folder: str, *jobs: str) -> DataFrame:
    """The manifests of a folder, or of some jobs: job, uri, place, output_path, size_bytes, sha256, status, error. None are an empty table."""
    base = f"{local_or_uri(folder)}/{MANIFESTS}"
    if not exists(spark, base):
        return spark.createDataFrame([], f"{SAVED}, job string")
    rows = spark.read.schema(f"{SAVED}, job string").parquet(base)
    return rows.where(F.col("job").isin(*jobs)) if jobs else rows


def _apart(rows: DataFrame, base: str, job: str) -> DataFrame:
    """``rows`` (uri, place) with other places for those that files of other jobs have: 16 digits of a hash stand before the extension.

    Without other jobs in the folder nothing is joined. The names of some hundred thousand files are sent to all tasks, if Spark finds them that
    small; with more, rows are dealt out by name once.
    """
    others = saved_files(rows.sparkSession, base).where((F.col("job") != job) & (F.col("status") == "ok")).select("place").distinct()
    if others.isEmpty():
        return rows
    taken = materialize(others.withColumn("taken", F.lit(True)), "taken")
    folder = F.regexp_extract("place", "^(?s)(.*/)?", 1)
    stem, extension = split_name(F.regexp_extract("place", "(?s)[^/]*$", 0))
    other = F.concat(folder, stem, F.lit("_"), F.substring(F.md5(F.concat(F.lit(f"{job}:"), "uri")), 1, 16), extension)
    return rows.join(taken, "place", "left").withColumn("place", F.when(F.col("taken"), other).otherwise(F.col("place"))).drop("taken")


def _commit(written: DataFrame, base: str, job: str, progress: Observation | None) -> DataFrame:
    spark, target = written.sparkSession, _manifest(base, job)
    staged = f"{base}/{MANIFESTS}/{STAGED}{uuid.uuid4().hex}"
    if progress is not None:
        written = written.observe(progress, *progress_metrics())
    written.write.parquet(staged)
    twice = spark.read.schema(SAVED).parquet(staged).groupBy("place").count().where("count > 1").head()
    if twice is not None:
        raise ValueError(f"several results of job {job} are named {twice.place}; nothing is listed")
    if not move_new(spark, staged, target):
        delete(spark, staged)  # another run of the job was first
    return saved_files(spark, base, job)


def save_files(results: DataFrame, folder: str, job: str, progress: Observation | None = None) -> DataFrame:
    """Save ``results`` (uri, relative_path, output_name, content) below ``folder`` and list them under the name ``job``; the job's manifest.

    With columns chunk_no (from 0) and n_chunks, rows are pieces of files, brought together by uri and written in order, one piece in memory
    at a time, so a file may be larger than a cell. A result without content, or with a missing piece, is an error row and no file; two
    results of one name are an error of the job. Names that other jobs' files have in this folder are changed. A job that is listed already
    isn't run again. ``progress`` observes the writing job (``progress_metrics``). An empty table lists nothing.
    """
    spark, base = results.sparkSession, local_or_uri(folder)
    ship(spark)
    if exists(spark, _manifest(base, job)):
        return saved_files(spark, base, job)
    place = place_of(F.col("relative_path"), F.col("output_name")).alias("place")
    chunked = "chunk_no" in results.columns
    pieces = [F.col(c).cast("int").alias(c) for c in ("chunk_no", "n_chunks")] if chunked else [F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks")]
    rows = _apart(results.select("uri", place, *pieces, "content"), base, job)
    if chunked:
        rows = rows.repartition("place", "uri").sortWithinPartitions("place", "uri", "chunk_no")
    return _commit(rows.select("uri", "place", "chunk_no", "n_chunks", "content").mapInArrow(_write_rows(base), SAVED), base, job, progress)


def copy_files(files: DataFrame, folder: str, job: str, progress: Observation | None = None) -> DataFrame:
    """Like ``save_files`` for the bytes of ``files`` (uri, relative_path, output_name) as they are, whatever their size: no cell holds them.

    ``uri`` is a path or URI that the executors can open; one that they can't is an error row.
    """
    spark, base = files.sparkSession, local_or_uri(folder)
    ship(spark)
    if exists(spark, _manifest(base, job)):
        return saved_files(spark, base, job)
    rows = _apart(files.select("uri", place_of(F.col("relative_path"), F.col("output_name")).alias("place")), base, job)
    return _commit(rows.select("uri", "place", F.col("uri").alias("source")).mapInArrow(_copy_rows(base), SAVED), base, job, progress)


def _list_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, folder = pafs.FileSystem.from_uri(path)
            prefix = path[: len(path) - len(folder)]
            found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            columns = [[prefix + f.path for f in found], [f.type == pafs.FileType.Directory for f in found], [f.size if f.is_file else None for f in found], [int(f.mtime_ns // 1_000_000) if f.mtime_ns else None for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["path", "is_folder", "size_bytes", "modified_ms"])


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, modified_ms) of all files below ``folder``, empty and hidden ones too; manifests of jobs aren't listed.

    Tasks list the folders of one level at a time, so the number of jobs is the depth of the tree.
    """
    ship(spark)
    now = spark.createDataFrame([(local_or_uri(folder),)], "path string")
    levels = []
    while True:
        level = materialize(now.repartition("path").mapInArrow(_list_rows, "path string, is_folder boolean, size_bytes bigint, modified_ms bigint"), "listing")
        levels.append(level.where("not is_folder").drop("is_folder"))
        now = level.where(F.col("is_folder") & ~F.contains("path", F.lit(f"/{MANIFESTS}/job="))).select("path")
        if now.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def leftovers(listing: DataFrame, listed: DataFrame, before_ms: int) -> DataFrame:
    """(path, reason): files of ``listing`` (path, modified_ms) older than ``before_ms`` that aren't in ``listed`` (path): drafts and unlisted files."""
    name = F.substring_index("path", "/", -1)
    old = listing.where(F.col("modified_ms") < before_ms).join(listed.select("path").distinct(), "path", "left_anti")
    reason = F.when(F.startswith(name, F.lit(PENDING)), "draft").when(F.contains("path", F.lit(f"/{MANIFESTS}/{STAGED}")), "staged").otherwise("unlisted")
    return old.select("path", reason.alias("reason"))


def _delete_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for path in batch.column("path").to_pylist():
            try:
                fs, at = pafs.FileSystem.from_uri(path)
                fs.delete_file(at)
                gone.append(True)
            except OSError:
                gone.append(False)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("reason"), pa.array(gone, pa.bool_())], names=["path", "reason", "deleted"])


def sweep(spark: SparkSession, folder: str, before_ms: int) -> DataFrame:
    """Delete what no manifest of ``folder`` lists and what is older than ``before_ms``: (path, reason, deleted). Choose a time before that of any running job."""
    base = local_or_uri(folder)
    root = pafs.FileSystem.from_uri(base)[1]
    prefix = base[: len(base) - len(root)]
    listed = saved_files(spark, base).where("status = 'ok'").select(F.concat(F.lit(prefix), "output_path").alias("path"))
    found = leftovers(list_folder(spark, folder), listed, before_ms)
    return materialize(found.mapInArrow(_delete_rows, "path string, reason string, deleted boolean"), "swept")
