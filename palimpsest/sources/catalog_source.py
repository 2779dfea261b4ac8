"""A catalogue of files as a data source: filters are pushed to the listing, content is read only if the schema has it.

    spark.dataSource.register(FileCatalog)
    spark.read.format("file_catalog").schema("path string, size_bytes bigint").load(folder)

One task lists each folder of the first level, with all that is below. Filters reach it if
``spark.sql.python.filterPushdown.enabled`` is set, as ``file_catalog`` does.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from palimpsest.storage import local_or_uri, ship

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COLUMNS = {"path": pa.string(), "name": pa.string(), "extension": pa.string(), "size_bytes": pa.int64(), "modified_ms": pa.int64(), "content": pa.binary()}
LISTING = "path string, name string, extension string, size_bytes bigint, modified_ms bigint"
#: Rows of a batch, and bytes of content after which it ends.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
_TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
}


def _extension(name: str) -> str:
    """What stands behind the last dot, unless nothing is before it."""
    base, _, extension = name.rpartition(".")
    return extension.lower() if base else ""


@dataclass
class Folder(InputPartition):
    """A folder that one task lists; files of its own only, unless ``deep``."""

    uri: str
    deep: bool


class CatalogReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str]) -> None:
        if unknown := set(columns) - set(COLUMNS):
            raise ValueError(f"no columns of a catalogue: {sorted(unknown)}")
        self.folder, self.columns, self.filters = local_or_uri(folder).rstrip("/"), columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            at = getattr(f, "attribute", ())
            column = at[0] if len(at) == 1 else ""
            if column in COLUMNS and column != "content" and isinstance(f, IsNotNull):
                continue  # no column is null
            if column in COLUMNS and column != "content" and type(f) in _TESTS and f.value is not None:
                self.filters.append((column, type(f), f.value))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        return all(_TESTS[kind](row[column], value) for column, kind, value in self.filters)

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        prefix = self.folder[: len(self.folder) - len(root)]
        below = [prefix + f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]
        starts = [value for column, kind, value in self.filters if column == "path" and kind is StringStartsWith]
        kept = [uri for uri in sorted(below) if all(f"{uri}/".startswith(s) or s.startswith(f"{uri}/") for s in starts)]
        return [Folder(self.folder, False), *[Folder(uri, True) for uri in kept]]

    def _content(self, fs: pafs.FileSystem, path: str) -> bytes:
        with fs.open_input_stream(path, compression=None) as stream:
            return stream.read()

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(partition.uri)
        prefix = partition.uri[: len(partition.uri) - len(root)]
        schema = pa.schema([(c, COLUMNS[c]) for c in self.columns])
        rows, held, folders = [], 0, [root]
        while folders:
            for f in fs.get_file_info(pafs.FileSelector(folders.pop())):
                if f.type == pafs.FileType.Directory:
                    folders += [f.path] if partition.deep else []
                    continue
                row = {"path": prefix + f.path, "name": f.base_name, "extension": _extension(f.base_name), "size_bytes": f.size, "modified_ms": int(f.mtime_ns or 0) // 1_000_000}
                if not self._wanted(row):
                    continue
                if "content" in self.columns:
                    row["content"] = self._content(fs, f.path)
                    held += len(row["content"])
                rows.append(row)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class FileCatalog(DataSource):
    """path, name, extension (lower case, without a dot), size_bytes, modified_ms and, if the schema names it, content of all files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_catalog"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(self.options["path"], schema.names)


def file_catalog(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The catalogue of a folder, empty and hidden files too, by the data source. Content is read only if it is one of ``columns``; a file of it has to fit into a cell.

    A missing folder is an error. Filters on the other columns are applied while listing, before any content is read: equality, order, sets,
    beginnings and ends of text. A filter on the beginning of a path also leaves out folders.
    """
    ship(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FileCatalog)
    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    schema = ", ".join(f"{c} {kinds[COLUMNS[c]]}" for c in columns) if columns else LISTING
    return spark.read.format("file_catalog").schema(schema).load(folder)
