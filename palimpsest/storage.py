"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs
at most the tasks that were running: everything before is in shared storage.
The folder is the one the cluster names in ``spark.checkpoint.dir``; a local
folder is used only when that is unset and the master is a plain local one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}
_SHIPPED: set[str] = set()
_LOCAL: list[str] = []


def _local_folder() -> str:
    """A folder of the driver's own, deleted when it ends."""
    _LOCAL.append(tempfile.mkdtemp(prefix="palimpsest-"))
    return _LOCAL[-1]


def ship(spark: SparkSession) -> None:
    """Send this package to the application's Python workers, once, so that they need no path of their own to it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(_local_folder()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir`` (made on first use)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + _local_folder()
        _ROOTS[app] = (spark, f"{base.rstrip('/')}/palimpsest-{app}-{uuid.uuid4().hex[:8]}")
    return _ROOTS[app][1]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back (its plan is then one scan)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._palimpsest_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_palimpsest_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder, not below."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(s.getPath().getName() for s in found)


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder unless ``target`` exists; whether it was renamed. Atomic where the file system's rename is."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(old, new, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def local_or_uri(path: str) -> str:
    """``path`` as a URI, which file-system libraries outside the JVM accept."""
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


@atexit.register
def _clean() -> None:
    for spark, root in _ROOTS.values():
        try:
            delete(spark, root)
        except Exception:  # noqa: BLE001  the JVM may be gone; the cluster's own expiry then applies
            pass
    for folder in _LOCAL:
        shutil.rmtree(folder, ignore_errors=True)
