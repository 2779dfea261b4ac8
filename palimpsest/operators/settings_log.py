"""Settings that change: a log of edits in versions, of which the last one counts, and its compaction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import delete, exists, list_names, local_or_uri, move_new, new_path

EDITS = "profile bigint, key string, value string, edit_ord bigint"


def _numbered(spark: SparkSession, base: str, kind: str) -> list[int]:
    return sorted(int(m[1]) for n in (list_names(spark, base) if exists(spark, base) else []) if (m := re.fullmatch(rf"{kind}=(\d+)", n)))


def append_edits(log: str, edits: DataFrame) -> int:
    """Append ``edits`` (profile, key, value, edit_ord) as the next version of the log; its number.

    A null value takes a stored one away. Edits appear together, by one rename; of writers at a time each gets a version of its own.
    """
    spark, base = edits.sparkSession, local_or_uri(log)
    draft = f"{base}/_draft-{new_path(spark, 'edits').rpartition('-')[2]}"
    edits.select("profile", "key", "value", "edit_ord").write.parquet(draft)
    version = max([0, *_numbered(spark, base, "version"), *_numbered(spark, base, "state")]) + 1
    while not move_new(spark, draft, f"{base}/version={version}"):
        version += 1
    return version


def current(spark: SparkSession, log: str, upto: int | None = None) -> DataFrame:
    """(profile, key, value, version): what is stored after version ``upto`` (the last by default): the last state that is not later, and the edits after it.

    The latest edit of a key counts: by version, then edit_ord, then the largest value. Keys that were taken away aren't listed.
    """
    base = local_or_uri(log)
    states = [s for s in _numbered(spark, base, "state") if upto is None or s <= upto]
    edits = [v for v in _numbered(spark, base, "version") if v > max(states, default=0) and (upto is None or v <= upto)]
    rows = spark.createDataFrame([], f"{EDITS}, version bigint")
    for kind, numbers in (("state", states[-1:]), ("version", edits)):
        if numbers:
            found = spark.read.option("basePath", base).parquet(*[f"{base}/{kind}={n}" for n in numbers])
            rows = rows.unionByName(found.withColumn("version", F.col(kind).cast("bigint") if kind == "version" else F.col("version")).select(rows.columns))
    last = rows.groupBy("profile", "key").agg(F.max(F.struct("version", "edit_ord", "value")).alias("x"))
    return last.select("profile", "key", "x.value", "x.version").where("value is not null")


def compact(spark: SparkSession, log: str, keep: int = 0) -> int:
    """Write the state after the last version as a table and delete edits that are in it, but those of the last ``keep`` versions; the state's number.

    Reading before and after gives the same; a reader that began before and still needs what is deleted has to begin again. States before the last go too.
    """
    base = local_or_uri(log)
    versions = _numbered(spark, base, "version")
    upto = max([0, *versions, *_numbered(spark, base, "state")])
    if versions and upto == versions[-1]:
        draft = f"{base}/_draft-{new_path(spark, 'state').rpartition('-')[2]}"
        current(spark, log, upto).withColumn("edit_ord", F.lit(0).cast("bigint")).write.parquet(draft)
        if not move_new(spark, draft, f"{base}/state={upto}"):
            delete(spark, draft)
    for version in versions[: len(versions) - keep]:
        delete(spark, f"{base}/version={version}")
    for state in _numbered(spark, base, "state")[:-1]:
        delete(spark, f"{base}/state={state}")
    return upto
