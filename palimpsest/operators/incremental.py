"""Recomputing only what changed: fingerprints of each file's inputs decide which results of the last run still hold."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.settings import Settings
from palimpsest.storage import exists, list_names, local_or_uri, move_new

NEW, CHANGED, REMOVED, SAME = "new", "changed", "removed", "same"


def fingerprints(files: DataFrame, attributes: DataFrame, settings: Settings | None = None, plans: DataFrame | None = None) -> DataFrame:
    """(uri, fingerprint) for each uri of ``files``: a SHA-256 over the file's record, its attributes, its plan and the settings.

    Attributes count in any order, each as often as it occurs; of repeated records and plans of a uri the largest counts. Whatever a result depends on has
    to be a column of these tables or a setting.
    """
    text = lambda df: F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != "uri"]), {"ignoreNullFields": "false"})
    records = files.select("uri", text(files).alias("record")).groupBy("uri").agg(F.max("record").alias("record"))
    held = attributes.select("uri", text(attributes).alias("row")).groupBy("uri").agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("held"))
    out = records.join(held, "uri", "left")
    if plans is not None:
        out = out.join(plans.select("uri", text(plans).alias("plan")).groupBy("uri").agg(F.max("plan").alias("plan")), "uri", "left")
    else:
        out = out.withColumn("plan", F.lit(None).cast("string"))
    options = F.lit(json.dumps(asdict(settings or Settings()), sort_keys=True))
    parts = [F.coalesce(c, F.lit("-")) for c in ("record", "held", "plan")]
    # Lengths stand before the parts, so that no two different triples read alike.
    return out.select("uri", F.sha2(F.concat(options, *[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256).alias("fingerprint"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, change): how the fingerprints ``new`` (uri, fingerprint) differ from ``old``; each has a uri once."""
    both = old.select("uri", F.col("fingerprint").alias("was")).join(new.select("uri", F.col("fingerprint").alias("is")), "uri", "full")
    change = F.when(F.col("was").isNull(), NEW).when(F.col("is").isNull(), REMOVED).when(F.col("was") != F.col("is"), CHANGED).otherwise(SAME)
    return both.select("uri", change.alias("change"))


def _versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(m[1]) for n in (list_names(spark, base) if exists(spark, base) else []) if (m := re.fullmatch(r"version=(\d+)", n)))


def stored(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame] | None:
    """(fingerprints, results) of the newest version in ``store``; None if there is none."""
    base = local_or_uri(store)
    versions = _versions(spark, base)
    if not versions:
        return None
    at = f"{base}/version={versions[-1]}"
    return spark.read.parquet(f"{at}/fingerprints"), spark.read.parquet(f"{at}/results")


def refresh(store: str, prints: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, changes): the results in ``store`` brought up to date with ``prints`` (uri, fingerprint), as a new version of the store.

    ``compute`` gives the results (uri, ...) for a table of uris; it is called with those that are new or changed. Results of other
    uris are taken over, those of removed ones go. Without a version yet all are computed. A version appears by one rename,
    with its fingerprints and results together: a refresh that fails leaves the last one, and of two at a time one is an error.
    """
    spark, base = prints.sparkSession, local_or_uri(store)
    versions = _versions(spark, base)
    draft = f"{base}/_draft-{uuid.uuid4().hex}"
    prints.write.parquet(f"{draft}/fingerprints")
    now, last = spark.read.parquet(f"{draft}/fingerprints"), stored(spark, store)
    before = last[0] if last else spark.createDataFrame([], now.schema)
    changes(before, now).write.parquet(f"{draft}/changes")
    changed = spark.read.parquet(f"{draft}/changes")
    computed = compute(changed.where(F.col("change").isin(NEW, CHANGED)).select("uri"))
    if last:
        kept = last[1].join(changed.where(F.col("change") == SAME).select("uri"), "uri", "left_semi")
        computed = computed.unionByName(kept.select(computed.columns))
    computed.write.parquet(f"{draft}/results")
    at = f"{base}/version={versions[-1] + 1 if versions else 1}"
    if not move_new(spark, draft, at):
        raise RuntimeError(f"{at} was made meanwhile; refresh again")
    return spark.read.parquet(f"{at}/results"), spark.read.parquet(f"{at}/changes")
