"""Extensions of files by tables of types, large as they may be."""

from __future__ import annotations

import mimetypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import tags
from palimpsest.functions.types import extension_from_uri


def fixed_rules(spark: SparkSession) -> DataFrame:
    """(prefix, extension, rule_ord): the rules by which a type's beginning gives the extension, in their order; the PDF rule holds for the whole type alone elsewhere."""
    return spark.createDataFrame([(p, e, i) for i, (p, e) in enumerate(tags.EXTENSIONS)], "prefix string, extension string, rule_ord int")


def public_types(spark: SparkSession) -> DataFrame:
    """(mime_type, extension): the usual extension of each type in the public table that Python's standard library comes with."""
    table = mimetypes.MimeTypes((), strict=True)
    types = sorted(set(table.types_map[1].values()))
    return spark.createDataFrame([(t, table.guess_extension(t)) for t in types], "mime_type string, extension string")


def by_prefix(files: DataFrame, rules: DataFrame, longest: bool = False) -> DataFrame:
    """``files`` (mime_type, ...) with ``extension`` by the first of ``rules`` (prefix, extension, rule_ord) with whose prefix the type begins; null without one.

    Of the rules of one prefix only the first can hold, so one is left of each before they meet types. Each different type is taken once, and its
    beginnings of as many characters as some prefix has are looked up by equality: work grows with types times lengths of prefixes, not with
    types times rules. With ``longest`` the longest prefix wins, then the first. An empty prefix holds for every type, none for a null type.
    """
    firsts = rules.where("prefix is not null").groupBy("prefix").agg(F.min(F.struct("rule_ord", "extension")).alias("rule"))
    lengths = firsts.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row
    types = files.select("mime_type").where("mime_type is not null").distinct()
    beginnings = types.crossJoin(F.broadcast(lengths)).select("mime_type", F.explode(F.filter("lengths", lambda n: n <= F.length("mime_type"))).alias("n"))
    found = beginnings.withColumn("prefix", F.expr("substring(mime_type, 1, n)")).join(firsts, "prefix")
    order = F.struct(-F.col("n"), "rule") if longest else F.col("rule")
    one = found.groupBy("mime_type").agg(F.min_by("rule.extension", order).alias("extension"))
    return files.join(one, "mime_type", "left").select(*files.columns, "extension")


def extension_of(files: DataFrame, types: DataFrame) -> DataFrame:
    """``files`` (uri, mime_type, ...) with ``extension``: that of the type in ``types`` (mime_type, extension), else what stands in the path of the uri, else empty.

    Extensions have their dot. Of several rows of ``types`` for a type the smallest extension counts.
    """
    one = types.where("mime_type is not null").groupBy("mime_type").agg(F.min("extension").alias("__extension"))
    return files.join(one, "mime_type", "left").withColumn("extension", F.coalesce("__extension", extension_from_uri(F.col("uri")), F.lit(""))).select(*files.columns, "extension")
