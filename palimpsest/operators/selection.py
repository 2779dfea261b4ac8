"""Selections of files: distinct, removal, first and last, summaries, progress, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.types import uri_scheme

SYSTEM_LANGUAGE = "SYSTEM"


def content_uris(files: DataFrame, scheme: str = "content") -> DataFrame:
    """Rows whose uri has this scheme."""
    return files.where(uri_scheme(F.col("uri")) == scheme)


def distinct_uris(files: DataFrame) -> DataFrame:
    """One row per uri, of repeated ones the first by file_ord; file_ord stays that of the first."""
    rest = [c for c in files.columns if c not in ("uri", "file_ord")]
    return files.groupBy("uri").agg(F.min("file_ord").alias("file_ord"), *[F.min_by(c, "file_ord").alias(c) for c in rest]).select(files.columns)


def remove_from_selection(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose uri isn't in ``removed``: for files, entries, plans and results alike."""
    return rows.join(removed.select("uri").distinct(), "uri", "left_anti").select(rows.columns)


def selection_summary(files: DataFrame) -> DataFrame:
    """(n_files, total_size): null sizes count as 0; an empty selection has a total of 0."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).cast("bigint").alias("total_size"))


def share_mime(files: DataFrame, *group: str) -> DataFrame:
    """The type that all files of a group share, else */*; files without a type share none."""
    one = (F.count_distinct("mime_type") == 1) & (F.count("mime_type") == F.count(F.lit(1)))
    return files.groupBy(*group).agg(F.when(one, F.max("mime_type")).otherwise("*/*").alias("mime_type"))


def job_progress(results: DataFrame, *group: str) -> DataFrame:
    """(group, done, failed, total, percent) of results with a column status; percent is a whole number, 0 for no files."""
    done = F.count(F.when(F.col("status") == "ok", 1))
    counted = results.groupBy(*group).agg(done.alias("done"), F.count(F.lit(1)).alias("total"))
    percent = F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total"))).otherwise(0)
    return counted.select(*group, "done", (F.col("total") - F.col("done")).alias("failed"), "total", percent.cast("bigint").alias("percent"))


def progress_metrics() -> list[Column]:
    """done, failed, total and bytes of results with columns status and size_bytes, for ``DataFrame.observe``: counted by the job that writes them."""
    ok = F.col("status") == "ok"
    return [F.count(F.when(ok, 1)).alias("done"), F.count(F.when(~ok, 1)).alias("failed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes")]


def saved_message(results: DataFrame, *group: str, where: str = "") -> DataFrame:
    """(group, n_saved, message): null output paths aren't saved; no message for no results."""
    n = F.count("output_path")
    saved = F.concat(F.lit("Saved "), n.cast("string"), F.lit(f" file(s){where}"))
    return results.groupBy(*group).agg(n.alias("n_saved"), F.when(n > 0, saved).when(F.count(F.lit(1)) > 0, "Failed to save files").alias("message"))


def saved_uris(results: DataFrame, *group: str) -> DataFrame:
    """(group, n_saved, uris): the output paths that aren't null, in order of file_ord; none are an empty array."""
    saved = F.collect_list(F.when(F.col("output_path").isNotNull(), F.struct("file_ord", "output_path")))
    return results.groupBy(*group).agg(F.count("output_path").alias("n_saved"), F.transform(F.array_sort(saved), lambda x: x["output_path"]).alias("uris"))


def first_file(files: DataFrame, *group: str) -> DataFrame:
    """(group, uri): the first file by file_ord, of several with one file_ord that with the smallest uri."""
    return files.groupBy(*group).agg(F.min(F.struct("file_ord", "uri"))["uri"].alias("uri"))


def share_action(files: DataFrame, *group: str) -> DataFrame:
    """(group, action): nothing for no file, SEND for one, SEND_MULTIPLE for more."""
    n = F.count("uri")
    return files.groupBy(*group).agg(F.when(n == 1, "SEND").when(n > 1, "SEND_MULTIPLE").alias("action"))


def share_signature(files: DataFrame, *group: str) -> DataFrame:
    """(group, signature): the uris in their order, joined by bars; equal shares have equal signatures."""
    ordered = F.array_sort(F.collect_list(F.struct("file_ord", "uri")))
    return files.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["uri"]), "|").alias("signature"))


def share_bundles(files: DataFrame, *group: str) -> DataFrame:
    """(group, action, mime_type, n_files, read_grant, uris): what is handed over for each share of ``files`` (uri, mime_type, file_ord).

    One file goes alone with its own type, several go together with the type that all share; where there is none, as for a file without a type, */*.
    Rows without a uri don't count, and a share of none isn't listed. The receiver may read all of the uris, which stand in order of file_ord, then uri.
    """
    named = files.where("uri is not null")
    one = (F.count_distinct("mime_type") == 1) & (F.count("mime_type") == F.count(F.lit(1)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "uri"))), lambda x: x["uri"])
    bundle = named.groupBy(*group).agg(F.when(one, F.max("mime_type")).otherwise("*/*").alias("mime_type"), F.count(F.lit(1)).alias("n_files"), ordered.alias("uris"))
    return bundle.select(*group, F.when(F.col("n_files") == 1, "SEND").otherwise("SEND_MULTIPLE").alias("action"), "mime_type", "n_files", F.lit(True).alias("read_grant"), "uris")


def processed_with_files(processed: DataFrame, files: DataFrame) -> DataFrame:
    """Results with their files, joined by uri: a failed file never shifts the others."""
    return processed.join(files, "uri")


def language_of(codes: DataFrame, languages: DataFrame) -> DataFrame:
    """(code, language): the first language with this code, else SYSTEM."""
    first = languages.groupBy("code").agg(F.min_by("language", "language_ord").alias("language"))
    return codes.join(first, "code", "left").select("code", F.coalesce("language", F.lit(SYSTEM_LANGUAGE)).alias("language"))
