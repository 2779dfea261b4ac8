"""Tracks and samples of media that are written anew: which tracks stay, where their samples go, which bytes are copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.types import begins
from palimpsest.operators.packing import running_sums

#: The bit of a sample that is read at any point, as it is read and as it is written. Other bits aren't written.
SYNC, KEY_FRAME = 1, 1
NO_TRACKS = "No valid video or audio tracks found"


def written_flags(flags: Column) -> Column:
    """The flags with which a sample is written; null flags are none."""
    return F.when(F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(SYNC)) != 0, F.lit(KEY_FRAME)).otherwise(F.lit(0))


def track_map(tracks: DataFrame) -> DataFrame:
    """(uri, track, new_track): the video and audio tracks of ``tracks`` (uri, track, mime_type), numbered from 0 in their order in each file."""
    kept = tracks.where(begins(F.col("mime_type"), "video/") | begins(F.col("mime_type"), "audio/")).select("uri", "track").distinct()
    return kept.withColumn("new_track", F.row_number().over(Window.partitionBy("uri").orderBy("track")) - 1)


def without_tracks(tracks: DataFrame) -> DataFrame:
    """(uri, error): files of which no track can be written."""
    return tracks.select("uri").distinct().join(track_map(tracks).select("uri").distinct(), "uri", "left_anti").withColumn("error", F.lit(NO_TRACKS))


def sample_map(samples: DataFrame, tracks: DataFrame, *order: str) -> DataFrame:
    """The samples of ``samples`` (uri, track, size_bytes, flags and the columns of ``order``) that are written, with new_track, old_start, new_start and new_flags.

    Starts are offsets among the sample bytes of their file, before and after, in ``order``, by which samples of a file differ. They are running
    sums over ranges of (uri, order), so a file of very many samples is no single task. Samples of tracks that ``tracks`` (``track_map``) lacks go.
    """
    marked = samples.join(tracks, ["uri", "track"], "left").withColumns({"old": F.coalesce("size_bytes", F.lit(0)).cast("bigint"), "new": F.when(F.col("new_track").isNotNull(), F.coalesce("size_bytes", F.lit(0))).otherwise(0).cast("bigint")})
    summed = running_sums(marked, ("old", "new"), "uri", *order)
    first = summed.groupBy("uri").agg(F.min("old_before").alias("__old"), F.min("new_before").alias("__new"))
    placed = summed.join(first, "uri").where(F.col("new_track").isNotNull())
    starts = {"old_start": F.col("old_before") - F.col("__old"), "new_start": F.col("new_before") - F.col("__new"), "new_flags": written_flags(F.col("flags"))}
    return placed.withColumns(starts).select(*samples.columns, "new_track", *starts)


def copied_ranges(placed: DataFrame) -> DataFrame:
    """(uri, old_start, new_start, length, n_samples, n_key_frames): runs of samples that lie together before and after, so that each is one copy.

    Samples of one run have lost the same number of bytes before them, so runs are groups, without a window over a file.
    """
    run = placed.groupBy("uri", (F.col("old_start") - F.col("new_start")).alias("lost"))
    return run.agg(
        F.min("old_start").alias("old_start"), F.min("new_start").alias("new_start"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("bigint").alias("length"),
        F.count(F.lit(1)).alias("n_samples"), F.count(F.when(F.col("new_flags") != 0, 1)).alias("n_key_frames"),
    ).drop("lost")
