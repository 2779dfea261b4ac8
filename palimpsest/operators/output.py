"""Where results go and what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.names import output_name, random_base, split_name
from palimpsest.functions.types import media_class
from palimpsest.settings import APP_FOLDER, Settings


def join_path(path: Column, sub: Column) -> Column:
    """``path`` and ``sub`` with one slash between; a null ``sub`` leaves the path."""
    return F.when(sub.isNull(), path).when(F.endswith(path, F.lit("/")), F.concat(path, sub)).otherwise(F.concat(path, F.lit("/"), sub))


def route(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``files`` with configured_path, sub_path, relative_path, sink and collection.

    UNIFIED puts all under one path, with a folder per class on demand; SPLIT has a path per class. A path that is a tree
    (content://) goes to the tree sink with its sub folder, others to the media sink; images and videos have own collections there.
    """
    s = settings or Settings()
    kind = media_class(F.col("mime_type"))
    by_class = lambda image, video, audio, other: F.when(kind == "image", F.lit(image)).when(kind == "video", F.lit(video)).when(kind == "audio", F.lit(audio)).otherwise(F.lit(other))
    none = F.lit(None).cast("string")
    if s.folder_structure == "UNIFIED":
        path, sub = F.lit(s.unified_saving_path).cast("string"), by_class("Pictures", "Movies", "Music", "Documents") if s.use_subfolders_in_unified else none
    else:
        path, sub = by_class(s.pictures_saving_path, s.movies_saving_path, s.music_saving_path, s.documents_saving_path).cast("string"), none
    target = F.coalesce(path, F.lit(f"Download/{APP_FOLDER}"))
    tree = F.startswith(target, F.lit("content://"))
    return files.withColumns({
        "configured_path": path, "sub_path": sub, "relative_path": join_path(target, sub),
        "sink": F.when(tree, "tree").otherwise("media"),
        "collection": F.when(kind == "image", "Images").when(kind == "video", "Video").otherwise("Downloads"),
    })


def name_outputs(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``files`` (uri, display_name) with output_name."""
    s = settings or Settings()
    random = random_base(F.col("uri"), s.seed, s.now_ms) if s.use_random_file_names else None
    return files.withColumn("output_name", output_name(F.col("display_name"), s.default_prefix, s.default_suffix, random))


def unique_names(named: DataFrame, folder: str = "relative_path") -> DataFrame:
    """``named`` with output_name made unique in its folder: of equal names all but the one with the smallest uri get 16 hex digits of
    their uri's hash before the extension.

    The smallest uri of a name is a partial aggregate, and rows meet it by name and uri together, so the rows of a name that very many
    files share are in no one task. Repeated rows of a uri keep one name.
    """
    first = named.groupBy(F.col(folder).alias("__folder"), F.col("output_name").alias("__name")).agg(F.min("uri").alias("__first"))
    base, extension = split_name(F.col("output_name"))
    other = F.concat(base, F.lit("_"), F.substring(F.md5("uri"), 1, 16), extension)
    joined = named.join(first, F.col(folder).eqNullSafe(F.col("__folder")) & F.col("output_name").eqNullSafe(F.col("__name")) & (F.col("uri") == F.col("__first")), "left")
    return joined.withColumn("output_name", F.when(F.col("__first").isNotNull(), F.col("output_name")).otherwise(other)).select(named.columns)


def collisions(named: DataFrame, folder: str = "relative_path") -> DataFrame:
    """(folder, output_name, n_files, first_uri) of names that several files share; writing them would lose all but one."""
    return named.groupBy(folder, "output_name").agg(F.count(F.lit(1)).alias("n_files"), F.min("uri").alias("first_uri")).where("n_files > 1")
