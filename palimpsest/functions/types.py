"""What a MIME type or a URI says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.tags import EXTENSIONS, OTHER_EXTENSION, PDF_EXTENSION, PDF_TYPE


def begins(text: Column, start: str) -> Column:
    """Whether ``text`` begins with ``start``; null does not."""
    return F.coalesce(F.startswith(text, F.lit(start)), F.lit(False))


def media_class(mime: Column) -> Column:
    """image, video, audio, pdf or other."""
    return (
        F.when(begins(mime, "image/"), "image").when(begins(mime, "video/"), "video").when(begins(mime, "audio/"), "audio")
        .when(mime == PDF_TYPE, "pdf").otherwise("other")
    )


def extension_from_mime(mime: Column) -> Column:
    """The usual extension of a MIME type."""
    out = F.when(begins(mime, EXTENSIONS[0][0]), EXTENSIONS[0][1])
    for start, extension in EXTENSIONS[1:]:
        out = out.when(begins(mime, start), extension)
    return out.when(mime == PDF_TYPE, PDF_EXTENSION).otherwise(OTHER_EXTENSION)


def uri_scheme(uri: Column) -> Column:
    """What stands before the first colon, null if there is none."""
    return F.when(F.contains(uri, F.lit(":")), F.substring_index(uri, ":", 1))


def uri_path(uri: Column) -> Column:
    """The path of a URI without scheme, authority, query and fragment."""
    return F.regexp_extract(uri, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def extension_from_uri(uri: Column) -> Column:
    """A dot and what stands behind the last dot of the path, in lower case; empty if there is no dot or no path."""
    path = uri_path(uri)
    return F.when(F.contains(path, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("")
