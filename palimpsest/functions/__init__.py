"""Column functions: names, types, labels, seeded choice."""

from palimpsest.functions.labels import duration_label, hemisphere, location_text, parse_double, parse_long, resolution_label, size_label, size_number
from palimpsest.functions.names import blank, output_name, random_base, sanitize_filename, sanitize_simple, split_name
from palimpsest.functions.seeded import chosen, hash32, picked, shuffled, whole
from palimpsest.functions.types import extension_from_mime, extension_from_uri, media_class, uri_scheme

__all__ = [
    "blank", "chosen", "duration_label", "extension_from_mime", "extension_from_uri", "hash32", "hemisphere", "location_text", "media_class",
    "output_name", "parse_double", "parse_long", "picked", "random_base", "resolution_label", "sanitize_filename", "sanitize_simple", "shuffled",
    "size_label", "size_number", "split_name", "uri_scheme", "whole",
]
