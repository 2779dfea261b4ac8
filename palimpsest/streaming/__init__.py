"""The same transforms over files that arrive later."""

from palimpsest.streaming.files import clean_arriving, stream_files

__all__ = ["clean_arriving", "stream_files"]
