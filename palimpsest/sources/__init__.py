"""Files as rows: catalogue scan, byte codecs, plan store."""

from palimpsest.sources.files import catalog, read_attributes, read_bytes

__all__ = ["catalog", "read_attributes", "read_bytes"]
