"""palimpsest: a Spark-first engine for cataloguing, stripping, faking and auditing file metadata."""

__version__ = "0.1.0"
