"""A Structured Streaming file source for the stateless transforms (an extension: the modelled system has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.output import name_outputs, route
from palimpsest.settings import Settings
from palimpsest.sources.files import SCHEMA, _typed, rewrite_files
from palimpsest.sources.sinks import save_files


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 100, settings: Settings | None = None) -> DataFrame:
    """Files that arrive below ``path``: uri, display_name, mime_type, size_bytes, content. Each batch takes a bounded number."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    return _typed(found, settings or Settings()).select("uri", "display_name", "mime_type", "size_bytes", "content")


def clean_arriving(spark: SparkSession, path: str, out: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Strip every file that arrives and save it below ``out``, each batch as a job of its own; results are appended to the table ``out``/_results.

    A batch that runs again after a failure saves its files again, unless it is listed already. Files of later batches don't replace those of earlier ones.
    """
    s = settings or Settings()

    def batch(files: DataFrame, number: int) -> None:
        cleaned = rewrite_files(files, keep_orientation=s.keep_image_orientation)
        named = name_outputs(route(files.drop("content"), s), s)
        done = save_files(cleaned.where("status = 'ok'").join(named, "uri"), out, f"batch-{number}").select("uri", "output_path", "status", "error")
        failed = cleaned.where("status = 'error'").select("uri", F.lit(None).cast("string").alias("output_path"), "status", "error")
        done.unionByName(failed).write.mode("overwrite").parquet(f"{out}/_results/batch={number}")

    return stream_files(spark, path, settings=s).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
