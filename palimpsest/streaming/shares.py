"""Shares that arrive over time, each handled once (an extension: the modelled system keeps the last share in memory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def first_of_each(shares: DataFrame, at: str | None = None, within: str | None = None) -> DataFrame:
    """Of a stream of shares (signature, ...) the first with each signature.

    Signatures are state keyed by themselves, in the JVM. With a column ``at`` of event times, a signature is forgotten ``within`` a
    time (as "10 minutes") after it was seen, which bounds the state; without it, state grows with the number of different signatures.
    """
    if at is None:
        return shares.dropDuplicates(["signature"])
    return shares.withWatermark(at, within).dropDuplicatesWithinWatermark(["signature"])


def handle_shares(shares: DataFrame, out: str, checkpoint: str, at: str | None = None, within: str | None = None) -> StreamingQuery:
    """Append the first share of each signature to the table ``out``: what is there now, in bounded batches.

    State and the list of finished batches are below ``checkpoint``, so that a stream that is stopped, or whose batch fails half-way, goes on
    where it was: a share is in the table once, over any number of batches and restarts.
    """
    return first_of_each(shares, at, within).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
