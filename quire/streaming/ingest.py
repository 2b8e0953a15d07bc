"""Streams: documents that arrive are upserted batch by batch, and events are counted in windows with late data.

An extension; the batch operators are used as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def upsert_stream(rows: DataFrame, store: Store, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch replaces the stored rows of equal keys; a batch that is repeated after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(table, prepare(batch) if prepare else batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n) per window; on a stream, events later than ``late`` are dropped and a window is given when it is complete."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
