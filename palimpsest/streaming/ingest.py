"""Streaming extension: a stream of puts into a store, and live counts by namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.store import Store


def stream_puts(puts: DataFrame, store: Store, checkpoint: str, name: str = "puts", available_now: bool = False) -> StreamingQuery:
    """Puts every row of the stream (schema.PUTS). A batch that is run again after a failure is put once."""

    def put(batch: DataFrame, epoch: int) -> None:
        store.put_many(batch, mark=f"{name}:{epoch}")

    writer = puts.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "created_at", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of a stream by namespace and time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), "ns").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "ns", "n")
