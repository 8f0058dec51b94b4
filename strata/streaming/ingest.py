"""Documents as a stream, ingested batch by batch. An extension: repeated ingestion made continuous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.index import ingest


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Chunks of a streaming DataFrame (doc_id, text) appended to the Parquet table at path.

    Each batch writes a folder of its own number and replaces it if the batch
    is run again after a failure, so no chunk is written twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ingest(rows, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total per window of events (ts, event_type, value); rows later than the watermark are passed over in a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
