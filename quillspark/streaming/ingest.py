"""Incremental ingest: a stream of documents appended to passage and posting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import passages, tokens


def stream_passages(docs: DataFrame) -> DataFrame:
    """Passages of a stream of (doc_id, text); stateless, so any output mode works."""
    return docs.select("doc_id", F.posexplode(passages(F.col("text"))).alias("sent_idx", "sent"))


def append_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's postings below ``path``, a folder a batch: a batch
    that is replayed overwrites its own folder, so nothing counts twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        words = stream_passages(batch).select("doc_id", "sent_idx", F.explode(tokens(F.col("sent"))).alias("term"))
        words.groupBy("doc_id", "sent_idx", "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values by event-time window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
