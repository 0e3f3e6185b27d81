"""Micro-batches: keyed merges that can be replayed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farewright.functions.dates import lit_time
from farewright.operators.merge import fold_batch, upsert
from farewright.shared import written
from farewright.sources.keyed import KeyedTable

LATEST = ["discount_rate", "expires_at", "hot_deal"]
KEPT = ["verification_status", "verified_at", "verification_fail_count"]


#: A stored deal.
DEAL = (
    "dedupe_key string, sources array<string>, source_urls array<string>, price_krw int, posted_at timestamp_ntz, social_signal string, "
    "discount_rate double, expires_at timestamp_ntz, hot_deal boolean, verification_status string, verified_at timestamp_ntz, verification_fail_count int")


class DealStore(KeyedTable):
    """Stored deals by their dedupe_key. A batch rewrites the buckets that its keys fall into.

    The store belongs to the stream that fills it, by the id that Spark keeps in the stream's checkpoint:
    a batch that is delivered again changes nothing, and a stream with another checkpoint fails, so
    nothing stored is lost. take_over: this stream may go on where another one ended."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, take_over: bool = False) -> None:
        super().__init__(spark, path, "dedupe_key", DEAL, buckets)
        self.take_over = take_over

    def merge(self, rows: DataFrame, batch: int, stream: str | None = None) -> int:
        """The store with a batch of rows; its version. stream: a name of the stream, if Spark knows none."""
        stream = stream or rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "rows"
        new = written(fold_batch(rows, ["posted_at", "id"], LATEST + KEPT).select(*self.schema.names), "batch")
        return self.change(new, lambda old, batch: upsert(old, batch, LATEST, KEPT), writer=stream, batch=batch, take_over=self.take_over)

    def latest(self) -> DataFrame:
        """The newest version; no rows before the first batch."""
        return self.read()


def ingest(posts: DataFrame, store: DealStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merges a stream of keyed deals. every: a processing time such as 15 minutes; None takes what is
    there and ends."""
    writer = posts.writeStream.foreachBatch(lambda rows, batch: store.merge(rows, batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def observe(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends observations; the file sink commits each batch once."""
    return posts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(rows: DataFrame, as_of: dt.datetime, column: str) -> DataFrame:
    return rows.where(F.col(column) < lit_time(as_of))
