"""Small states by key on event time, each with an end: a window of hits, the time of the last notice.

A state is one or two numbers. A timer is set for the time from which on the state no longer matters, and
clears it when the watermark has passed that time, so the store holds the keys of the last windows, not all
that were ever seen. Spark drops rows that are older than the watermark. Rows of one micro-batch are taken
in the order of their time; a micro-batch bounds what a key can bring (maxFilesPerTrigger).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH, _MS = dt.datetime(1970, 1, 1), dt.timedelta(milliseconds=1)


def _ms(at: dt.datetime) -> int:
    """Milliseconds of a session time in UTC."""
    return (at.astimezone(dt.timezone.utc).replace(tzinfo=None) - _EPOCH) // _MS


class _Timed(StatefulProcessor):
    """Keeps one value a key, and one timer: for the time after which the value says nothing."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("value", self.schema)

    def kept(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def keep(self, before: tuple | None, now: tuple, ends: int, ended: int | None) -> None:
        if now != before:
            self.state.update(now)
            if ended is not None:
                self.handle.deleteTimer(ended)
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Window(_Timed):
    schema = "count int, reset bigint"

    def __init__(self, names: list[str], tie: str | None, limit: int, ms: int) -> None:
        self.names, self.tie, self.limit, self.ms = names, tie, limit, ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.kept()
        count, reset = before or (0, 0)
        for row in sorted(rows, key=lambda r: (r["at"], r[self.tie] if self.tie else 0)):
            now = _ms(row["at"])
            if count == 0 or reset < now:
                count, reset = 0, now + self.ms
            count += 1
            yield Row(**{n: row[n] for n in self.names}, allowed=count <= self.limit, remaining=max(0, self.limit - count))
        self.keep(before, (count, reset), reset + 1, before[1] + 1 if before else None)


class _Cooldown(_Timed):
    schema = "last bigint"

    def __init__(self, ms: int) -> None:
        self.ms = ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.kept()
        last = before[0] if before else None
        for row in sorted(rows, key=lambda r: (r["at"], r["deal_id"])):
            now = _ms(row["at"])
            if last is None or now - last > self.ms:
                last = now
                yield Row(watch_id=row["watch_id"], deal_id=row["deal_id"], at=row["at"])
        self.keep(before, (last,), last + self.ms + 1, before[0] + self.ms + 1 if before else None)


def limited(hits: DataFrame, limit: int = 60, seconds: int = 60, tie: str | None = None, delay: str | None = None) -> DataFrame:
    """hits: (key, at, ...), a stream. hits with allowed and remaining: a window of some seconds for each
    key begins at its first hit, and the first hit after its reset time begins the next; hits beyond the
    limit are refused. tie: orders hits of one time. A null key is a key."""
    timed = hits.withWatermark("at", delay or f"{2 * seconds} seconds")
    schema = StructType(list(hits.schema.fields)).add("allowed", BooleanType()).add("remaining", IntegerType())
    return timed.groupBy("key").transformWithState(_Window(hits.columns, tie, limit, seconds * 1000), schema, "append", "eventTime")


def cooled(matches: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """matches: (watch_id, deal_id, at), a stream. The matches that are sent: the first of a watch, and then
    those more than some hours after the last one sent; of one time the smallest deal_id."""
    timed = matches.select("watch_id", "deal_id", "at").withWatermark("at", delay)
    schema = StructType(list(timed.schema.fields))
    return timed.groupBy("watch_id").transformWithState(_Cooldown(hours * 3_600_000), schema, "append", "eventTime")


def to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what there is of a stream with state into Parquet files, each batch once. States of this kind
    need Spark's RocksDB store."""
    spark: SparkSession = rows.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_time(column: str):
    """A stored UTC time as an event time of a stream."""
    return F.col(column).cast("timestamp")
