"""Tables in and out: public view, seeds, appends, keyed upserts, JSON, row counts."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewright.functions.dates import lit_time

SEED_SCHEMA = "origin string, destination string, carrierClass string, baselineKrw int, p10Krw int, p50Krw int, p90Krw int, confidence string, sampledAt date, source string"


def public_deals(deals: DataFrame) -> DataFrame:
    """Everything but the body."""
    return deals.drop("body")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of seed baselines as rows of the market table."""
    s = spark.read.schema(SEED_SCHEMA).option("multiLine", True).json(path)
    null = F.lit(None).cast("int")
    return s.select(
        "origin", "destination", F.col("carrierClass").alias("carrier_class"), null.alias("p5_krw"), F.col("p10Krw").alias("p10_krw"), null.alias("p25_krw"),
        F.col("p50Krw").alias("p50_krw"), F.col("p90Krw").alias("p90_krw"), F.lit("seed").alias("source"), F.lit(720).alias("ttl_hours"), F.col("sampledAt").cast("timestamp_ntz").alias("sampled_at"))


def load_seed(seed: DataFrame, path: str) -> None:
    """Replaces the seed partition of a market table that is partitioned by source."""
    seed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new in place of those with the same keys; new has one row for a key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def row_count(rows: DataFrame) -> int:
    return rows.count()


def sink_rate(rate):
    """A rate as the store holds it; null where it does not fit."""
    return rate.try_cast("decimal(4,3)")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


class JsonCache:
    """Results as JSON rows in a folder, each good for some seconds from its time on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _kept(self, name: str) -> list[int]:
        """The times of a result's copies, from one listing."""
        try:
            files = self.spark.read.text(f"{self.path}/{name}/*").inputFiles()
        except AnalysisException:
            return []
        return sorted({int(m[1]) for f in files if (m := re.search(r"/at-(\d+)/[^/]*$", f))})

    def get(self, name: str, now: dt.datetime, seconds: int, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows (json) of the newest copy that is not older than its lifetime at now; else those that make
        gives, kept as the copy of now."""
        at = int((now - dt.datetime(1970, 1, 1)).total_seconds())
        good = [t for t in self._kept(name) if at - seconds < t <= at]
        if not good:
            as_json(make()).write.mode("ignore").text(f"{self.path}/{name}/at-{at:012d}")
            good = [at]
        return self.spark.read.text(f"{self.path}/{name}/at-{good[-1]:012d}").withColumnRenamed("value", "json")


def finished_run(source: str, started: dt.datetime, finished: dt.datetime, posts: DataFrame, saved: DataFrame) -> DataFrame:
    """The audit row of a run."""
    n = posts.agg(F.count("*").cast("int").alias("processed_count")).join(saved.agg(F.count("*").cast("int").alias("saved_count")), F.lit(True))
    return n.select(F.lit(source).alias("source"), lit_time(started).alias("started_at"), lit_time(finished).alias("finished_at"), "processed_count", "saved_count", F.lit(True).alias("success"))


def notify(found: DataFrame, send: Callable[[dict], None]) -> int:
    """Calls send for each notice, on the driver, which holds one partition at a time."""
    n = 0
    for row in found.toLocalIterator():
        send(row.asDict())
        n += 1
    return n
