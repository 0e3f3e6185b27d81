"""Signals, keys and the merge of new deals into stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewright.functions.text import mapped
from farewright.operators.ordered import id_band, ranked
from farewright.operators.serve import signal_rank

MANY_SOURCES = 3


def social_signals(items: DataFrame, keys: list[str], views: str = "views", item_id: str = "source_id") -> DataFrame:
    """items and social_signal: of the n rows of a run with positive views, sorted down (ties by
    id), the first ceil(0.2 n) are hot, those up to ceil(0.4 n) trending."""
    valid = F.coalesce(F.col(views) > 0, F.lit(False))
    by_views, by_id = -F.col(views), id_band(items, item_id)
    seen = ranked(items.where(valid), keys, [by_views, by_id], [item_id], "_place", "_size")
    signal = F.when(F.col("_place") <= F.ceil(F.col("_size") * 0.2), "hot").when(F.col("_place") <= F.ceil(F.col("_size") * 0.4), "trending")
    rest = items.where(~valid).withColumn("social_signal", F.lit(None).cast("string"))
    return seen.withColumn("social_signal", signal).drop("_place", "_size").unionByName(rest)


def max_signal(a: Column, b: Column) -> Column:
    return mapped({"2": "hot", "1": "trending"}, F.greatest(signal_rank(a), signal_rank(b)).cast("string"))


def _rank_to_signal(rank: Column) -> Column:
    return F.when(rank == 2, "hot").when(rank == 1, "trending")


def fold_batch(rows: DataFrame, order: list[str], latest: list[str], key: str = "dedupe_key") -> DataFrame:
    """One row for each key of a batch, as if its rows were merged one by one in order: sources in
    order of appearance, least price, earliest time, greatest signal, all else from the last row.

    Sources and URLs are first reduced to one row for each key and value (its first appearance), so
    what meets in an array is the distinct values, not the rows of a busy key."""
    at = F.struct(*order)
    made = rows.groupBy(key).agg(
        F.min("price_krw").alias("price_krw"), F.min("posted_at").alias("posted_at"), F.max(signal_rank(F.col("social_signal"))).alias("_signal"),
        F.max_by(F.struct(*latest), at).alias("_last"))
    named = lambda c: F.transform(c, lambda v, i: F.struct(F.lit(c).alias("kind"), i.alias("i"), v.alias("v")))
    values = rows.select(key, *order, F.explode(F.concat(named("sources"), named("source_urls"))).alias("x")).select(key, *order, "x.kind", "x.i", "x.v")
    first = values.groupBy(key, "kind", "v").agg(F.min(F.struct(*order, "i")).alias("first"))
    kept = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == c, F.struct("first", "v")))), lambda x: x["v"])
    unions = first.groupBy(key).agg(kept("sources").alias("sources"), kept("source_urls").alias("source_urls"))
    none = F.array().cast("array<string>")
    return made.join(unions, key, "left").select(
        key, F.coalesce("sources", none).alias("sources"), F.coalesce("source_urls", none).alias("source_urls"), "price_krw", "posted_at",
        _rank_to_signal(F.col("_signal")).alias("social_signal"), "_last.*")


def upsert(stored: DataFrame, batch: DataFrame, latest: list[str], kept: list[str], key: str = "dedupe_key") -> DataFrame:
    """The store after a batch of one row for each key. Of a key in both: ordered union of sources,
    least price, earliest time, greatest signal, hot from three sources on, kept columns from the
    store and latest columns from the batch. One full outer join on the key."""
    s, b = stored.alias("s"), batch.alias("b")
    j = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full")
    c = lambda side, name: F.col(f"{side}.{name}")
    new, old = c("b", key).isNotNull(), c("s", key).isNotNull()
    empty = F.array().cast("array<string>")
    union = lambda n: F.array_distinct(F.concat(F.coalesce(c("s", n), empty), F.coalesce(c("b", n), empty)))
    signal = _rank_to_signal(F.greatest(signal_rank(c("s", "social_signal")), signal_rank(c("b", "social_signal"))))
    signal = F.when(new & (F.size(union("sources")) >= MANY_SOURCES), "hot").when(new, signal).otherwise(c("s", "social_signal"))
    return j.select(
        F.coalesce(c("s", key), c("b", key)).alias(key), union("sources").alias("sources"), union("source_urls").alias("source_urls"),
        F.least(c("s", "price_krw"), c("b", "price_krw")).alias("price_krw"), F.least(c("s", "posted_at"), c("b", "posted_at")).alias("posted_at"), signal.alias("social_signal"),
        *(F.when(new, c("b", n)).otherwise(c("s", n)).alias(n) for n in latest), *(F.when(old, c("s", n)).otherwise(c("b", n)).alias(n) for n in kept))


def capped(items: DataFrame, n: int = 40, key: str = "source", order: str = "pos") -> DataFrame:
    """The first n list rows of each source's run, as a crawl takes them."""
    w = Window.partitionBy(key).orderBy(order)
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
