"""The domain's tables, made from the driver's: each once as a DataFrame and once as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewright.dims import SOURCES
from farewright.functions.jsmath import round_int, round_quantile
from farewright.functions.text import dedupe_key, representative_month
from farewright.operators.baseline import KEY, observed_quantiles, route_baselines

OBS_AS_OF = dt.datetime(1998, 12, 31)
DEALS_AS_OF = dt.datetime(1998, 6, 15)
EVENTS_AS_OF = dt.datetime(2024, 1, 20)
SEED_YEAR = dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col, pairs: dict[str, str]):
    out = None
    for k, v in pairs.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations: line items with the regions of supplier and customer as the route."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_regionkey")
    sup = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("string").alias("origin"))
    cus = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("string").alias("destination"))
    orders = t("orders").join(cus, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "destination")
    line = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "origin", "destination",
        _case(F.col("l_returnflag"), {"A": "fsc", "N": "lcc", "R": "mixed"}).alias("carrier_class"), _case(F.col("l_linestatus"), {"F": "roundtrip", "O": "oneway"}).alias("trip_type"),
        round_int(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_krw"), F.col("l_shipdate").alias("observed_at"), F.col("l_orderkey").alias("source_deal_id"))


OBS = """obs AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CAST(sn.n_regionkey AS VARCHAR) AS origin, CAST(cn.n_regionkey AS VARCHAR) AS destination,
    CASE l_returnflag WHEN 'A' THEN 'fsc' WHEN 'N' THEN 'lcc' WHEN 'R' THEN 'mixed' END AS carrier_class,
    CASE l_linestatus WHEN 'F' THEN 'roundtrip' WHEN 'O' THEN 'oneway' END AS trip_type,
    CAST(floor(l_extendedprice / l_quantity + 0.5) AS INTEGER) AS price_krw, l_shipdate AS observed_at, l_orderkey AS source_deal_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey)"""


def seeded() -> Column:
    """Which keys have a seed: some are left out so that every level occurs."""
    k = F.col("origin").cast("int") + F.col("destination").cast("int")
    return F.when(F.col("carrier_class") == "mixed", k % 5 != 0).otherwise(k % 3 != 0)


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed baselines: the quantiles of SEED_YEAR of the keys that have one."""
    first, last = (F.lit(t).cast("timestamp_ntz") for t in SEED_YEAR)
    year = obs(spark, sf_dir).where((F.col("observed_at") >= first) & (F.col("observed_at") < last))
    q = observed_quantiles(year, {"p10_krw": 0.1, "p50_krw": 0.5, "p90_krw": 0.9})
    return q.where(seeded()).select(*KEY, *(round_quantile(F.col(c)).alias(c) for c in ("p10_krw", "p50_krw", "p90_krw")))


def baselines(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """The resolved baselines of all routes and classes, from one scan of the observations."""
    return route_baselines(obs(spark, sf_dir), OBS_AS_OF, *SEED_YEAR, days, seeded())


SEED = """seed AS (
  SELECT origin, destination, carrier_class, CAST(floor(round(quantile_cont(price_krw, 0.1), 6) + 0.5) AS INTEGER) AS p10_krw,
    CAST(floor(round(quantile_cont(price_krw, 0.5), 6) + 0.5) AS INTEGER) AS p50_krw, CAST(floor(round(quantile_cont(price_krw, 0.9), 6) + 0.5) AS INTEGER) AS p90_krw
  FROM obs WHERE observed_at >= TIMESTAMP '1997-01-01' AND observed_at < TIMESTAMP '1998-01-01'
  GROUP BY 1, 2, 3
  HAVING CASE WHEN carrier_class = 'mixed' THEN (CAST(origin AS INTEGER) + CAST(destination AS INTEGER)) % 5 <> 0
    ELSE (CAST(origin AS INTEGER) + CAST(destination AS INTEGER)) % 3 <> 0 END)"""


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals: orders, with what orders lack derived from their key."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey")
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    names = F.array(*map(F.lit, SOURCES))
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    sources = F.when(digit == 5, F.array(F.lit(SOURCES[0]), F.lit(SOURCES[0]), F.lit(SOURCES[1]))).otherwise(F.slice(names, 1, digit))
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    d = t("orders").join(place, F.col("o_custkey") == F.col("c_custkey"))
    d = d.select(
        k.alias("id"), F.col("n_regionkey").cast("string").alias("origin"), F.col("n_name").alias("destination"), round_int(F.col("o_totalprice")).alias("price_krw"),
        _case(F.col("o_orderstatus"), {"F": "fsc", "O": "lcc", "P": "mixed"}).alias("carrier_class"),
        F.get(F.array(F.lit("active"), F.lit("price_changed"), F.lit("unchecked"), F.lit("snapshot"), F.lit("active")), digit - 1).alias("verification_status"),
        at.alias("posted_at"), (at + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), sources.alias("sources"),
        F.when(k % 11 != 0, ((k * 37) % 1301 - 300).cast("double") / 1000).alias("discount_rate"), (((k * 53) % 10001).cast("double") / 100).alias("price_percentile"),
        (((k * 53) % 10001 <= 1000) & (F.col("o_orderstatus") != "P")).alias("hot_deal"), F.when(k % 5 == 0, "hot").when(k % 5 == 1, "trending").alias("social_signal"),
        F.when(k % 13 != 0, F.date_add(at.cast("date"), (k % 120 - 30).cast("int"))).alias("depart_from"),
        F.when(k % 3 != 0, at + hours(k % 48)).alias("verified_at"), (k % 4).cast("int").alias("verification_fail_count"),
        F.when(k % 9 != 0, F.concat(F.lit("body "), k.cast("string"))).alias("body"), (at + F.expr("INTERVAL 7 DAYS")).alias("body_expires_at"),
        F.when(k % 2 == 1, "line").alias("curation_text"), (at + hours(k % 72)).alias("curation_generated_at"),
        round_int(F.col("o_totalprice") * 1.25).alias("baseline_krw"), F.get(F.array(F.lit("observed"), F.lit("mixed"), F.lit("seed"), F.lit(None)), (k % 4).cast("int")).alias("baseline_source"),
        F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None)), (k % 4).cast("int")).alias("baseline_confidence"))
    return d.withColumn("source_urls", F.transform("sources", lambda s: F.concat(F.lit("https://"), s, F.lit(".example/"), F.col("id").cast("string"))))


DEALS = """deals AS (
  SELECT *, list_transform(sources, lambda s: 'https://' || s || '.example/' || id) AS source_urls FROM (
  SELECT o_orderkey AS id, CAST(n_regionkey AS VARCHAR) AS origin, n_name AS destination, CAST(floor(o_totalprice + 0.5) AS INTEGER) AS price_krw,
    CASE o_orderstatus WHEN 'F' THEN 'fsc' WHEN 'O' THEN 'lcc' WHEN 'P' THEN 'mixed' END AS carrier_class,
    ['active', 'price_changed', 'unchecked', 'snapshot', 'active'][CAST(o_orderpriority[1:1] AS INTEGER)] AS verification_status,
    o_orderdate AS posted_at, o_orderdate + INTERVAL 30 DAY AS expires_at,
    CASE WHEN o_orderpriority[1:1] = '5' THEN ['ppomppu', 'ppomppu', 'ruliweb'] ELSE ['ppomppu', 'ruliweb', 'clien', 'playwings'][1:CAST(o_orderpriority[1:1] AS INTEGER)] END AS sources,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey * 37) % 1301 - 300 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS discount_rate,
    CAST((o_orderkey * 53) % 10001 AS DOUBLE) / CAST(100 AS DOUBLE) AS price_percentile, (o_orderkey * 53) % 10001 <= 1000 AND o_orderstatus <> 'P' AS hot_deal,
    CASE o_orderkey % 5 WHEN 0 THEN 'hot' WHEN 1 THEN 'trending' END AS social_signal,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 - 30 AS INTEGER) END AS depart_from,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_hours(o_orderkey % 48) END AS verified_at, CAST(o_orderkey % 4 AS INTEGER) AS verification_fail_count,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'body ' || o_orderkey END AS body, o_orderdate + INTERVAL 7 DAY AS body_expires_at,
    CASE WHEN o_orderkey % 2 = 1 THEN 'line' END AS curation_text, o_orderdate + to_hours(o_orderkey % 72) AS curation_generated_at,
    CAST(floor(o_totalprice * CAST(1.25 AS DOUBLE) + 0.5) AS INTEGER) AS baseline_krw, ['observed', 'mixed', 'seed', NULL][CAST(o_orderkey % 4 AS INTEGER) + 1] AS baseline_source,
    ['high', 'medium', 'low', NULL][CAST(o_orderkey % 4 AS INTEGER) + 1] AS baseline_confidence
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def keyed_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deals(spark, sf_dir)
    month = representative_month(F.col("depart_from"), F.col("posted_at"))
    return d.withColumn("dedupe_key", dedupe_key(F.col("origin"), F.substring("destination", 1, 1), F.floor(F.col("price_krw") / 20000) * 20000, month, F.col("carrier_class")))


KEYED = """keyed AS (
  SELECT *, sha1(upper(trim(origin)) || '|' || upper(trim(destination[1:1])) || '|' || CAST(CAST(floor(greatest(0, floor(price_krw / 20000) * 20000) / 1000) * 1000 AS BIGINT) AS VARCHAR) || '|'
    || strftime(coalesce(CAST(depart_from AS TIMESTAMP), posted_at), '%Y-%m') || '|' || carrier_class) AS dedupe_key FROM deals)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    n = F.get_json_object("props", "$.k").cast("int")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (k % 10).cast("int"))
    return e.select(
        k.alias("id"), F.col("event_type").alias("source"), F.col("ts").alias("started_at"), F.when(k % 13 != 0, F.col("ts") + minutes).alias("finished_at"),
        (k % 7 != 0).alias("success"), n.alias("processed_count"), F.floor(n / 2).cast("int").alias("saved_count"),
        F.when(k % 7 == 0, F.concat(F.lit("error "), k.cast("string"))).alias("errors"))


RUNS = """runs AS (
  SELECT event_id AS id, event_type AS source, ts AS started_at, CASE WHEN event_id % 13 <> 0 THEN ts + to_minutes(event_id % 10) END AS finished_at, event_id % 7 <> 0 AS success,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS processed_count, CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 2) AS INTEGER) AS saved_count,
    CASE WHEN event_id % 7 = 0 THEN 'error ' || event_id END AS errors FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("run"), F.col("event_id").alias("source_id"), (F.floor("value").cast("int") - 3).alias("views"))


ITEMS = "items AS (SELECT CAST(ts AS DATE) AS run, event_id AS source_id, CAST(floor(value) AS INTEGER) - 3 AS views FROM events)"
