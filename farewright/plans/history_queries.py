"""Registered queries over time: baselines at many days, checks in order, budgets in order, tables that change."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from farewright.functions.jsmath import round_quantile
from farewright.operators import baseline, maintain, ops, quantiles
from farewright.plans import views as V
from farewright.plans.queries import query
from farewright.plans.views import DEALS, OBS
from farewright.shared import fresh_dir
from farewright.sources.keyed import KeyedTable
from farewright.streaming import limits

DAYS = [dt.date(1998, 11, 1) + dt.timedelta(days=i) for i in range(30)]
_P = ", ".join(f"CAST(floor(round(quantile_cont(price_krw, {q}), 6) + 0.5) AS INTEGER) AS {n}_krw" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))


@query(f"""WITH {OBS}, ends AS (SELECT CAST(unnest(generate_series(DATE '{DAYS[0]}', DATE '{DAYS[-1]}', INTERVAL 1 DAY)) AS DATE) AS as_of)
SELECT as_of, origin, destination, carrier_class, count(*) AS n, {_P} FROM obs JOIN ends ON observed_at >= as_of - INTERVAL 30 DAY AND observed_at < as_of GROUP BY 1, 2, 3, 4""")
def t02_c01_rolling_quantiles(spark, sf_dir):
    """The quantiles of 30 days before each of 30 days, from daily histograms of one scan."""
    days = quantiles.daily(V.obs(spark, sf_dir), baseline.KEY, "observed_at", "price_krw")
    qs = {"p10_krw": 0.1, "p50_krw": 0.5, "p90_krw": 0.9}
    got = baseline.rolling_quantiles(days, qs, DAYS, 30)
    return got.select("as_of", *baseline.KEY, "n", *(round_quantile(F.col(q)).alias(q) for q in qs))


#: Checks in order: events, of the deals that have a user's number.
HISTORY = """checks AS (SELECT event_id AS check_id, user_id AS id, ts AS checked_at,
  CASE event_type WHEN 'signup' THEN 'active' WHEN 'click' THEN 'snapshot' WHEN 'view' THEN 'snapshot' WHEN 'purchase' THEN 'price_changed' ELSE 'unchecked' END AS status FROM events)"""


@query(f"""WITH {DEALS}, {HISTORY}, cut AS (SELECT *, sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY checked_at, check_id) AS part FROM checks),
run AS (SELECT c.*, sum(CASE WHEN status = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY c.id, part ORDER BY checked_at, check_id) + CASE WHEN part = 0 THEN verification_fail_count ELSE 0 END AS fails FROM cut c JOIN deals d ON c.id = d.id),
made AS (SELECT id, arg_max(status, (checked_at, check_id)) FILTER (status <> 'unchecked') AS s, max(checked_at) AS t, arg_max(fails, (checked_at, check_id)) AS f, max(checked_at) FILTER (status = 'snapshot' AND fails >= 3) AS over_at FROM run GROUP BY id)
SELECT d.id, coalesce(s, verification_status) AS verification_status, coalesce(t, verified_at) AS verified_at, CAST(coalesce(f, verification_fail_count) AS INTEGER) AS verification_fail_count, coalesce(over_at, expires_at) AS expires_at
FROM deals d LEFT JOIN made USING (id)""")
def c07_t05_check_history(spark, sf_dir):
    """All checks of all deals, in order."""
    status = F.when(F.col("event_type") == "signup", "active").when(F.col("event_type").isin("click", "view"), "snapshot").when(F.col("event_type") == "purchase", "price_changed").otherwise("unchecked")
    checks = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("check_id"), F.col("user_id").alias("id"), F.col("ts").alias("checked_at"), status.alias("status"))
    deals = V.deals(spark, sf_dir).select("id", "verification_status", "verified_at", "verification_fail_count", "expires_at")
    return maintain.check_history(deals, checks)


@query("""WITH calls AS (SELECT event_id AS call_id, ts, CAST(ts + INTERVAL 9 HOUR AS DATE) AS date, greatest(0, CAST(floor(value) AS BIGINT) - 20) AS cost FROM events),
spent AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY date ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM calls)
SELECT call_id, date, CAST(spent AS BIGINT) AS spent, ceil(spent / 150.0) < 12 AS allowed FROM spent""")
def a13_c12_gate(spark, sf_dir):
    """Each call of a day, allowed or refused at its place, with 12 calls a day."""
    calls = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("ts").alias("at"), (F.floor("value") - 20).alias("tokens_in"))
    return ops.gated(calls, limit=12).select("call_id", "date", "spent", "allowed")


@query(f"""WITH {DEALS} SELECT id, CASE WHEN id % 4 = 0 THEN price_krw - 1000 ELSE price_krw END AS price_krw, CASE WHEN id % 5 = 0 THEN 'snapshot' WHEN id % 4 = 0 THEN 'unchecked' ELSE verification_status END AS verification_status
FROM deals WHERE id % 7 <> 0""")
def s19_s20_keyed_table(spark, sf_dir):
    """All deals in a table by key that is filled, upserted, updated and thinned out in place."""
    deals = V.deals(spark, sf_dir).select("id", "price_krw", "verification_status")
    table = KeyedTable(spark, fresh_dir(spark, "deals"), "id", deals.schema, buckets=16)
    table.upsert(deals.where("id % 2 = 0 OR id % 3 = 0"))
    table.upsert(deals.where("id % 2 <> 0 AND id % 3 <> 0 OR id % 4 = 0").withColumns({
        "price_krw": F.when(F.col("id") % 4 == 0, F.col("price_krw") - 1000).otherwise(F.col("price_krw")), "verification_status": F.when(F.col("id") % 4 == 0, "unchecked").otherwise(F.col("verification_status"))}))
    table.update(deals.where("id % 5 = 0").select("id", F.lit("snapshot").alias("verification_status")))
    table.delete(deals.where("id % 7 = 0").select("id"), base=2)
    return table.read()


def _in_arrivals(spark, sf_dir, rows, state):
    """rows with a time at, as files in three arrivals, each taken up by the stream with what it kept before."""
    base = fresh_dir(spark, "stream")
    first, second = dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 21)
    at = F.col("at")
    for arrived in (at < F.lit(first), (at >= F.lit(first)) & (at < F.lit(second)), at >= F.lit(second)):
        rows.where(arrived).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        limits.to_files(state(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _next(key: str, ms: int) -> str:
    """SQL: the hits that begin a window, from each one's next: the first hit of the key that is later by more."""
    return f"""nexts AS (SELECT a.k, a.ms, min(b.ms) AS next FROM (SELECT DISTINCT k, ms FROM hits) a LEFT JOIN (SELECT DISTINCT k, ms FROM hits) b ON a.k = b.k AND b.ms > a.ms + {ms} GROUP BY 1, 2),
begins(k, ms) AS (SELECT k, min(ms) FROM hits GROUP BY k UNION ALL SELECT n.k, n.next FROM begins JOIN nexts n USING (k, ms) WHERE n.next IS NOT NULL)"""


@query(f"""WITH RECURSIVE hits AS (SELECT user_id AS k, event_id, ts, epoch_us(ts) // 1000 AS ms FROM events), {_next('user_id', 43_200_000)},
placed AS (SELECT h.*, row_number() OVER (PARTITION BY h.k, b.ms ORDER BY ts, event_id) AS place FROM hits h JOIN begins b ON h.k = b.k AND h.ms >= b.ms AND h.ms <= b.ms + 43200000)
SELECT k AS key, event_id, place <= 2 AS allowed, CAST(greatest(0, 2 - place) AS INTEGER) AS remaining FROM placed""")
def t03_rate_limit(spark, sf_dir):
    """Events as hits of their users: two in twelve hours from the first on."""
    hits = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", limits.event_time("ts").alias("at"))
    got = _in_arrivals(spark, sf_dir, hits, lambda s: limits.limited(s, limit=2, seconds=43_200, tie="event_id", delay="1 hour"))
    return got.select("key", "event_id", "allowed", "remaining")


@query(f"""WITH RECURSIVE hits AS (SELECT user_id AS k, event_id, ts, epoch_us(ts) // 1000 AS ms FROM events), {_next('user_id', 86_400_000)}
SELECT k AS watch_id, arg_min(event_id, (ts, event_id)) AS deal_id, b.ms AS sent_ms FROM begins b JOIN hits h USING (k, ms) GROUP BY k, b.ms""")
def t04_cooldown(spark, sf_dir):
    """Events as matches of their users: one notice, then none for a day."""
    matches = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("watch_id"), F.col("event_id").alias("deal_id"), limits.event_time("ts").alias("at"))
    got = _in_arrivals(spark, sf_dir, matches, lambda s: limits.cooled(s, hours=24))
    return got.select("watch_id", "deal_id", F.unix_millis("at").alias("sent_ms"))
