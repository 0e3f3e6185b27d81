"""Monitoring: runs, health, contamination, counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewright.functions.dates import kst_date, lit_time, seconds_between
from farewright.functions.jsmath import round_half_up
from farewright.functions.text import health_state
from farewright.operators.baseline import KEY
from farewright.operators.ordered import before

ROW_ALARM = 250_000
TOKENS_PER_CALL, DAILY_CALLS = 150, 300


def status_histogram(checks: DataFrame, as_of: dt.datetime) -> DataFrame:
    return checks.where((F.col("checked_at") >= lit_time(as_of - dt.timedelta(hours=24))) & (F.col("checked_at") <= lit_time(as_of))).groupBy("status").agg(F.count("*").alias("n"))


def run_rollup(runs: DataFrame, n: int = 200) -> DataFrame:
    """Of the newest n runs: counts, sums, and the errors of each source's latest failure."""
    newest = runs.orderBy(F.desc("started_at"), "id").limit(n)
    failed = F.when(~F.col("success"), F.struct("started_at", "id"))
    return newest.groupBy("source").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("processed_count"), F.lit(0)).alias("processed"), F.coalesce(F.sum("saved_count"), F.lit(0)).alias("saved"),
        F.max_by("errors", failed).alias("last_errors"))


def latest_success(runs: DataFrame) -> DataFrame:
    """Each source's finished time (else started) of the success that started last."""
    at = F.coalesce("finished_at", "started_at")
    return runs.where("success").groupBy("source").agg(F.max_by(at, F.struct("started_at", "id")).alias("last_success"))


def health(runs: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Every source with minutes since its last success, its state, and whether it is over 2 h."""
    j = sources.join(latest_success(runs.where(F.col("started_at") <= lit_time(as_of))), "source", "left")
    minutes = F.floor(seconds_between(lit_time(as_of), F.col("last_success")) / 60)
    return j.withColumn("minutes", minutes).withColumn("state", health_state(F.col("minutes"))).withColumn("stale", F.coalesce(F.col("minutes") > 120, F.lit(True)))


def contamination(obs: DataFrame, market: DataFrame, as_of: dt.datetime, days: int = 7, share: float = 0.5) -> DataFrame:
    """Keys whose least recent price is below half of p10, and by how much; p10 of 0 or less is out."""
    seen = obs.where((F.col("observed_at") >= lit_time(as_of - dt.timedelta(days=days))) & (F.col("observed_at") < lit_time(as_of)))
    low = seen.groupBy(*KEY).agg(F.min("price_krw").alias("recent_min_krw"), F.count("*").alias("recent_n"))
    j = low.join(market.where("p10_krw > 0"), KEY).where(F.col("recent_min_krw") < F.col("p10_krw") * share)
    return j.select(*KEY, "recent_min_krw", "recent_n", "p10_krw", round_half_up(100.0 * (1 - F.col("recent_min_krw") / F.col("p10_krw")), 1).alias("drop_pct"))


def row_alarm(*tables: DataFrame, threshold: int = ROW_ALARM) -> DataFrame:
    """Sum of the tables' counts and whether it reaches the threshold; counts come from footers."""
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    all_of = counts[0]
    for c in counts[1:]:
        all_of = all_of.unionAll(c)
    return all_of.agg(F.sum("n").alias("rows_total")).withColumn("over", F.col("rows_total") >= threshold)


def add_usage(usage: DataFrame, calls: DataFrame) -> DataFrame:
    """Daily tokens (Korean day): stored ones plus those of calls; negative counts are 0."""
    new = calls.select(kst_date(F.col("at")).alias("date"), F.greatest(F.lit(0), "tokens_in").alias("tokens_in"), F.greatest(F.lit(0), "tokens_out").alias("tokens_out"))
    return usage.select("date", "tokens_in", "tokens_out").unionByName(new).groupBy("date").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def budget(usage: DataFrame, session_calls: int = 0, limit: int = DAILY_CALLS) -> DataFrame:
    used = F.ceil(F.greatest(F.lit(0), F.col("tokens_in")) / TOKENS_PER_CALL) + session_calls
    return usage.withColumn("calls_used", used).withColumn("can_spend", used < limit).withColumn("remaining", F.greatest(F.lit(0), limit - used))


def gated(calls: DataFrame, limit: int = DAILY_CALLS, order: str = "call_id") -> DataFrame:
    """calls: (call_id, at, tokens_in, ...) with date (Korean day), spent (tokens of the day's calls before)
    and allowed: whether the budget of the day still has a call at its place, by time, ties by order.

    A refused call spends nothing; but from the first one on all are refused, so sums over all calls before
    decide as sums over the allowed ones do. Sums go by minutes and then within a minute."""
    day = calls.withColumns({"date": kst_date(F.col("at")), "_minute": F.date_trunc("minute", "at"), "_cost": F.greatest(F.lit(0), F.coalesce("tokens_in", F.lit(0)))})
    summed = before(day, ["date"], "_minute", {"_before": F.sum("_cost")})
    own = Window.partitionBy("date", "_minute").orderBy("at", order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_before") + F.coalesce(F.sum("_cost").over(own), F.lit(0))
    return summed.withColumn("spent", spent).withColumn("allowed", F.ceil(F.col("spent") / TOKENS_PER_CALL) < limit).drop("_minute", "_cost", "_before")


def sources_by_status(deals: DataFrame, as_of: dt.datetime) -> DataFrame:
    seen = deals.where((F.col("verified_at") >= lit_time(as_of - dt.timedelta(hours=24))) & (F.col("verified_at") <= lit_time(as_of)))
    return seen.select(F.explode("sources").alias("src"), "verification_status").groupBy("src", "verification_status").agg(F.count("*").alias("n"))


def old_by_month(obs: DataFrame, as_of: dt.datetime, days: int = 180) -> DataFrame:
    old = obs.where(F.col("observed_at") < lit_time(as_of - dt.timedelta(days=days)))
    return old.groupBy(F.to_date(F.date_trunc("month", "observed_at")).alias("month")).agg(F.count("*").alias("n"))


def route_counts(routes: DataFrame, deals: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Deals of the window for each listed route, also where there are none."""
    seen = deals.where((F.col("posted_at") >= lit_time(as_of - dt.timedelta(days=days))) & (F.col("posted_at") <= lit_time(as_of))).groupBy("origin", "destination").agg(F.count("*").alias("n"))
    return routes.join(seen, ["origin", "destination"], "left").select("origin", "destination", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hot_summary(deals: DataFrame, as_of: dt.datetime) -> DataFrame:
    live = deals.where((F.col("expires_at") > lit_time(as_of)) & (F.col("verification_status") != "snapshot"))
    mean = F.avg(F.when(F.col("hot_deal"), F.col("discount_rate"))) * 100
    return live.agg(F.count_if("hot_deal").alias("hot_n"), F.count("*").alias("total_active"), round_half_up(mean, 1).alias("avg_hot_pct"))


def overdue_bodies(deals: DataFrame, as_of: dt.datetime) -> DataFrame:
    return deals.where(F.col("body").isNotNull() & (F.col("body_expires_at") < lit_time(as_of))).agg(F.count("*").alias("n"))


def usage_this_month(usage: DataFrame, as_of: dt.datetime) -> DataFrame:
    first = F.to_date(F.date_trunc("month", kst_date(lit_time(as_of)).cast("timestamp_ntz")))
    return usage.where((F.col("date") >= first) & (F.col("date") <= kst_date(lit_time(as_of))))


def usage_days(usage: DataFrame, n: int = 7) -> DataFrame:
    """The newest days of usage."""
    return usage.orderBy(F.desc("date")).limit(n)


def snapshot_sizes(snapshots: DataFrame, n: int = 14) -> DataFrame:
    return snapshots.select("date", F.size("deal_ids").cast("long").alias("n")).orderBy(F.desc("date")).limit(n)


def discount_ceiling(shown: DataFrame) -> DataFrame:
    return shown.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("discount_rate"), F.lit(0.0))).alias("max_rate"))


def parser_coverage(parsed: DataFrame, expected: DataFrame, fields: list[str], key: str = "title") -> DataFrame:
    """Share of the expected records that agree in all fields, nulls equal to nulls."""
    j = expected.alias("e").join(parsed.alias("p"), key)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"e.{f}").eqNullSafe(F.col(f"p.{f}"))
    return j.agg(F.count("*").alias("cases"), F.count_if(same).alias("exact"), F.avg(same.cast("int")).alias("coverage"))

