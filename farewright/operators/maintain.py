"""Maintenance jobs: verification, expiry, snapshots, watches, repairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewright.functions.dates import kst_date, lit_time, seconds_between
from farewright.operators.filters import FLOOR

FAILS = 3


def liveness(http_status: Column) -> Column:
    return F.when(http_status.isin(404, 410), "snapshot").when(http_status.between(200, 399), "active").otherwise("unchecked")


def to_verify(deals: DataFrame, as_of: dt.datetime, n: int = 100) -> DataFrame:
    hours = lambda h: lit_time(as_of - dt.timedelta(hours=h))
    due = deals.where((F.col("expires_at") > lit_time(as_of)) & (F.col("posted_at") < hours(24)) & (F.col("verified_at").isNull() | (F.col("verified_at") < hours(3))))
    return due.orderBy(F.asc_nulls_first("verified_at"), "id").limit(n)


def to_curate(deals: DataFrame, as_of: dt.datetime, n: int = 50) -> DataFrame:
    stale = F.col("curation_text").isNull() | (F.col("curation_generated_at") < lit_time(as_of - dt.timedelta(hours=24)))
    return deals.where(F.col("hot_deal") & (F.col("expires_at") > lit_time(as_of)) & stale).orderBy(F.desc_nulls_last("discount_rate"), "id").limit(n)


def apply_checks(deals: DataFrame, checks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """checks: (id, status), one for each deal at most (check_history takes any number). active resets the fail count; price_changed
    keeps it; snapshot adds to it and expires the deal at the third; unchecked only sets the time."""
    j = deals.join(checks.select("id", F.col("status").alias("_new")), "id", "left")
    new, now, fails = F.col("_new"), lit_time(as_of), F.col("verification_fail_count")
    count = F.when(new == "active", 0).when(new == "snapshot", fails + 1).otherwise(fails)
    return j.withColumns({
        "verification_status": F.when(new.isin("active", "price_changed", "snapshot"), new).otherwise(F.col("verification_status")),
        "verified_at": F.when(new.isNotNull(), now).otherwise(F.col("verified_at")), "verification_fail_count": count,
        "expires_at": F.when((new == "snapshot") & (fails + 1 >= FAILS), now).otherwise(F.col("expires_at"))}).drop("_new")


def check_history(deals: DataFrame, checks: DataFrame) -> DataFrame:
    """deals after all of their checks, one after the other by time (ties by check_id), each applied as in
    apply_checks at its own time. checks: (check_id, id, checked_at, status), any number for a deal; those
    without a time or a status are left out.

    A check resets the fail count, adds to it or keeps it; so what a day's checks do to it is two values
    (whether it was reset, and what was added since), and days follow each other in the same way. A window
    holds a deal's checks of a day, or its days. A snapshot that reaches the limit expires the deal at its
    time, the last of them if there are several."""
    order = ["checked_at", "check_id"]
    known = checks.where("id IS NOT NULL AND checked_at IS NOT NULL AND status IS NOT NULL").withColumn("day", F.to_date("checked_at"))
    in_day = Window.partitionBy("id", "day").orderBy(*order)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    cut = known.withColumn("part", F.sum((F.col("status") == "active").cast("int")).over(so_far(in_day)))
    cut = cut.withColumn("added", F.sum((F.col("status") == "snapshot").cast("int")).over(so_far(Window.partitionBy("id", "day", "part").orderBy(*order))))
    at = F.struct(*order)
    days = cut.groupBy("id", "day").agg(F.max_by(F.struct((F.col("part") > 0).alias("reset"), "added"), at).alias("last")).select("id", "day", "last.*")
    first = deals.select("id", F.coalesce("verification_fail_count", F.lit(0)).alias("first"))
    by_day = Window.partitionBy("id").orderBy("day")
    days = days.withColumn("run", F.sum(F.col("reset").cast("int")).over(so_far(by_day)))
    days = days.withColumn("since", F.sum("added").over(so_far(Window.partitionBy("id", "run").orderBy("day"))))
    days = days.join(first, "id").withColumn("end", F.col("since") + F.when(F.col("run") == 0, F.col("first")).otherwise(0))
    starts = days.select("id", "day", F.lag("end").over(by_day).alias("before"), "first").select("id", "day", F.coalesce("before", "first").alias("start"))
    fails = F.col("added") + F.when(F.col("part") == 0, F.col("start")).otherwise(0)
    run = cut.join(starts, ["id", "day"]).withColumn("fails", fails)
    told = F.col("status").isin("active", "price_changed", "snapshot")
    made = run.groupBy("id").agg(
        F.max_by("status", F.when(told, at)).alias("_status"), F.max("checked_at").alias("_at"), F.max_by("fails", at).cast("int").alias("_fails"),
        F.max(F.when((F.col("status") == "snapshot") & (F.col("fails") >= FAILS), F.col("checked_at"))).alias("_over"))
    new = {"verification_status": "_status", "verified_at": "_at", "verification_fail_count": "_fails", "expires_at": "_over"}
    return deals.join(made, "id", "left").withColumns({c: F.coalesce(n, c) for c, n in new.items()}).drop(*new.values())


def sweep_bodies(deals: DataFrame, as_of: dt.datetime) -> DataFrame:
    return deals.withColumn("body", F.when(~F.coalesce(F.col("body_expires_at") < lit_time(as_of), F.lit(False)), F.col("body")))


def daily_snapshot(deals: DataFrame, as_of: dt.datetime, n: int = 5) -> DataFrame:
    """(date, deal_ids): the Korean day and its hottest active deals in order."""
    top = deals.where("hot_deal AND verification_status = 'active'").where(F.col("expires_at") > lit_time(as_of)).orderBy(F.desc_nulls_last("discount_rate"), F.asc("id")).limit(n)
    got = F.sort_array(F.collect_list(F.struct((-F.coalesce("discount_rate", F.lit(-1e9))).alias("r"), "id")))
    return top.agg(F.transform(got, lambda x: x["id"]).alias("deal_ids")).select(kst_date(lit_time(as_of)).alias("date"), "deal_ids")


def match_watches(watches: DataFrame, deals: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Each active watch's cheapest deal: same route, price within its limit, class unless the watch
    takes any, month of departure if it names one. Only the cheapest deal of each route, class and
    month can be one, so a watch meets as many rows as its route has of those, not the route's deals."""
    ready = deals.where((F.col("verification_status") == "active") & (F.col("expires_at") > lit_time(as_of)) & (F.col("price_krw") >= FLOOR))
    month = F.date_format("depart_from", "yyyy-MM").alias("month")
    cheapest = ready.groupBy("origin", "destination", "carrier_class", month).agg(F.min(F.struct("price_krw", "id")).alias("best"))
    w, d = watches.where("active").alias("w"), cheapest.alias("d")
    same = (F.col("w.origin") == F.col("d.origin")) & (F.col("w.destination") == F.col("d.destination")) & (F.col("d.best.price_krw") <= F.col("w.max_price_krw"))
    same = same & ((F.col("w.carrier_class") == "mixed") | (F.col("w.carrier_class") == F.col("d.carrier_class")))
    same = same & (F.col("w.depart_month").isNull() | (F.col("d.month") == F.col("w.depart_month")))
    found = w.join(d, same).groupBy("w.id").agg(F.min("d.best").alias("best"))
    return found.select(F.col("id").alias("watch_id"), F.col("best.id").alias("deal_id"), F.col("best.price_krw").alias("price_krw"))


def cooled_down(last: Column, hours: Column, as_of: dt.datetime) -> Column:
    """Strictly more than its hours since the last notice, or none yet."""
    return last.isNull() | (seconds_between(lit_time(as_of), last) > hours * 3600)


def expired_unreferenced(deals: DataFrame, snapshots: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Deals long expired that no snapshot names."""
    named = snapshots.select(F.explode("deal_ids").alias("id")).distinct()
    return deals.where(F.col("expires_at") < lit_time(as_of - dt.timedelta(days=days))).join(named, "id", "left_anti")


def drop_source(deals: DataFrame, source: str, url_part: str, as_of: dt.datetime) -> DataFrame:
    """A source is taken off every deal; a deal with no other source expires now."""
    has = F.array_contains("sources", source)
    left = F.array_remove("sources", source)
    urls = F.filter("source_urls", lambda u: ~u.contains(url_part))
    return deals.withColumn("source_urls", F.when(has, urls).otherwise(F.col("source_urls"))).withColumn("expires_at", F.when(has & (F.size(left) == 0), lit_time(as_of)).otherwise(F.col("expires_at"))).withColumn("sources", left)


def delete_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def curation_input(hot: DataFrame, market: DataFrame, obs: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Each hot deal with its p50 (of its class's row if there is one, else of the mixed row, else the
    deal's baseline) and its key's least price of 30 days."""
    keys = ["origin", "destination", "carrier_class"]
    own = market.select(*keys, F.col("p50_krw").alias("own_p50"), F.lit(True).alias("has_own"))
    mixed = market.where("carrier_class = 'mixed'").select("origin", "destination", F.col("p50_krw").alias("mixed_p50"))
    seen = obs.where((F.col("observed_at") >= lit_time(as_of - dt.timedelta(days=days))) & (F.col("observed_at") < lit_time(as_of)))
    low = seen.groupBy(*keys).agg(F.min("price_krw").alias("min30_krw"))
    j = hot.join(own, keys, "left").join(mixed, ["origin", "destination"], "left").join(low, keys, "left")
    p50 = F.when(F.col("has_own"), F.col("own_p50")).otherwise(F.col("mixed_p50"))
    return j.select("id", *keys, F.coalesce(p50, "baseline_krw").alias("p50_krw"), "min30_krw")


def usable(drafts: DataFrame, classes: DataFrame) -> DataFrame:
    """Drafts with a route and a positive price, with defaults: roundtrip; the code's class, else the
    draft's, else mixed; the price rounded."""
    known = classes.select(F.col("code").alias("carrier_code"), F.col("carrier_class").alias("_class"))
    j = drafts.where("origin IS NOT NULL AND destination IS NOT NULL AND price_krw > 0").join(known, "carrier_code", "left")
    cls = F.when(F.col("carrier_code").isNotNull() & (F.col("carrier_code") != ""), F.coalesce("_class", F.lit("mixed"))).otherwise(F.coalesce("carrier_class", F.lit("mixed")))
    return j.withColumn("carrier_class", cls).withColumn("trip_type", F.coalesce("trip_type", F.lit("roundtrip"))).withColumn("price_krw", F.floor(F.col("price_krw") + 0.5).cast("int")).drop("_class")


def incomplete() -> Column:
    return F.col("origin").isNull() | F.col("destination").isNull() | F.col("price_krw").isNull()

