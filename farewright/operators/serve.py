"""Read paths: top lists, sections, timeline, frequency, traces, joins of display."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewright.functions.dates import lit_time
from farewright.functions.jsmath import round_half_up
from farewright.operators.filters import FLOOR, Filters, common, in_region, is_live, not_past
from farewright.operators.ordered import ranked


def _ago(as_of: dt.datetime, **kw) -> Column:
    return lit_time(as_of - dt.timedelta(**kw))


def hero(deals: DataFrame, f: Filters, as_of: dt.datetime, n: int = 3) -> DataFrame:
    """The hottest active deals; if there are none, the best discounts of the last seven days
    (without tests of expiry and since). One plan: both are ranked, the first kind present wins."""
    ready = deals.where(not_past(F.col("depart_from"), as_of) & (F.col("price_krw") >= FLOOR))
    best = [F.desc_nulls_last("discount_rate"), F.asc("id")]
    first = common(ready.where("hot_deal AND verification_status = 'active'").where(F.col("expires_at") > lit_time(as_of)), f, as_of).orderBy(*best).limit(n)
    second = common(ready.where((F.col("posted_at") >= _ago(as_of, days=7)) & (F.col("verification_status") != "snapshot")), f, as_of, apply_since=False).orderBy(*best).limit(n)
    both = first.withColumn("_kind", F.lit(0)).unionByName(second.withColumn("_kind", F.lit(1)))
    return both.withColumn("_least", F.min("_kind").over(Window.partitionBy(F.lit(1)))).where("_kind = _least").drop("_kind", "_least")


def signal_rank(signal) -> Column:
    return F.when(signal == "hot", 2).when(signal == "trending", 1).otherwise(0)


def picks(deals: DataFrame, f: Filters, as_of: dt.datetime, pool: int = 16, n: int = 8) -> DataFrame:
    """Of the newest with a signal, hot before trending before newer. Only region and price filter."""
    ready = deals.where(F.col("social_signal").isNotNull() & (F.col("verification_status") == "active") & (F.col("expires_at") > lit_time(as_of)))
    ready = ready.where(not_past(F.col("depart_from"), as_of) & (F.col("price_krw") >= FLOOR) & in_region(F.col("destination"), f.region))
    if f.max_price is not None:
        ready = ready.where(F.col("price_krw") <= f.max_price)
    newest = ready.orderBy(F.desc("posted_at"), "id").limit(pool)
    return newest.orderBy(F.desc(signal_rank(F.col("social_signal"))), F.desc("posted_at"), "id").limit(n)


def deal_list(deals: DataFrame, f: Filters, as_of: dt.datetime, n: int = 50, ready_only: bool = True) -> DataFrame:
    """The newest live deals. ready_only: above the price floor and not past, as pages show them; the
    list that programs ask for has all."""
    ready = deals.where(is_live(as_of))
    if ready_only:
        ready = ready.where(not_past(F.col("depart_from"), as_of) & (F.col("price_krw") >= FLOOR))
    return common(ready, f, as_of).orderBy(F.desc("posted_at"), "id").limit(n)


def counter(deals: DataFrame, as_of: dt.datetime, n: int = 3) -> DataFrame:
    """Dearer than usual: a rate of -0.10 or less in the last seven days."""
    ready = deals.where((F.col("discount_rate") <= -0.10) & is_live(as_of) & not_past(F.col("depart_from"), as_of) & (F.col("posted_at") >= _ago(as_of, days=7)))
    return ready.orderBy("discount_rate", "id").limit(n)


def sections(top: DataFrame, community: DataFrame, listed: DataFrame) -> DataFrame:
    """Hero, picks and list as one, each deal in the first section that has it."""
    rest = community.join(top, "id", "left_anti")
    last = listed.join(top, "id", "left_anti").join(rest, "id", "left_anti")
    return (top.withColumn("section", F.lit("hero")).unionByName(rest.withColumn("section", F.lit("picks"))).unionByName(last.withColumn("section", F.lit("list"))))


def frequency(shown: DataFrame, deals: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """(id, ordinal, count30d) of shown deals: the place among the route's deals of the window by
    time, and their count; 0 and 0 outside it. Routes that are not shown never reach the window."""
    window = deals.where((F.col("posted_at") >= _ago(as_of, days=days)) & (F.col("posted_at") <= lit_time(as_of)))
    routes = window.join(shown.select("origin", "destination").distinct(), ["origin", "destination"], "left_semi")
    places = ranked(routes.select("id", "origin", "destination", "posted_at"), ["origin", "destination"], [F.date_trunc("hour", "posted_at")], ["posted_at", "id"], "ordinal", "count30d")
    return shown.select("id").join(places.select("id", "ordinal", "count30d"), "id", "left").select("id", F.coalesce("ordinal", F.lit(0)).cast("int").alias("ordinal"), F.coalesce("count30d", F.lit(0)).cast("long").alias("count30d"))


def timeline(deals: DataFrame, ranks: DataFrame, as_of: dt.datetime, n: int = 7) -> DataFrame:
    """The newest deal of each destination in the last 24 hours, if it is an event of some kind. A
    newest deal of no kind hides older ones."""
    day = deals.where((F.col("posted_at") >= _ago(as_of, hours=24)) & F.col("destination").isNotNull() & (F.col("destination") != ""))
    newest = Window.partitionBy("destination").orderBy(F.desc("posted_at"), "id")
    one = day.withColumn("_n", F.row_number().over(newest)).where("_n = 1").join(ranks.select("id", "ordinal"), "id", "left")
    kind = (F.when(F.col("hot_deal"), "hot").when(F.coalesce("ordinal", F.lit(0)) == 1, "first").when(F.col("verification_status") == "price_changed", "price_up")
            .when(round_half_up(F.col("discount_rate") * 100) >= 20, "new"))
    return one.withColumn("kind", kind).where("kind IS NOT NULL").orderBy(F.desc("posted_at"), "id").limit(n).select("id", "destination", "posted_at", "kind", "price_krw")


def price_trace(ids: DataFrame, deals: DataFrame, obs: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    """(id, day, price_krw, lowest, highest): each UTC day's least price on the deal's route and
    class, and the extremes of those."""
    keys = ["origin", "destination", "carrier_class"]
    wanted = deals.join(ids, "id", "left_semi").select("id", *keys)
    seen = obs.where((F.col("observed_at") >= _ago(as_of, days=days)) & (F.col("observed_at") <= lit_time(as_of)) & (F.col("price_krw") > 0))
    daily = seen.groupBy(*keys, F.to_date("observed_at").alias("day")).agg(F.min("price_krw").alias("price_krw"))
    # The extremes of a key's days, at most `days` rows, before they are given to each of its deals.
    whole = Window.partitionBy(*keys)
    daily = daily.select("*", F.min("price_krw").over(whole).alias("lowest"), F.max("price_krw").over(whole).alias("highest"))
    return wanted.join(daily, keys).select("id", "day", "price_krw", "lowest", "highest")


def sparkline(trace: DataFrame, width: float = 120, height: float = 30, pad: float = 2, least: int = 3) -> DataFrame:
    """Points and segments of a trace: x evenly spaced, y scaled between the extremes; whether the
    segment to the next point touches one. Traces of fewer points give nothing."""
    by_day, whole = Window.partitionBy("id").orderBy("day"), Window.partitionBy("id")
    n, i = F.count("*").over(whole), F.row_number().over(by_day) - 1
    nxt = F.lead("price_krw").over(by_day)
    span = F.greatest(F.lit(1), F.col("highest") - F.col("lowest"))
    made = trace.withColumn("n", n).withColumn("i", i).withColumn("next", nxt).where(F.col("n") >= least)
    touch = lambda c: F.when(F.col("next").isNotNull(), (F.col("price_krw") == F.col(c)) | (F.col("next") == F.col(c)))
    return made.select("id", "day", "price_krw", (F.col("i") * F.lit(width) / (F.col("n") - 1)).alias("x"),
                       (F.lit(height) - pad - (F.col("price_krw") - F.col("lowest")) / span * (height - 2 * pad)).alias("y"), touch("lowest").alias("touches_low"), touch("highest").alias("touches_high"))


def snapshot_deals(snapshots: DataFrame, deals: DataFrame) -> DataFrame:
    """Each day's deals in the order of its array; ids without a deal drop out."""
    at = snapshots.select("date", F.posexplode("deal_ids").alias("pos", "id"))
    return at.join(deals, "id").select("date", "pos", *[c for c in deals.columns])


def saved_routes(saved: DataFrame, deals: DataFrame, n: int = 3) -> DataFrame:
    """saved: (ord, destination). The first n with their newest deal, or without."""
    first = Window.partitionBy("destination").orderBy(F.desc("posted_at"), "id")
    one = deals.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("destination", "id", "price_krw", "hot_deal", "discount_rate")
    return saved.orderBy("ord").limit(n).join(one, "destination", "left")


def mobile_preview(market: DataFrame, order: DataFrame, n: int = 3) -> DataFrame:
    """market with its display order and whether it is among the n cheapest (nulls last, then order)."""
    j = market.join(order, "destination")
    place = F.row_number().over(Window.partitionBy("origin").orderBy(F.asc_nulls_last("cheapest_today_krw"), "ord"))
    return j.withColumn("preview", place <= n)


def home(deals: DataFrame, f: Filters, as_of: dt.datetime) -> DataFrame:
    """The home page's deals: section, and frequency rank of each."""
    shown = sections(hero(deals, f, as_of), picks(deals, f, as_of), deal_list(deals, f, as_of))
    return shown.join(frequency(shown, deals, as_of), "id")


def home_bundle(deals: DataFrame, heatmap: DataFrame, health: DataFrame, f: Filters, as_of: dt.datetime) -> DataFrame:
    """All that the home page shows, as (part, key, label, price_krw): the deals of the three sections
    with their frequency rank, those dearer than usual, the events of the last day among the shown
    deals, the market's cheapest prices with their source, and the state of each crawled source."""
    shown = sections(hero(deals, f, as_of), picks(deals, f, as_of), deal_list(deals, f, as_of))
    ranks = frequency(shown, deals, as_of)
    row = lambda df, part, key, label, price: df.select(
        part.alias("part"), key.cast("string").alias("key"), label.cast("string").alias("label"), price.cast("int").alias("price_krw"))
    none = F.lit(None)
    id_, price = F.col("id"), F.col("price_krw")
    parts = [
        row(shown.join(ranks, "id"), F.col("section"), id_, F.concat_ws("/", "ordinal", "count30d"), price), row(counter(deals, as_of), F.lit("counter"), id_, none, price),
        row(timeline(shown, ranks, as_of), F.lit("timeline"), id_, F.col("kind"), price),
        row(heatmap, F.lit("market"), F.concat_ws("-", "origin", "destination"), F.col("source"), F.col("cheapest_today_krw")),
        row(health, F.lit("source"), F.col("source"), F.col("state"), none)]
    return reduce(DataFrame.unionByName, parts)


def compare(chosen: DataFrame, market: DataFrame, n: int = 4) -> DataFrame:
    """chosen: (ord, destination). The first n with their market rows, or without."""
    return chosen.orderBy("ord").limit(n).join(market, "destination", "left")
