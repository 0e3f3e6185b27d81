"""Price baselines by route and class: quantiles, the five-level resolver, the route heatmap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.dims import CLASSES
from farewright.functions.dates import lit_time
from farewright.functions.jsmath import blend, min_ignoring_null, round_quantile
from farewright.functions.scoring import score
from farewright.operators import quantiles

KEY = ["origin", "destination", "carrier_class"]
RESOLVED = ["p10_krw", "p50_krw", "p90_krw", "source", "confidence", "observation_count", "level"]
HIGH, MEDIUM = 30, 10


def recent(obs: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """[as_of - days, as_of). The bounds are literals, so they reach the scan."""
    return obs.where((F.col("observed_at") >= lit_time(as_of - dt.timedelta(days=days))) & (F.col("observed_at") < lit_time(as_of)))


def histogram(obs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, price_krw, n): how often each price was seen."""
    return obs.where("price_krw IS NOT NULL").groupBy(*keys, "price_krw").agg(F.count("*").alias("n"))


def observed_quantiles(obs: DataFrame, qs: dict[str, float], keys: list[str] = KEY) -> DataFrame:
    """Exact quantiles with linear interpolation, and n, the number of prices."""
    return _named(quantiles.exact(histogram(obs, keys), keys, "price_krw", {"o": "n"}, list(qs.values())), qs, keys)


def _named(made: DataFrame, qs: dict[str, float], keys: list[str]) -> DataFrame:
    return made.select(*keys, F.col("n_o").alias("n"), *(F.col("q_o")[i].alias(name) for i, name in enumerate(qs)))


def rolling_quantiles(days_of: DataFrame, qs: dict[str, float], as_of: list[dt.date], days: int, keys: list[str] = KEY) -> DataFrame:
    """What observed_quantiles gives for [as_of - days, as_of), for each of several as_of, from the daily
    histograms (quantiles.daily) in one pass."""
    held = [*keys, "as_of"]
    seen = quantiles.rolled(days_of, keys, "price_krw", as_of, days)
    return _named(quantiles.exact(seen, held, "price_krw", {"o": "n"}, list(qs.values())), qs, held)


def reaggregate(obs: DataFrame, as_of: dt.datetime, days: int = 30, least: int = MEDIUM) -> DataFrame:
    """The observed rows of the market table: five rounded quantiles for keys with enough rows."""
    qs = {"p5_krw": 0.05, "p10_krw": 0.1, "p25_krw": 0.25, "p50_krw": 0.5, "p90_krw": 0.9}
    made = observed_quantiles(recent(obs, as_of, days), qs).where(F.col("n") >= least)
    return made.select(*KEY, "n", *(round_quantile(F.col(q)).alias(q) for q in qs), F.lit("observed").alias("source"), F.lit(24).alias("ttl_hours"), lit_time(as_of).alias("sampled_at"))


def resolve_baseline(keys: DataFrame, obs: DataFrame, seed: DataFrame, as_of: dt.datetime, days: int = 30, force_seed: DataFrame | None = None) -> DataFrame:
    """For each key: p10_krw, p50_krw, p90_krw, source, confidence, observation_count.

    1. 30 or more observations: theirs (observed, high). 2. 10 to 29 and a seed of the class: 0.6 and
    0.4 (mixed, medium). 3. A seed of the class fsc or lcc: it (seed, medium). 4. A mixed seed for
    the route: it (seed, low). 5. Nulls. force_seed: keys whose observations count for nothing."""
    if force_seed is not None:
        obs = obs.join(force_seed.select(*KEY), KEY, "left_anti")
    q = {"o10": 0.1, "o50": 0.5, "o90": 0.9}
    seen = observed_quantiles(recent(obs, as_of, days), q)
    own = seed.select(*KEY, F.col("p10_krw").alias("s10"), F.col("p50_krw").alias("s50"), F.col("p90_krw").alias("s90"), F.lit(True).alias("has_own"))
    mixed = seed.where("carrier_class = 'mixed'").select("origin", "destination", F.col("p10_krw").alias("m10"), F.col("p50_krw").alias("m50"), F.col("p90_krw").alias("m90"), F.lit(True).alias("has_mixed"))
    return _resolved(keys.join(seen, KEY, "left").join(own, KEY, "left").join(mixed, ["origin", "destination"], "left")).select(*keys.columns, *RESOLVED)


def _resolved(found: DataFrame) -> DataFrame:
    """found: KEY, n, o10.. (observed), s10.. and has_own (seed of the class), m10.. and has_mixed (the
    route's mixed seed); adds the columns RESOLVED."""
    n = F.coalesce("n", F.lit(0))
    level = (F.when(n >= HIGH, 1).when((n >= MEDIUM) & F.col("has_own"), 2)
             .when(F.col("has_own") & F.col("carrier_class").isin("fsc", "lcc"), 3).when(F.col("has_mixed"), 4).otherwise(5))
    j = found.withColumn("level", level)

    def pick(p: str) -> Column:
        o, s, m = F.col(f"o{p}"), F.col(f"s{p}"), F.col(f"m{p}")
        value = F.when(F.col("level") == 1, o).when(F.col("level") == 2, blend(o, s)).when(F.col("level") == 3, s).when(F.col("level") == 4, m)
        return round_quantile(value)

    source = F.when(F.col("level") == 1, "observed").when(F.col("level") == 2, "mixed").when(F.col("level") <= 4, "seed")
    sure = F.when(F.col("level") == 1, "high").when(F.col("level") <= 3, "medium").when(F.col("level") == 4, "low")
    return j.withColumns({**{f"p{p}_krw": pick(p) for p in ("10", "50", "90")}, "source": source, "confidence": sure, "observation_count": n.cast("long")})


def route_baselines(obs: DataFrame, as_of: dt.datetime, seed_from: dt.datetime, seed_to: dt.datetime, days: int = 30, seeded: Column | None = None) -> DataFrame:
    """What resolve_baseline gives for all three classes of each observed route, with a seed that is
    the quantiles of the observations of [seed_from, seed_to), from one histogram over one scan.

    seeded: which keys have a seed (null: all that were observed then). known: whether the key itself
    was ever observed. price_krw: its newest price before as_of (ties as in latest_price). One row for
    each route and class: the classes of a route meet in a group of at most three rows."""
    at, price = F.col("observed_at"), F.col("price_krw")
    in_days = (at >= lit_time(as_of - dt.timedelta(days=days))) & (at < lit_time(as_of))
    in_seed = (at >= lit_time(seed_from)) & (at < lit_time(seed_to))
    newest = F.max(F.when(at < lit_time(as_of), F.struct("observed_at", "source_deal_id", "id")))
    seen = obs.groupBy(*KEY, "price_krw").agg(F.count_if(in_days & price.isNotNull()).alias("n"), F.count_if(in_seed & price.isNotNull()).alias("k"), newest.alias("newest"))
    last = seen.groupBy(*KEY).agg(F.max_by("price_krw", "newest").alias("price_krw"))
    each = quantiles.exact(seen.where("price_krw IS NOT NULL"), KEY, "price_krw", {"o": "n", "s": "k"}, [0.1, 0.5, 0.9])
    each = last.alias("l").join(each.alias("e"), quantiles.same("l", "e", KEY), "left").select("l.*", F.col("e.n_o").alias("n"), F.col("e.n_s").alias("k"), F.col("e.q_o").alias("o"), F.col("e.q_s").alias("s"))
    has = (F.coalesce("k", F.lit(0)) > 0) & (F.lit(True) if seeded is None else F.coalesce(seeded, F.lit(False)))
    each = each.withColumn("has_own", has).withColumn("s", F.when(has, F.transform("s", round_quantile)))
    of = F.struct("n", "o", "s", "has_own", "price_krw", F.lit(True).alias("known"))
    routes = each.groupBy("origin", "destination").agg(*(F.max_by(of, F.when(F.col("carrier_class") == c, 1)).alias(c) for c in CLASSES))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("carrier_class"), F.col(c).alias("x")) for c in CLASSES)))
    wide = routes.select("origin", "destination", F.col("mixed").alias("m"), rows.alias("r")).select("origin", "destination", "r.carrier_class", "m", "r.x")
    numbers = {f"{p}{q}": F.col(source)[i] for p, source in (("o", "x.o"), ("s", "x.s"), ("m", "m.s")) for i, q in enumerate(("10", "50", "90"))}
    flags = {"n": F.col("x.n"), "has_own": F.col("x.has_own"), "has_mixed": F.col("m.has_own"), "price_krw": F.col("x.price_krw"), "known": F.coalesce("x.known", F.lit(False))}
    return _resolved(wide.withColumns({**numbers, **flags})).select(*KEY, "price_krw", "known", *RESOLVED)


def scored(priced: DataFrame) -> DataFrame:
    """priced: price_krw and the columns of its baseline."""
    return priced.withColumns(score(F.col("price_krw"), F.col("p10_krw"), F.col("p50_krw"), F.col("p90_krw"), F.col("confidence")))


def latest_price(obs: DataFrame, as_of: dt.datetime, keys: list[str] = KEY) -> DataFrame:
    """The newest price of each key before as_of; ties go to the larger source, then line."""
    order = F.struct("observed_at", "source_deal_id", "id")
    seen = obs.where(F.col("observed_at") < lit_time(as_of))
    return seen.groupBy(*keys).agg(F.max_by("price_krw", order).alias("price_krw"))


def heatmap(routes: DataFrame, obs: DataFrame, seed: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """One row for each (origin, destination) of routes: the representative of its three classes."""
    classes = F.explode(F.array(*map(F.lit, CLASSES))).alias("carrier_class")
    return representatives(resolve_baseline(routes.select("origin", "destination", classes), obs, seed, as_of, days))


def representatives(base: DataFrame) -> DataFrame:
    """The heatmap's rows from the resolved baselines of all three classes of each route."""
    packed = F.struct("p10_krw", "p50_krw", "p90_krw", "source", "confidence", "observation_count")
    wide = base.groupBy("origin", "destination").agg(*(F.max(F.when(F.col("carrier_class") == c, packed)).alias(c) for c in CLASSES))
    f, l, m = F.col("fsc"), F.col("lcc"), F.col("mixed")
    seen = lambda b: F.coalesce(b["source"].isin("observed", "mixed"), F.lit(False))
    is_seed = lambda b, sure: (b["source"] == "seed") & (b["confidence"] == sure)
    row = lambda klass, b: F.struct(F.lit(klass).alias("carrier_class"), b["p10_krw"].alias("p10_krw"), b["p50_krw"].alias("p50_krw"), b["p90_krw"].alias("p90_krw"), b["source"].alias("source"), b["confidence"].alias("confidence"), b["observation_count"].alias("observation_count"))
    both = F.struct(
        F.lit("mixed").alias("carrier_class"), *(min_ignoring_null(f[p], l[p]).alias(p) for p in ("p10_krw", "p50_krw", "p90_krw")), F.lit("mixed").alias("source"),
        F.when((f["confidence"] == "high") & (l["confidence"] == "high"), "high").otherwise("medium").alias("confidence"),
        (f["observation_count"] + l["observation_count"]).alias("observation_count"))
    empty = F.struct(F.lit("mixed").alias("carrier_class"), *(F.lit(None).cast("int").alias(p) for p in ("p10_krw", "p50_krw", "p90_krw")), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("confidence"), F.lit(0).cast("long").alias("observation_count"))
    best = (F.when(seen(f) & seen(l), both).when(seen(l), row("lcc", l)).when(seen(f), row("fsc", f)).when(is_seed(f, "medium"), row("fsc", f))
            .when(is_seed(l, "medium"), row("lcc", l)).when(m["source"] == "seed", row("mixed", m)).when(is_seed(f, "low"), row("mixed", f))
            .when(is_seed(l, "low"), row("mixed", l)).otherwise(empty))
    return wide.select("origin", "destination", best.alias("b")).select("origin", "destination", "b.*", F.col("b.p10_krw").alias("cheapest_today_krw"))
