"""Registered queries over the domain's tables, each with its SQL twin; keys name survey entries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewright.functions import dates, text
from farewright.functions.jsmath import round_half_up
from farewright.operators import baseline, filters, maintain, merge, ops, serve
from farewright.plans import views as V
from farewright.plans.views import DEALS, ITEMS, KEYED, OBS, RUNS, SEED
from farewright.shared import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF, OBS_AS_OF, EVENTS_AS_OF = V.DEALS_AS_OF, V.OBS_AS_OF, V.EVENTS_AS_OF
NOW, OBS_NOW, EVENTS_NOW = (f"TIMESTAMP '{t}'" for t in (AS_OF, OBS_AS_OF, EVENTS_AS_OF))
DAYS = 60


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(x: str, digits: int = 0) -> str:
    return f"floor(({x}) + 0.5)" if not digits else f"(floor(({x}) * CAST({10**digits} AS DOUBLE) + 0.5) / CAST({10**digits} AS DOUBLE))"


KEYS = "keys AS (SELECT DISTINCT origin, destination, carrier_class FROM obs)"


def _seen(days: int, name: str = "seen") -> str:
    return f"""{name} AS (SELECT origin, destination, carrier_class, count(*) AS n, quantile_cont(price_krw, 0.1) AS o10, quantile_cont(price_krw, 0.5) AS o50, quantile_cont(price_krw, 0.9) AS o90
  FROM obs WHERE observed_at >= {OBS_NOW} - INTERVAL {days} DAY AND observed_at < {OBS_NOW} GROUP BY 1, 2, 3)"""


def _pick(p: str) -> str:
    return f"""CAST(floor(round(CASE level WHEN 1 THEN o{p} WHEN 2 THEN coalesce(o{p} * CAST(0.6 AS DOUBLE) + s{p} * CAST(0.4 AS DOUBLE), o{p}, s{p}) WHEN 3 THEN s{p} WHEN 4 THEN m{p} END, 6) + 0.5) AS INTEGER) AS p{p}_krw"""


BASE = f"""levels AS (
  SELECT k.origin, k.destination, k.carrier_class, coalesce(n, 0) AS n, o10, o50, o90, s.p10_krw AS s10, s.p50_krw AS s50, s.p90_krw AS s90, m.p10_krw AS m10, m.p50_krw AS m50, m.p90_krw AS m90,
    CASE WHEN coalesce(n, 0) >= 30 THEN 1 WHEN coalesce(n, 0) >= 10 AND s.origin IS NOT NULL THEN 2 WHEN s.origin IS NOT NULL AND k.carrier_class IN ('fsc', 'lcc') THEN 3 WHEN m.origin IS NOT NULL THEN 4 ELSE 5 END AS level
  FROM keys k LEFT JOIN seen USING (origin, destination, carrier_class)
    LEFT JOIN seed s ON k.origin = s.origin AND k.destination = s.destination AND k.carrier_class = s.carrier_class
    LEFT JOIN seed m ON k.origin = m.origin AND k.destination = m.destination AND m.carrier_class = 'mixed'),
base AS (
  SELECT origin, destination, carrier_class, {_pick('10')}, {_pick('50')}, {_pick('90')},
    CASE WHEN level = 1 THEN 'observed' WHEN level = 2 THEN 'mixed' WHEN level <= 4 THEN 'seed' END AS source,
    CASE WHEN level = 1 THEN 'high' WHEN level <= 3 THEN 'medium' WHEN level = 4 THEN 'low' END AS confidence, n AS observation_count, level FROM levels)"""

SCORED = f"""scored AS (
  SELECT *, CASE WHEN p50_krw > 0 THEN {_round('(p50_krw - price_krw) / CAST(p50_krw AS DOUBLE)', 3)} END AS discount_rate, {_round('pct', 2)} AS price_percentile, coalesce(pct <= 10 AND confidence IN ('medium', 'high'), false) AS hot_deal
  FROM (SELECT *, CASE WHEN p10_krw IS NULL OR p50_krw IS NULL OR p90_krw IS NULL OR p10_krw > p50_krw OR p50_krw > p90_krw THEN NULL
    WHEN price_krw <= p10_krw THEN CASE WHEN p10_krw <= 0 THEN 0.0 ELSE least(10.0, greatest(0.0, price_krw / CAST(p10_krw AS DOUBLE) * 10)) END
    WHEN price_krw <= p50_krw THEN CASE WHEN p50_krw = p10_krw THEN 10.0 ELSE 10 + 40 * (price_krw - p10_krw) / CAST(p50_krw - p10_krw AS DOUBLE) END
    WHEN price_krw <= p90_krw THEN CASE WHEN p90_krw = p50_krw THEN 50.0 ELSE 50 + 40 * (price_krw - p50_krw) / CAST(p90_krw - p50_krw AS DOUBLE) END
    ELSE least(100.0, 90 + 10 * (price_krw - p90_krw) / CAST(greatest(1, p90_krw) AS DOUBLE)) END AS pct
  FROM (SELECT origin, destination, carrier_class, arg_max(price_krw, (observed_at, source_deal_id, id)) AS price_krw FROM obs WHERE observed_at < {OBS_NOW} GROUP BY 1, 2, 3) JOIN base USING (origin, destination, carrier_class)))"""


@query(f"WITH {OBS}, {SEED}, {KEYS}, {_seen(DAYS)}, {BASE} SELECT * FROM base")
def c01_baseline(spark, sf_dir):
    return V.baselines(spark, sf_dir, DAYS).where("known").select(*baseline.KEY, *baseline.RESOLVED)


@query(f"WITH {OBS}, {SEED}, {KEYS}, {_seen(DAYS)}, {BASE}, {SCORED} SELECT origin, destination, carrier_class, price_krw, p50_krw, confidence, discount_rate, price_percentile, hot_deal FROM scored")
def c02_score(spark, sf_dir):
    base = V.baselines(spark, sf_dir, DAYS).where("price_krw IS NOT NULL")
    return baseline.scored(base).select(*baseline.KEY, "price_krw", "p50_krw", "confidence", "discount_rate", "price_percentile", "hot_deal")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c02_score(spark, sf_dir).orderBy(F.desc_nulls_last("discount_rate"), *baseline.KEY).limit(20)


QUERIES["flagship_top_discounts"] = flagship
ORACLES["flagship_top_discounts"] = f"WITH {OBS}, {SEED}, {KEYS}, {_seen(DAYS)}, {BASE}, {SCORED} SELECT origin, destination, carrier_class, price_krw, p50_krw, confidence, discount_rate, price_percentile, hot_deal FROM scored ORDER BY discount_rate DESC NULLS LAST, origin, destination, carrier_class LIMIT 20"


@query(f"""WITH {OBS}, {SEED}, {KEYS}, {_seen(30)}, {BASE},
wide AS (SELECT origin, destination, max(CASE WHEN carrier_class = 'fsc' THEN struct_pack(p10 := p10_krw, p50 := p50_krw, p90 := p90_krw, source := source, confidence := confidence, n := observation_count) END) AS f,
  max(CASE WHEN carrier_class = 'lcc' THEN struct_pack(p10 := p10_krw, p50 := p50_krw, p90 := p90_krw, source := source, confidence := confidence, n := observation_count) END) AS l,
  max(CASE WHEN carrier_class = 'mixed' THEN struct_pack(p10 := p10_krw, p50 := p50_krw, p90 := p90_krw, source := source, confidence := confidence, n := observation_count) END) AS m FROM base GROUP BY 1, 2),
best AS (SELECT origin, destination, CASE WHEN f.source IN ('observed', 'mixed') AND l.source IN ('observed', 'mixed') THEN
    struct_pack(k := 'mixed', v := struct_pack(p10 := least(f.p10, l.p10), p50 := least(f.p50, l.p50), p90 := least(f.p90, l.p90), source := 'mixed', confidence := CASE WHEN f.confidence = 'high' AND l.confidence = 'high' THEN 'high' ELSE 'medium' END, n := f.n + l.n))
  WHEN l.source IN ('observed', 'mixed') THEN struct_pack(k := 'lcc', v := l) WHEN f.source IN ('observed', 'mixed') THEN struct_pack(k := 'fsc', v := f)
  WHEN f.source = 'seed' AND f.confidence = 'medium' THEN struct_pack(k := 'fsc', v := f) WHEN l.source = 'seed' AND l.confidence = 'medium' THEN struct_pack(k := 'lcc', v := l)
  WHEN m.source = 'seed' THEN struct_pack(k := 'mixed', v := m) WHEN f.source = 'seed' THEN struct_pack(k := 'mixed', v := f) WHEN l.source = 'seed' THEN struct_pack(k := 'mixed', v := l) END AS b FROM wide)
SELECT origin, destination, coalesce(b.k, 'mixed') AS carrier_class, b.v.p10 AS p10_krw, b.v.p50 AS p50_krw, b.v.p90 AS p90_krw, b.v.source AS source, b.v.confidence AS confidence, coalesce(b.v.n, 0) AS observation_count, b.v.p10 AS cheapest_today_krw FROM best""")
def c03_heatmap(spark, sf_dir):
    return baseline.representatives(V.baselines(spark, sf_dir, 30))


_Q5 = ", ".join(f"CAST(floor(round(quantile_cont(price_krw, {q}), 6) + 0.5) AS INTEGER) AS {n}_krw" for n, q in (("p5", 0.05), ("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p90", 0.9)))
MARKET = f"market AS (SELECT origin, destination, carrier_class, count(*) AS n, {_Q5} FROM obs WHERE observed_at >= {OBS_NOW} - INTERVAL 30 DAY AND observed_at < {OBS_NOW} GROUP BY 1, 2, 3 HAVING count(*) >= 10)"


@query(f"WITH {OBS}, {MARKET} SELECT *, 'observed' AS source, 24 AS ttl_hours, {OBS_NOW} AS sampled_at FROM market")
def a03_reaggregate(spark, sf_dir):
    return baseline.reaggregate(V.obs(spark, sf_dir), OBS_AS_OF)


@query(f"WITH {OBS}, {_seen(DAYS)} SELECT origin, destination, carrier_class, n, {_round('round(o10, 6)')}::BIGINT AS p10, {_round('round(o50, 6)')}::BIGINT AS p50, {_round('round(o90, 6)')}::BIGINT AS p90 FROM seen")
def a01_a02_quantiles(spark, sf_dir):
    q = baseline.observed_quantiles(baseline.recent(V.obs(spark, sf_dir), OBS_AS_OF, DAYS), {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select(*baseline.KEY, "n", *(round_half_up(F.round(F.col(c), 6)).alias(c) for c in ("p10", "p50", "p90")))


@query(f"""WITH {OBS}, {SEED}, low AS (SELECT origin, destination, carrier_class, min(price_krw) AS recent_min_krw, count(*) AS recent_n FROM obs WHERE observed_at >= {OBS_NOW} - INTERVAL 7 DAY AND observed_at < {OBS_NOW} GROUP BY 1, 2, 3)
SELECT origin, destination, carrier_class, recent_min_krw, recent_n, p10_krw, {_round('100.0 * (1 - recent_min_krw / CAST(p10_krw AS DOUBLE))', 1)} AS drop_pct FROM low JOIN seed USING (origin, destination, carrier_class) WHERE p10_krw > 0 AND recent_min_krw < p10_krw * 0.5""")
def c09_j13_contamination(spark, sf_dir):
    return ops.contamination(V.obs(spark, sf_dir), V.seed(spark, sf_dir), OBS_AS_OF)


@query(f"WITH {OBS} SELECT CAST(date_trunc('month', observed_at) AS DATE) AS month, count(*) AS n FROM obs WHERE observed_at < {OBS_NOW} - INTERVAL 180 DAY GROUP BY 1")
def a16_old_by_month(spark, sf_dir):
    return ops.old_by_month(V.obs(spark, sf_dir), OBS_AS_OF)


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS rows_total, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) >= 250000 AS over")
def a12_row_alarm(spark, sf_dir):
    return ops.row_alarm(V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem"))


# --- serving ---------------------------------------------------------------------------------

READY = f"(depart_from IS NULL OR depart_from >= CAST({NOW} AS DATE)) AND price_krw >= 50000"
HERO = f"""hero AS (SELECT * EXCLUDE (kind, least_kind) FROM (SELECT *, min(kind) OVER () AS least_kind FROM (
  (SELECT *, 0 AS kind FROM deals WHERE hot_deal AND verification_status = 'active' AND expires_at > {NOW} AND {READY} ORDER BY discount_rate DESC NULLS LAST, id LIMIT 3)
  UNION ALL (SELECT *, 1 AS kind FROM deals WHERE posted_at >= {NOW} - INTERVAL 7 DAY AND verification_status <> 'snapshot' AND {READY} ORDER BY discount_rate DESC NULLS LAST, id LIMIT 3))) WHERE kind = least_kind)"""
PICKS = f"""picks AS (SELECT * FROM (SELECT * FROM deals WHERE social_signal IS NOT NULL AND verification_status = 'active' AND expires_at > {NOW} AND {READY} ORDER BY posted_at DESC, id LIMIT 16)
  ORDER BY CASE social_signal WHEN 'hot' THEN 2 ELSE 1 END DESC, posted_at DESC, id LIMIT 8)"""
LISTED = f"listed AS (SELECT * FROM deals WHERE expires_at > {NOW} AND verification_status <> 'snapshot' AND {READY} ORDER BY posted_at DESC, id LIMIT 50)"
SHOWN = "id, origin, destination, price_krw, discount_rate, posted_at"
SHOWN_COLUMNS = SHOWN.split(", ")


@query(f"WITH {DEALS}, {HERO} SELECT {SHOWN} FROM hero")
def k01_hero(spark, sf_dir):
    return serve.hero(V.deals(spark, sf_dir), filters.Filters(), AS_OF).select(*SHOWN_COLUMNS)


@query(f"""WITH {DEALS} SELECT {SHOWN} FROM deals WHERE posted_at >= {NOW} + INTERVAL 1195 DAY AND verification_status <> 'snapshot' AND (depart_from IS NULL OR depart_from >= CAST({NOW} + INTERVAL 1202 DAY AS DATE)) AND price_krw >= 50000 AND price_krw <= 300000
  ORDER BY discount_rate DESC NULLS LAST, id LIMIT 3""")
def k01_hero_fallback(spark, sf_dir):
    later = AS_OF + dt.timedelta(days=1202)
    hot = V.deals(spark, sf_dir).withColumn("hot_deal", F.lit(False))
    return serve.hero(hot, filters.Filters(max_price=300_000, since="24h"), later).select(*SHOWN_COLUMNS)


@query(f"WITH {DEALS}, {PICKS} SELECT {SHOWN}, social_signal FROM picks")
def k02_picks(spark, sf_dir):
    return serve.picks(V.deals(spark, sf_dir), filters.Filters(), AS_OF).select(*SHOWN_COLUMNS, "social_signal")


@query(f"WITH {DEALS}, {LISTED} SELECT {SHOWN} FROM listed")
def k03_deal_list(spark, sf_dir):
    return serve.deal_list(V.deals(spark, sf_dir), filters.Filters(), AS_OF).select(*SHOWN_COLUMNS)


@query(f"""WITH {DEALS} SELECT {SHOWN} FROM deals WHERE expires_at > {NOW} AND verification_status <> 'snapshot' AND {READY} AND price_krw <= 300000 AND discount_rate >= 0.3 AND posted_at >= {NOW} - INTERVAL 7 DAY
  AND depart_from >= DATE '1998-07-01' AND depart_from < DATE '1998-08-01' ORDER BY posted_at DESC, id LIMIT 50""")
def f03_f10_filtered_list(spark, sf_dir):
    f = filters.parse_filters({"maxPrice": "300000", "minDiscount": "30", "since": "7d", "month": "1998-07", "region": "nowhere"})
    return serve.deal_list(V.deals(spark, sf_dir), f, AS_OF).select(*SHOWN_COLUMNS)


@query(f"WITH {DEALS} SELECT {SHOWN} FROM deals WHERE discount_rate <= -0.10 AND expires_at > {NOW} AND verification_status <> 'snapshot' AND (depart_from IS NULL OR depart_from >= CAST({NOW} AS DATE)) AND posted_at >= {NOW} - INTERVAL 7 DAY ORDER BY discount_rate, id LIMIT 3")
def k04_counter(spark, sf_dir):
    return serve.counter(V.deals(spark, sf_dir), AS_OF).select(*SHOWN_COLUMNS)


SECTIONS = """sections AS (SELECT *, 'hero' AS section FROM hero UNION ALL SELECT *, 'picks' AS section FROM picks WHERE id NOT IN (SELECT id FROM hero)
  UNION ALL SELECT *, 'list' AS section FROM listed WHERE id NOT IN (SELECT id FROM hero) AND id NOT IN (SELECT id FROM picks))"""


def _sections(spark, sf_dir):
    d = V.deals(spark, sf_dir)
    return d, serve.sections(serve.hero(d, filters.Filters(), AS_OF), serve.picks(d, filters.Filters(), AS_OF), serve.deal_list(d, filters.Filters(), AS_OF))


@query(f"WITH {DEALS}, {HERO}, {PICKS}, {LISTED}, {SECTIONS} SELECT {SHOWN}, section FROM sections")
def j04_m05_sections(spark, sf_dir):
    return _sections(spark, sf_dir)[1].select(*SHOWN_COLUMNS, "section")


FREQ = f"""ranked AS (SELECT id, row_number() OVER (PARTITION BY origin, destination ORDER BY posted_at, id) AS ordinal, count(*) OVER (PARTITION BY origin, destination) AS count30d FROM deals WHERE posted_at >= {NOW} - INTERVAL 30 DAY AND posted_at <= {NOW}),
freq AS (SELECT s.id, coalesce(ordinal, 0) AS ordinal, coalesce(count30d, 0) AS count30d FROM sections s LEFT JOIN ranked r ON s.id = r.id)"""


@query(f"WITH {DEALS}, {HERO}, {PICKS}, {LISTED}, {SECTIONS}, {FREQ} SELECT * FROM freq")
def c11_w01_frequency(spark, sf_dir):
    d, shown = _sections(spark, sf_dir)
    return serve.frequency(shown, d, AS_OF).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"WITH {DEALS}, {HERO}, {PICKS}, {LISTED}, {SECTIONS}, {FREQ} SELECT {', '.join('s.' + c for c in SHOWN_COLUMNS)}, section, ordinal, count30d FROM sections s JOIN freq f ON s.id = f.id")
def c10_home(spark, sf_dir):
    return serve.home(V.deals(spark, sf_dir), filters.Filters(), AS_OF).select(*SHOWN_COLUMNS, "section", F.col("ordinal").cast("long").alias("ordinal"), "count30d")


@query(f"""WITH {OBS}, {MARKET}, chosen(ord, destination) AS (VALUES (1, '2'), (2, '9'), (3, '0'), (4, '4'), (5, '1'))
SELECT ord, c.destination, origin, p50_krw FROM chosen c LEFT JOIN (SELECT * FROM market WHERE origin = '1' AND carrier_class = 'fsc') m ON c.destination = m.destination WHERE ord <= 4""")
def j10_compare(spark, sf_dir):
    market = baseline.reaggregate(V.obs(spark, sf_dir), OBS_AS_OF).where("origin = '1' AND carrier_class = 'fsc'")
    chosen = spark.createDataFrame(list(enumerate("29041", 1)), "ord int, destination string")
    return serve.compare(chosen, market).select("ord", "destination", "origin", "p50_krw")


@query(f"""WITH {DEALS} SELECT id, ['NRT', 'KIX', 'JFK', 'HNL', 'CTS', 'XYZ'][CAST(id % 6 AS INTEGER) + 1] AS representative, ['도쿄', 'ITM', 'EWR', 'KOA', '삿포로', 'xyz'][CAST(id % 6 AS INTEGER) + 1] AS city,
  ['fsc', 'lcc', 'mixed', 'mixed'][CAST(id % 4 AS INTEGER) + 1] AS carrier_class FROM deals""")
def j11_j12_x48_lookups(spark, sf_dir):
    from farewright.functions.parsing import class_of

    code = F.get(F.array(*map(F.lit, ("HND", "ITM", "EWR", "KOA", "CTS", "xyz"))), (F.col("id") % 6).cast("int"))
    airline = F.get(F.array(F.lit("oz"), F.lit(" 7C "), F.lit("??"), F.lit(None)), (F.col("id") % 4).cast("int"))
    return V.deals(spark, sf_dir).select("id", text.representative(code).alias("representative"), text.city_name(code).alias("city"), class_of(airline).alias("carrier_class"))


@query(f"""WITH {DEALS}, {FREQ.replace('sections s', 'deals s')}, one AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY posted_at DESC, id) AS rn FROM deals WHERE posted_at >= {NOW} - INTERVAL 24 HOUR AND posted_at <= {NOW})
SELECT id, destination, posted_at, kind, price_krw FROM (SELECT o.*, CASE WHEN hot_deal THEN 'hot' WHEN ordinal = 1 THEN 'first' WHEN verification_status = 'price_changed' THEN 'price_up' WHEN floor(discount_rate * 100 + 0.5) >= 20 THEN 'new' END AS kind
  FROM one o LEFT JOIN freq USING (id) WHERE rn = 1) WHERE kind IS NOT NULL ORDER BY posted_at DESC, id LIMIT 7""")
def w04_timeline(spark, sf_dir):
    d = V.deals(spark, sf_dir).where(F.col("posted_at") <= dates.lit_time(AS_OF))
    return serve.timeline(d, serve.frequency(d, d, AS_OF), AS_OF)


TRACE = f"""ids AS (SELECT CAST(origin AS INTEGER) * 100 + CAST(destination AS INTEGER) AS id, origin, destination, carrier_class FROM keys WHERE carrier_class = 'fsc'),
daily AS (SELECT origin, destination, carrier_class, CAST(observed_at AS DATE) AS day, min(price_krw) AS price_krw FROM obs WHERE observed_at >= {OBS_NOW} - INTERVAL 90 DAY AND observed_at <= {OBS_NOW} AND price_krw > 0 GROUP BY 1, 2, 3, 4),
trace AS (SELECT id, day, price_krw, min(price_krw) OVER (PARTITION BY id) AS lowest, max(price_krw) OVER (PARTITION BY id) AS highest FROM ids JOIN daily USING (origin, destination, carrier_class))"""


def _trace(spark, sf_dir):
    o = V.obs(spark, sf_dir)
    keys = o.where("carrier_class = 'fsc'").select(*baseline.KEY).distinct()
    routes = keys.withColumn("id", F.col("origin").cast("int") * 100 + F.col("destination").cast("int"))
    return serve.price_trace(routes.select("id"), routes, o, OBS_AS_OF)


@query(f"WITH {OBS}, {KEYS}, {TRACE} SELECT * FROM trace")
def c04_a05_price_trace(spark, sf_dir):
    return _trace(spark, sf_dir)


@query(f"""WITH {OBS}, {KEYS}, {TRACE}, p AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY day) - 1 AS i, lead(price_krw) OVER (PARTITION BY id ORDER BY day) AS nxt FROM trace)
SELECT id, day, price_krw, {_round('i * CAST(120 AS DOUBLE) / (n - 1)', 4)} AS x, {_round('CAST(30 AS DOUBLE) - 2 - (price_krw - lowest) / CAST(greatest(1, highest - lowest) AS DOUBLE) * 26', 4)} AS y,
  CASE WHEN nxt IS NOT NULL THEN price_krw = lowest OR nxt = lowest END AS touches_low, CASE WHEN nxt IS NOT NULL THEN price_krw = highest OR nxt = highest END AS touches_high FROM p WHERE n >= 3""")
def x47_sparkline(spark, sf_dir):
    s = serve.sparkline(_trace(spark, sf_dir))
    return s.withColumn("x", round_half_up(F.col("x"), 4)).withColumn("y", round_half_up(F.col("y"), 4))


@query(f"WITH {DEALS} SELECT 0.0 + greatest(0.0, coalesce(max(discount_rate), 0.0)) AS max_rate FROM deals")
def a11_discount_ceiling(spark, sf_dir):
    return ops.discount_ceiling(V.deals(spark, sf_dir))


# --- runs and health -------------------------------------------------------------------------

@query(f"""WITH {RUNS}, newest AS (SELECT * FROM runs ORDER BY started_at DESC, id LIMIT 200)
SELECT source, count(*) AS runs, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, CAST(sum(processed_count) AS BIGINT) AS processed, CAST(sum(saved_count) AS BIGINT) AS saved,
  arg_max(errors, (started_at, id)) FILTER (NOT success) AS last_errors FROM newest GROUP BY source""")
def a09_run_rollup(spark, sf_dir):
    return ops.run_rollup(V.runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT source, arg_max(coalesce(finished_at, started_at), (started_at, id)) AS last_success FROM runs WHERE success GROUP BY source")
def a10_w05_latest_success(spark, sf_dir):
    return ops.latest_success(V.runs(spark, sf_dir))


@query(f"""WITH {RUNS}, l AS (SELECT source, arg_max(coalesce(finished_at, started_at), (started_at, id)) AS last_success FROM runs WHERE success AND started_at <= {EVENTS_NOW} GROUP BY source),
j AS (SELECT source, last_success, CAST(floor((epoch_us({EVENTS_NOW}) / 1e6 - epoch_us(last_success) / 1e6) / 60) AS BIGINT) AS minutes FROM (SELECT DISTINCT source FROM runs) LEFT JOIN l USING (source))
SELECT *, CASE WHEN minutes IS NULL THEN 'unknown' WHEN minutes <= 30 THEN 'ok' WHEN minutes <= 120 THEN 'late' ELSE 'down' END AS state, coalesce(minutes > 120, true) AS stale FROM j""")
def x44_c13_health(spark, sf_dir):
    r = V.runs(spark, sf_dir)
    return ops.health(r, r.select("source").distinct(), EVENTS_AS_OF)


@query(f"""SELECT status, count(*) AS n FROM (SELECT ts AS checked_at, event_type AS status FROM events) WHERE checked_at >= {EVENTS_NOW} - INTERVAL 24 HOUR AND checked_at <= {EVENTS_NOW} GROUP BY 1""")
def a08_status_histogram(spark, sf_dir):
    checks = V.table(spark, sf_dir, "events").select(F.col("ts").alias("checked_at"), F.col("event_type").alias("status"))
    return ops.status_histogram(checks, EVENTS_AS_OF)


USAGE = """calls AS (SELECT ts AS made_at, CAST(floor(value) AS BIGINT) - 20 AS tokens_in, CAST(floor(value / 3) AS BIGINT) AS tokens_out FROM events),
usage AS (SELECT CAST(made_at + INTERVAL 9 HOUR AS DATE) AS date, CAST(sum(greatest(0, tokens_in)) AS BIGINT) AS tokens_in, CAST(sum(greatest(0, tokens_out)) AS BIGINT) AS tokens_out FROM calls GROUP BY 1)"""


def _usage(spark, sf_dir):
    calls = V.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), (F.floor("value") - 20).alias("tokens_in"), F.floor(F.col("value") / 3).alias("tokens_out"))
    none = spark.createDataFrame([], "date date, tokens_in bigint, tokens_out bigint")
    return ops.add_usage(none, calls)


@query(f"WITH {USAGE} SELECT *, CAST(ceil(tokens_in / 150.0) AS BIGINT) AS calls_used, ceil(tokens_in / 150.0) < 300 AS can_spend, CAST(greatest(0, 300 - ceil(tokens_in / 150.0)) AS BIGINT) AS remaining FROM usage")
def a13_c12_budget(spark, sf_dir):
    return ops.budget(_usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT * FROM usage WHERE date >= DATE '2024-01-01' AND date <= DATE '2024-01-20'")
def a18_usage_this_month(spark, sf_dir):
    return ops.usage_this_month(_usage(spark, sf_dir), EVENTS_AS_OF)


@query(f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, coalesce(views > 0, false) ORDER BY views DESC, source_id) AS k, count(*) OVER (PARTITION BY run, coalesce(views > 0, false)) AS n FROM items)
SELECT run, source_id, views, CASE WHEN views > 0 THEN CASE WHEN k <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'hot' WHEN k <= ceil(n * CAST(0.4 AS DOUBLE)) THEN 'trending' END END AS social_signal FROM r""")
def w02_c05_social_signal(spark, sf_dir):
    return merge.social_signals(V.items(spark, sf_dir), ["run"])


# --- runbook ---------------------------------------------------------------------------------

@query(f"WITH {DEALS} SELECT src, verification_status, count(*) AS n FROM (SELECT unnest(sources) AS src, verification_status FROM deals WHERE verified_at >= {NOW} - INTERVAL 24 HOUR AND verified_at <= {NOW}) GROUP BY 1, 2")
def a15_sources_by_status(spark, sf_dir):
    return ops.sources_by_status(V.deals(spark, sf_dir), AS_OF)


@query(f"""WITH {DEALS}, c AS (SELECT origin, destination, count(*) AS n FROM deals WHERE posted_at >= {NOW} - INTERVAL 30 DAY AND posted_at <= {NOW} GROUP BY 1, 2)
SELECT origin, destination, coalesce(n, 0) AS n FROM (SELECT DISTINCT CAST(r.r_regionkey AS VARCHAR) AS origin, n_name AS destination FROM region r, nation) LEFT JOIN c USING (origin, destination)""")
def a17_route_counts(spark, sf_dir):
    origins = F.explode(F.array(*(F.lit(str(i)) for i in range(5)))).alias("origin")
    routes = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("destination"), origins).distinct()
    return ops.route_counts(routes, V.deals(spark, sf_dir), AS_OF)


@query(f"WITH {DEALS} SELECT count(*) FILTER (hot_deal) AS hot_n, count(*) AS total_active, {_round('avg(discount_rate) FILTER (hot_deal) * 100', 1)} AS avg_hot_pct FROM deals WHERE expires_at > {NOW} AND verification_status <> 'snapshot'")
def a14_hot_summary(spark, sf_dir):
    return ops.hot_summary(V.deals(spark, sf_dir), AS_OF)


@query(f"WITH {DEALS} SELECT count(*) AS n FROM deals WHERE body IS NOT NULL AND body_expires_at < {NOW}")
def a18_overdue_bodies(spark, sf_dir):
    return ops.overdue_bodies(V.deals(spark, sf_dir), AS_OF)


SNAPSHOTS = f"snapshots AS (SELECT CAST(posted_at AS DATE) AS date, list(id ORDER BY discount_rate DESC NULLS LAST, id)[1:5] AS deal_ids FROM deals WHERE hot_deal AND verification_status = 'active' GROUP BY 1)"


def _snapshots(spark, sf_dir):
    d = V.deals(spark, sf_dir).where("hot_deal AND verification_status = 'active'").withColumn("date", F.to_date("posted_at"))
    top = merge.latest_per_key(d, ["date", "id"], [F.asc("id")])
    order = F.struct((-F.coalesce("discount_rate", F.lit(-1e9))).alias("r"), "id")
    return top.groupBy("date").agg(F.transform(F.slice(F.sort_array(F.collect_list(order)), 1, 5), lambda x: x["id"]).alias("deal_ids"))


@query(f"""WITH {DEALS}, {SNAPSHOTS}, placed AS (SELECT date, unnest(deal_ids) AS id, generate_subscripts(deal_ids, 1) - 1 AS pos FROM snapshots)
SELECT date, CAST(pos AS INTEGER) AS pos, id, destination, price_krw FROM placed JOIN deals USING (id)""")
def j05_snapshot_deals(spark, sf_dir):
    return serve.snapshot_deals(_snapshots(spark, sf_dir), V.deals(spark, sf_dir).select("id", "destination", "price_krw"))


@query(f"WITH {DEALS}, {SNAPSHOTS} SELECT date, CAST(len(deal_ids) AS BIGINT) AS n FROM snapshots ORDER BY date DESC LIMIT 14")
def a18_snapshot_sizes(spark, sf_dir):
    return ops.snapshot_sizes(_snapshots(spark, sf_dir))


@query(f"""WITH {DEALS}, {SNAPSHOTS} SELECT id, expires_at FROM deals d WHERE expires_at < {NOW} - INTERVAL 30 DAY AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(deal_ids) AS i FROM snapshots) s WHERE s.i = d.id)""")
def j14_expired_unreferenced(spark, sf_dir):
    return maintain.expired_unreferenced(V.deals(spark, sf_dir), _snapshots(spark, sf_dir), AS_OF).select("id", "expires_at")


@query(f"""WITH {DEALS}, top AS (SELECT * FROM deals WHERE hot_deal AND verification_status = 'active' AND expires_at > {NOW} ORDER BY discount_rate DESC NULLS LAST, id LIMIT 5)
SELECT CAST({NOW} + INTERVAL 9 HOUR AS DATE) AS date, array_to_string(list(id ORDER BY discount_rate DESC NULLS LAST, id), ',') AS deal_ids FROM top""")
def k05_daily_snapshot(spark, sf_dir):
    s = maintain.daily_snapshot(V.deals(spark, sf_dir), AS_OF)
    return s.select("date", F.array_join(F.transform("deal_ids", lambda i: i.cast("string")), ",").alias("deal_ids"))


@query(f"""WITH {DEALS} SELECT id, list_filter(sources, lambda s: s <> 'playwings') AS sources_left, len(list_filter(source_urls, lambda u: u NOT LIKE '%playwings%')) AS n_urls,
  CASE WHEN list_contains(sources, 'playwings') AND len(list_filter(sources, lambda s: s <> 'playwings')) = 0 THEN {NOW} ELSE expires_at END AS expires_at FROM deals""".replace("list_filter(sources, lambda s: s <> 'playwings') AS sources_left", "array_to_string(list_filter(sources, lambda s: s <> 'playwings'), ',') AS sources_left"))
def m06_drop_source(spark, sf_dir):
    d = maintain.drop_source(V.deals(spark, sf_dir), "playwings", "playwings", AS_OF)
    return d.select("id", F.array_join("sources", ",").alias("sources_left"), F.size("source_urls").cast("long").alias("n_urls"), "expires_at")


# --- jobs ------------------------------------------------------------------------------------

CHECKS = "checks AS (SELECT id, ['active', 'price_changed', 'snapshot', 'unchecked'][CAST(id % 4 AS INTEGER) + 1] AS new FROM deals WHERE id % 2 = 0 OR id % 5 = 0)"


@query(f"""WITH {DEALS}, {CHECKS} SELECT id, CASE WHEN new IN ('active', 'price_changed', 'snapshot') THEN new ELSE verification_status END AS verification_status, CASE WHEN new IS NOT NULL THEN {NOW} ELSE verified_at END AS verified_at,
  CASE WHEN new = 'active' THEN 0 WHEN new = 'snapshot' THEN verification_fail_count + 1 ELSE verification_fail_count END AS verification_fail_count,
  CASE WHEN new = 'snapshot' AND verification_fail_count + 1 >= 3 THEN {NOW} ELSE expires_at END AS expires_at FROM deals LEFT JOIN checks USING (id)""")
def c07_apply_checks(spark, sf_dir):
    d = V.deals(spark, sf_dir)
    status = F.get(F.array(*map(F.lit, ("active", "price_changed", "snapshot", "unchecked"))), (F.col("id") % 4).cast("int"))
    checks = d.where("id % 2 = 0 OR id % 5 = 0").select("id", status.alias("status"))
    return maintain.apply_checks(d, checks, AS_OF).select("id", "verification_status", "verified_at", "verification_fail_count", "expires_at")


@query(f"WITH {DEALS} SELECT id, verified_at FROM deals WHERE expires_at > {NOW} AND posted_at < {NOW} - INTERVAL 24 HOUR AND (verified_at IS NULL OR verified_at < {NOW} - INTERVAL 3 HOUR) ORDER BY verified_at NULLS FIRST, id LIMIT 100")
def f13_to_verify(spark, sf_dir):
    return maintain.to_verify(V.deals(spark, sf_dir), AS_OF).select("id", "verified_at")


@query(f"WITH {DEALS} SELECT id, discount_rate FROM deals WHERE hot_deal AND expires_at > {NOW} AND (curation_text IS NULL OR curation_generated_at < {NOW} - INTERVAL 24 HOUR) ORDER BY discount_rate DESC NULLS LAST, id LIMIT 50")
def f14_to_curate(spark, sf_dir):
    return maintain.to_curate(V.deals(spark, sf_dir), AS_OF).select("id", "discount_rate")


@query(f"WITH {DEALS} SELECT id, CASE WHEN body_expires_at < {NOW} THEN NULL ELSE body END AS body FROM deals")
def c08_sweep_bodies(spark, sf_dir):
    return maintain.sweep_bodies(V.deals(spark, sf_dir), AS_OF).select("id", "body")


WATCHES = """watches AS (SELECT c_custkey AS id, CAST(n_regionkey AS VARCHAR) AS origin, n_name AS destination, 50000 + c_custkey % 400 * 1000 AS max_price_krw, ['fsc', 'lcc', 'mixed'][CAST(c_custkey % 3 AS INTEGER) + 1] AS carrier_class,
  CASE WHEN c_custkey % 2 = 0 THEN '1998-07' END AS depart_month, c_custkey % 10 <> 0 AS active FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {DEALS}, {WATCHES} SELECT watch_id, id AS deal_id, price_krw FROM (SELECT w.id AS watch_id, d.id, d.price_krw, row_number() OVER (PARTITION BY w.id ORDER BY d.price_krw, d.id) AS rn
  FROM watches w JOIN deals d ON w.origin = d.origin AND w.destination = d.destination AND d.price_krw <= w.max_price_krw AND (w.carrier_class = 'mixed' OR w.carrier_class = d.carrier_class)
    AND (w.depart_month IS NULL OR strftime(d.depart_from, '%Y-%m') = w.depart_month) WHERE w.active AND d.verification_status = 'active' AND d.expires_at > {NOW} AND d.price_krw >= 50000) WHERE rn = 1""")
def j06_c06_watch_match(spark, sf_dir):
    k = F.col("c_custkey")
    w = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.col("n_regionkey").cast("string").alias("origin"), F.col("n_name").alias("destination"), (50000 + k % 400 * 1000).alias("max_price_krw"),
        F.get(F.array(*map(F.lit, ("fsc", "lcc", "mixed"))), (k % 3).cast("int")).alias("carrier_class"), F.when(k % 2 == 0, "1998-07").alias("depart_month"), (k % 10 != 0).alias("active"))
    return maintain.match_watches(w, V.deals(spark, sf_dir), AS_OF)


@query(f"""WITH {OBS}, {SEED}, low AS (SELECT origin, destination, carrier_class, min(price_krw) AS min30_krw FROM obs WHERE observed_at >= {OBS_NOW} - INTERVAL 30 DAY AND observed_at < {OBS_NOW} GROUP BY 1, 2, 3),
hot AS (SELECT DISTINCT origin, destination, carrier_class, CAST(origin AS INTEGER) * 1000 + 7 AS baseline_krw FROM obs)
SELECT h.origin || h.destination || h.carrier_class AS id, h.origin, h.destination, h.carrier_class, coalesce(CASE WHEN s.origin IS NOT NULL THEN s.p50_krw ELSE m.p50_krw END, baseline_krw) AS p50_krw, min30_krw
FROM hot h LEFT JOIN seed s ON h.origin = s.origin AND h.destination = s.destination AND h.carrier_class = s.carrier_class LEFT JOIN seed m ON h.origin = m.origin AND h.destination = m.destination AND m.carrier_class = 'mixed'
LEFT JOIN low l ON h.origin = l.origin AND h.destination = l.destination AND h.carrier_class = l.carrier_class""")
def c14_j08_a06_curation_input(spark, sf_dir):
    o = V.obs(spark, sf_dir)
    hot = o.select(*baseline.KEY).distinct().withColumn("baseline_krw", F.col("origin").cast("int") * 1000 + 7).withColumn("id", F.concat(*baseline.KEY))
    return maintain.curation_input(hot, V.seed(spark, sf_dir), o, OBS_AS_OF)


LATEST = ["discount_rate", "expires_at", "hot_deal"]
KEPT = ["verification_status", "verified_at", "verification_fail_count"]
FOLD = """ordered AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key, {half} ORDER BY posted_at, id) AS rn FROM keyed),
src AS (SELECT dedupe_key, {half} AS half, list(s ORDER BY rn, i) AS all_s, list(u ORDER BY rn, i) AS all_u FROM (SELECT dedupe_key, id, rn, unnest(sources) AS s, unnest(source_urls) AS u, generate_subscripts(sources, 1) AS i FROM ordered) GROUP BY 1, 2),
folded AS (SELECT dedupe_key, {half} AS half, min(price_krw) AS price_krw, min(posted_at) AS posted_at, max(CASE social_signal WHEN 'hot' THEN 2 WHEN 'trending' THEN 1 ELSE 0 END) AS sig, arg_max((discount_rate, expires_at, hot_deal), (posted_at, id)) AS l, arg_max((verification_status, verified_at, verification_fail_count), (posted_at, id)) AS k FROM ordered GROUP BY 1, 2),
f AS (SELECT dedupe_key, half, price_krw, posted_at, sig, l, k, all_s, all_u FROM folded JOIN src USING (dedupe_key, half))""".replace("{half}", "(id % 2)")


@query(f"""WITH {DEALS}, {KEYED}, {FOLD}, s AS (SELECT * FROM f WHERE half = 0), b AS (SELECT * FROM f WHERE half = 1),
j AS (SELECT coalesce(s.dedupe_key, b.dedupe_key) AS dedupe_key, list_concat(coalesce(s.all_s, []), coalesce(b.all_s, [])) AS ss, list_concat(coalesce(s.all_u, []), coalesce(b.all_u, [])) AS uu, least(s.price_krw, b.price_krw) AS price_krw, least(s.posted_at, b.posted_at) AS posted_at,
  b.dedupe_key IS NOT NULL AS new, greatest(coalesce(s.sig, 0), coalesce(b.sig, 0)) AS sig, s.sig AS old_sig, CASE WHEN b.dedupe_key IS NOT NULL THEN b.l ELSE s.l END AS l, CASE WHEN s.dedupe_key IS NOT NULL THEN s.k ELSE b.k END AS k FROM s FULL JOIN b ON s.dedupe_key = b.dedupe_key)
SELECT dedupe_key, array_to_string(list_filter(ss, lambda x, i: list_position(ss, x) = i), ',') AS sources, len(list_distinct(uu)) AS n_urls, price_krw, posted_at,
  CASE WHEN new AND len(list_distinct(ss)) >= 3 THEN 'hot' ELSE CASE CASE WHEN new THEN sig ELSE old_sig END WHEN 2 THEN 'hot' WHEN 1 THEN 'trending' END END AS social_signal,
  l[1] AS discount_rate, l[2] AS expires_at, l[3] AS hot_deal, k[1] AS verification_status, k[2] AS verified_at, k[3] AS verification_fail_count FROM j""")
def m03_merge_upsert(spark, sf_dir):
    """Even ids as the store, odd ones as a batch."""
    d = V.keyed_deals(spark, sf_dir)
    fold = lambda half: merge.fold_batch(d.where(F.col("id") % 2 == half), ["posted_at", "id"], LATEST + KEPT)
    out = merge.upsert(fold(0), fold(1), LATEST, KEPT)
    return out.withColumn("sources", F.array_join("sources", ",")).withColumn("n_urls", F.size("source_urls").cast("long")).drop("source_urls")


#: Posts come in three batches by their time: before the first, before the second, and the rest.
ARRIVALS = dt.datetime(1997, 3, 16), dt.datetime(1999, 5, 16)
_BATCH = f"(CASE WHEN posted_at < TIMESTAMP '{ARRIVALS[0]}' THEN 0 WHEN posted_at < TIMESTAMP '{ARRIVALS[1]}' THEN 1 ELSE 2 END)"
_IN_BATCHES = FOLD.replace("(id % 2)", "0").replace("verification_fail_count), (posted_at, id)", f"verification_fail_count), (-{_BATCH}, posted_at, id)")


@query(f"""WITH {DEALS}, {KEYED}, {_IN_BATCHES}
SELECT dedupe_key, array_to_string(list_filter(all_s, lambda x, i: list_position(all_s, x) = i), ',') AS sources, price_krw, posted_at,
  CASE WHEN len(list_distinct(all_s)) >= 3 THEN 'hot' ELSE CASE sig WHEN 2 THEN 'hot' WHEN 1 THEN 'trending' END END AS social_signal, l[1] AS discount_rate, k[1] AS verification_status FROM f""")
def t01_t07_stream_ingest(spark, sf_dir):
    """All deals through a file stream that is taken up again for each batch, merged into one store."""
    from farewright.streaming.ingest import KEPT as kept
    from farewright.streaming.ingest import DealStore, ingest

    base = fresh_dir(spark, "ingest")
    posts = V.keyed_deals(spark, sf_dir).select("id", "dedupe_key", "sources", "source_urls", "price_krw", "posted_at", "social_signal", *LATEST, *kept)
    store = DealStore(spark, f"{base}/store", buckets=16)
    at, (first, second) = F.col("posted_at"), map(dates.lit_time, ARRIVALS)
    for arrived in (at < first, (at >= first) & (at < second), at.isNull() | (at >= second)):
        posts.where(arrived).write.mode("append").parquet(f"{base}/in")
        ingest(spark.readStream.schema(posts.schema).parquet(f"{base}/in"), store, f"{base}/cp").awaitTermination()
    return store.latest().select("dedupe_key", F.array_join("sources", ",").alias("sources"), "price_krw", "posted_at", "social_signal", "discount_rate", "verification_status")


@query(f"WITH {DEALS} SELECT id, sha1(upper(trim(origin)) || '|' || upper(trim(destination)) || '|' || CAST(CAST(floor(greatest(0, price_krw) / 1000) * 1000 AS BIGINT) AS VARCHAR) || '|' || strftime(coalesce(CAST(depart_from AS TIMESTAMP), posted_at), '%Y-%m') || '|' || carrier_class) AS dedupe_key FROM deals")
def m01_m02_dedupe_key(spark, sf_dir):
    month = text.representative_month(F.col("depart_from"), F.col("posted_at"))
    return V.deals(spark, sf_dir).select("id", text.dedupe_key(F.col("origin"), F.col("destination"), F.col("price_krw"), month, F.col("carrier_class")).alias("dedupe_key"))


# --- labels ----------------------------------------------------------------------------------

_PCT = "floor(discount_rate * 100 + 0.5)"
_I = f"CAST(CAST({_PCT} AS BIGINT) AS VARCHAR)"
_A = f"CAST(CAST(abs({_PCT}) AS BIGINT) AS VARCHAR)"
_DISC = f"CASE WHEN coalesce({_PCT}, 0) = 0 THEN '0%' WHEN {_PCT} > 0 THEN '-' || {_A} || '%' ELSE '+' || {_A} || '%' END"


@query(f"""WITH {DEALS} SELECT id, format('{{:,}}', price_krw) || '원' AS krw, {_DISC} AS discount, 'p' || CAST(CAST(floor(least(100.0, greatest(0.0, price_percentile)) + 0.5) AS BIGINT) AS VARCHAR) AS percentile,
  CASE WHEN hot_deal THEN 'hot' WHEN {_PCT} >= 30 THEN 'good' END AS verdict,
  CASE WHEN baseline_source IS NOT NULL AND discount_rate IS NOT NULL THEN CASE WHEN hot_deal THEN '🔥 저점 ' || {_DISC} WHEN {_PCT} >= 30 THEN '큰 폭 할인 ' || {_DISC} WHEN {_PCT} > 0 THEN {_DISC} END END AS badge,
  CASE WHEN hot_deal THEN '🔥 저점 갱신' WHEN {_PCT} >= 20 THEN {_I} || '% 할인 중' ELSE '현재 리스트에 있음' END AS saved,
  CASE WHEN baseline_source IS NULL OR discount_rate IS NULL THEN '시장 평균 정보 수집 중' ELSE
    CASE WHEN {_PCT} > 0 THEN '시장 평균 대비 -' || {_I} || '%' WHEN {_PCT} < 0 THEN '시장 평균 대비 +' || {_A} || '%' ELSE '시장 평균 수준' END
    || CASE WHEN price_percentile <= 10 AND {_PCT} > 0 THEN ' · 하위 p' || CAST(CAST(floor(price_percentile + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END
    || CASE carrier_class WHEN 'fsc' THEN ' · FSC 분위수' WHEN 'lcc' THEN ' · LCC 분위수' ELSE ' · 혼합 분위수' END || CASE WHEN baseline_confidence = 'low' THEN ' (참고용)' ELSE '' END END AS line,
  CASE WHEN depart_from IS NOT NULL AND date_diff('day', CAST(posted_at AS DATE), depart_from) > 0 THEN date_diff('day', CAST(posted_at AS DATE), depart_from) || '박 ' || (date_diff('day', CAST(posted_at AS DATE), depart_from) + 1) || '일' END AS stay,
  'https://www.skyscanner.co.kr/transport/flights/' || upper(trim(origin)) || '/' || upper(trim(destination)) || '/' || strftime(coalesce(depart_from, CAST({NOW} + INTERVAL 9 HOUR AS DATE) + 7), '%y%m%d') || '/' AS url FROM deals""")
def x16_x32_x40_x46_labels(spark, sf_dir):
    c = F.col
    return V.deals(spark, sf_dir).select(
        "id", text.format_krw(c("price_krw")).alias("krw"), text.format_discount(c("discount_rate")).alias("discount"), text.format_percentile(c("price_percentile")).alias("percentile"),
        text.verdict(c("hot_deal"), c("discount_rate")).alias("verdict"), text.badge(c("hot_deal"), c("discount_rate"), c("baseline_source")).alias("badge"),
        text.saved_status(F.lit(True), c("hot_deal"), c("discount_rate")).alias("saved"),
        text.curation_line(c("discount_rate"), c("price_percentile"), c("carrier_class"), c("baseline_source"), c("baseline_confidence")).alias("line"),
        text.stay_duration(c("posted_at").cast("date"), c("depart_from")).alias("stay"), text.search_url(c("origin"), c("destination"), c("depart_from"), dates.lit_time(AS_OF)).alias("url"))


@query(f"""WITH {DEALS}, u AS (SELECT id, list_filter(sources, lambda x, i: list_position(sources, x) = i) AS s FROM deals)
SELECT id, array_to_string(s[1:3], ' · ') || CASE WHEN len(s) > 3 THEN ' (외 ' || (len(s) - 3) || '곳)' ELSE '' END || CASE WHEN len(s) >= 2 THEN ' · ' || len(s) || '곳 동시 등장' ELSE '' END AS label FROM u""")
def x13_f15_source_label(spark, sf_dir):
    return V.deals(spark, sf_dir).select("id", text.source_label(filters.known_sources(F.col("sources"))).alias("label"))


@query(f"""SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS kst_date, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 9 HOUR AS kst_start, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS kst_text,
  CASE WHEN s < 60 THEN '방금 전' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || '분 전' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || '시간 전'
    WHEN date_diff('day', CAST(ts + INTERVAL 9 HOUR AS DATE), CAST({EVENTS_NOW} + INTERVAL 9 HOUR AS DATE)) = 1 THEN '어제 ' || strftime(ts + INTERVAL 9 HOUR, '%H:%M') ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') END AS relative
FROM (SELECT *, CAST(floor((epoch_us({EVENTS_NOW}) - epoch_us(ts)) / 1e6) AS BIGINT) AS s FROM events WHERE ts <= {EVENTS_NOW})""")
def x30_x31_korean_time(spark, sf_dir):
    now, ts = dates.lit_time(EVENTS_AS_OF), F.col("ts")
    e = V.table(spark, sf_dir, "events").where(ts <= now)
    return e.select("event_id", dates.kst_date(ts).alias("kst_date"), dates.kst_start_of_day(ts).alias("kst_start"), dates.kst_text(ts).alias("kst_text"), dates.relative_time(ts, now).alias("relative"))


@query(f"""WITH {DEALS}, {HERO}, {PICKS}, {LISTED}, {SECTIONS}, {FREQ} SELECT id, CASE WHEN ordinal <= 0 THEN NULL WHEN ordinal = 1 THEN '이 노선 30일 내 첫 등장' WHEN ordinal <= 4 THEN '이 노선 30일 ' || ordinal || '번째' ELSE '자주 올라오는 노선 (30일 ' || count30d || '회)' END AS line FROM freq""")
def x45_frequency_text(spark, sf_dir):
    d, shown = _sections(spark, sf_dir)
    return serve.frequency(shown, d, AS_OF).select("id", text.frequency_text(F.col("ordinal"), F.col("count30d")).alias("line"))


@query(f"""WITH {DEALS}, saved(ord, destination) AS (VALUES (1, 'FRANCE'), (2, 'JAPAN'), (3, 'NOWHERE'), (4, 'CHINA')), one AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY posted_at DESC, id) AS rn FROM deals)
SELECT ord, s.destination, o.id, o.price_krw FROM saved s LEFT JOIN (SELECT * FROM one WHERE rn = 1) o ON s.destination = o.destination WHERE ord <= 3""")
def j09_saved_routes(spark, sf_dir):
    saved = spark.createDataFrame([(1, "FRANCE"), (2, "JAPAN"), (3, "NOWHERE"), (4, "CHINA")], "ord int, destination string")
    return serve.saved_routes(saved, V.deals(spark, sf_dir)).select("ord", "destination", "id", "price_krw")


@query(f"""WITH {OBS}, {MARKET} SELECT origin, destination, p10_krw AS cheapest_today_krw, CAST(CAST(destination AS INTEGER) AS BIGINT) AS ord, row_number() OVER (PARTITION BY origin ORDER BY p10_krw NULLS LAST, destination) <= 3 AS preview FROM market WHERE carrier_class = 'lcc'""")
def k06_mobile_preview(spark, sf_dir):
    market = baseline.reaggregate(V.obs(spark, sf_dir), OBS_AS_OF).where("carrier_class = 'lcc'").select("origin", "destination", F.col("p10_krw").alias("cheapest_today_krw"))
    order = V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("destination"), F.col("r_regionkey").cast("long").alias("ord"))
    return serve.mobile_preview(market, order)


# --- the same operators where other branches give rows -----------------------------------------


@query(f"""WITH {DEALS} SELECT {SHOWN} FROM deals WHERE posted_at >= {NOW} - INTERVAL 7 DAY AND verification_status <> 'snapshot' AND {READY} AND price_krw <= 300000
  ORDER BY discount_rate DESC NULLS LAST, id LIMIT 3""")
def k01_hero_fallback_found(spark, sf_dir):
    """Nothing is hot: the best discounts of seven days, though the filter asks for one day."""
    cold = V.deals(spark, sf_dir).withColumn("hot_deal", F.lit(False))
    return serve.hero(cold, filters.Filters(max_price=300_000, since="24h"), AS_OF).select(*SHOWN_COLUMNS)


COASTS = ["NRT", "BKK", "TPE", "KUL", "LAX"]


@query(f"""WITH {DEALS} SELECT id, ['NRT', 'BKK', 'TPE', 'KUL', 'LAX'][CAST(id % 5 AS INTEGER) + 1] AS destination, price_krw, posted_at FROM deals
WHERE id % 5 IN (1, 3) AND expires_at > {NOW} AND verification_status <> 'snapshot' AND {READY} AND posted_at >= {NOW} - INTERVAL 30 DAY AND price_krw <= 400000 AND discount_rate >= 0.1 ORDER BY posted_at DESC, id LIMIT 50""")
def f03_region_list(spark, sf_dir):
    """A region of several airports, with price, discount and since."""
    d = V.deals(spark, sf_dir).withColumn("destination", F.get(F.array(*map(F.lit, COASTS)), (F.col("id") % 5).cast("int")))
    f = filters.parse_filters({"region": "SEA", "maxPrice": "400000", "minDiscount": "10", "since": "30d"})
    return serve.deal_list(d, f, AS_OF).select("id", "destination", "price_krw", "posted_at")


@query(f"WITH {DEALS} SELECT {SHOWN} FROM deals WHERE expires_at > {NOW} AND verification_status <> 'snapshot' ORDER BY posted_at DESC, id LIMIT 50")
def k03_api_list(spark, sf_dir):
    """The list that programs ask for: no price floor, days that are past too."""
    return serve.deal_list(V.deals(spark, sf_dir), filters.Filters(), AS_OF, ready_only=False).select(*SHOWN_COLUMNS)


@query(f"""WITH {DEALS}, {HERO}, {PICKS}, {LISTED}, {SECTIONS}, {FREQ},
one AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY posted_at DESC, id) AS rn FROM sections WHERE posted_at >= {NOW} - INTERVAL 24 HOUR),
flow AS (SELECT id, price_krw, kind FROM (SELECT o.*, CASE WHEN hot_deal THEN 'hot' WHEN ordinal = 1 THEN 'first' WHEN verification_status = 'price_changed' THEN 'price_up' WHEN floor(discount_rate * 100 + 0.5) >= 20 THEN 'new' END AS kind
  FROM one o LEFT JOIN freq USING (id) WHERE rn = 1) WHERE kind IS NOT NULL ORDER BY posted_at DESC, id LIMIT 7)
SELECT section AS part, CAST(s.id AS VARCHAR) AS key, ordinal || '/' || count30d AS label, price_krw FROM sections s JOIN freq f ON s.id = f.id
UNION ALL SELECT 'counter', CAST(id AS VARCHAR), NULL, price_krw FROM ({ORACLES['k04_counter']})
UNION ALL SELECT 'timeline', CAST(id AS VARCHAR), kind, price_krw FROM flow
UNION ALL SELECT 'market', origin || '-' || destination, source, cheapest_today_krw FROM ({ORACLES['c03_heatmap']})
UNION ALL SELECT 'source', source, state, NULL FROM ({ORACLES['x44_c13_health']})""")
def c10_bundle(spark, sf_dir):
    heatmap = baseline.representatives(V.baselines(spark, sf_dir, 30))
    return serve.home_bundle(V.deals(spark, sf_dir), heatmap, x44_c13_health(spark, sf_dir), filters.Filters(), AS_OF)
