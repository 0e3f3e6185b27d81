"""Quantiles, places and running sums of groups that are spread over tasks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farewright.operators import baseline, maintain, merge, ops, ordered, quantiles, serve

QS = [0.0, 0.05, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_are_exact(spark, monkeypatch):
    """Keys of one value, of few and many, of negative and very large ones, a null key, a null value, none at all."""
    r = random.Random(1)
    data = {"one": [7], "same": [5] * 50, "few": [1, 2, 3, 4], "wide": [r.randrange(-(2**31), 2**31) for _ in range(500)], "hot": [r.randrange(10**6) for _ in range(4000)], None: [3, 9], "dense": [r.randrange(40) for _ in range(999)]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("few", None), ("none", None)], "k string, price_krw int")
    got = {x.k: x for x in baseline.observed_quantiles(rows, {f"q{i}": q for i, q in enumerate(QS)}, ["k"]).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k].n == len(vs)
        assert np.allclose([got[k][f"q{i}"] for i in range(len(QS))], np.quantile(np.array(vs, float), QS), rtol=1e-12)
    assert baseline.observed_quantiles(rows.limit(0), {"a": 0.5}, ["k"]).count() == 0


def test_two_counts_of_one_histogram(spark):
    h = spark.createDataFrame([("a", 10, 3, 0), ("a", 20, 0, 2), ("a", 90_000, 1, 2), ("b", 5, 2, 0)], "k string, v int, x long, y long")
    got = {r.k: r for r in quantiles.exact(h, ["k"], "v", {"x": "x", "y": "y"}, [0.5, 1.0]).collect()}
    assert (got["a"].n_x, got["a"].q_x, got["a"].n_y, got["a"].q_y) == (4, [10.0, 90_000.0], 4, [45_010.0, 90_000.0])
    assert (got["b"].n_x, got["b"].q_x, got["b"].n_y, got["b"].q_y) == (2, [5.0, 5.0], 0, [None, None])


def test_a_hot_key_is_spread(spark):
    """Half of all rows are one key, of as many prices as rows: no window holds more than a band of them."""
    n = 40_000
    rows = spark.range(2 * n).select(F.when(F.col("id") < n, "hot").otherwise((F.col("id") % 500).cast("string")).alias("k"), (F.xxhash64("id") % 20_000_000).cast("int").alias("price_krw"))
    h = baseline.histogram(rows, ["k"])
    assert h.where("k = 'hot'").groupBy(F.floor(F.col("price_krw") / quantiles.BAND)).count().agg(F.max("count")).first()[0] < 60
    got = baseline.observed_quantiles(rows, {"a": 0.1, "b": 0.5, "c": 0.9}, ["k"])
    want = rows.groupBy("k").agg(F.percentile("price_krw", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q"))
    j = got.join(want, "k").where((F.abs(F.col("a") - F.col("q")[0]) > 1e-6) | (F.abs(F.col("b") - F.col("q")[1]) > 1e-6) | (F.abs(F.col("c") - F.col("q")[2]) > 1e-6))
    assert j.count() == 0 and got.count() == 501


def test_rolled_is_each_day_alone(spark):
    r = random.Random(2)
    start = dt.datetime(2026, 1, 1)
    rows = [(r.choice("ab"), r.choice("xy"), r.choice(["fsc", "lcc"]), r.randrange(100, 200), start + dt.timedelta(minutes=r.randrange(90 * 1440))) for _ in range(1500)]
    rows += [("c", "x", "fsc", 5, start), ("a", "x", "fsc", None, start)]
    obs = spark.createDataFrame(rows, "origin string, destination string, carrier_class string, price_krw int, observed_at timestamp_ntz")
    qs, ends = {"p10": 0.1, "p50": 0.5, "p90": 0.9}, [dt.date(2026, 1, 2) + dt.timedelta(days=3 * i) for i in range(30)]
    parts = [quantiles.daily(obs.where(cond), baseline.KEY, "observed_at", "price_krw") for cond in ("price_krw < 150", "price_krw >= 150")]
    got = baseline.rolling_quantiles(parts[0].unionByName(parts[1]), qs, ends, 14)
    want = []
    for end in ends:
        one = baseline.observed_quantiles(baseline.recent(obs, dt.datetime.combine(end, dt.time()), 14), qs)
        want += [(end, *x) for x in one.collect()]
    assert sorted(((x.as_of, *(x[c] for c in (*baseline.KEY, "n", *qs))) for x in got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 150


@pytest.mark.parametrize("hot", [0.2, 1.0])
def test_places(spark, hot):
    """Groups of any size, one of all rows too; bands of one value; ties by id; nulls in group and band."""
    r = random.Random(3)
    rows = [(i, None if r.random() < 0.1 else "g" if r.random() < hot else str(r.randrange(30)), r.choice([None, *range(8)]), r.randrange(10**9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v int, t long")
    got = ordered.ranked(df, ["g"], [F.col("v"), F.floor(F.col("id") / 64)], ["id"]).collect()
    groups = {}
    for x in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[0])):
        groups.setdefault(x[1], []).append(x[0])
    want = {i: (k + 1, len(ids)) for ids in groups.values() for k, i in enumerate(ids)}
    assert {x.id: (x.place, x["size"]) for x in got} == want and len(got) == 2000 and got[0].asDict().keys() == {"id", "g", "v", "t", "place", "size"}


def test_one_run_of_all_rows(spark):
    """Signals of one run that holds everything, with one value of views for most: bands of ids share the work."""
    n = 30_000
    items = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("source_id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).cast("int").alias("views"))
    got = merge.social_signals(items, ["run"])
    assert got.groupBy("social_signal").count().collect() and {x.social_signal: x["count"] for x in got.groupBy("social_signal").count().collect()} == {"hot": 6000, "trending": 6000, None: 18_000}
    order = sorted(((-v, i) for i, v in ((x.source_id, x.views) for x in items.collect()) if v > 0))
    top = {i for _, i in order[: -(-len(order) // 5)]}
    assert {x.source_id for x in got.where("social_signal = 'hot'").collect()} >= set(list(top)[:100]) and len(order) == n - 1


def test_one_route_of_all_deals(spark):
    now = dt.datetime(2026, 4, 18)
    deals = spark.range(5000).select("id", F.lit("A").alias("origin"), F.lit("B").alias("destination"), (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7919 % 43_000).cast("int"))).alias("posted_at"))
    rows = sorted((r.posted_at, r.id) for r in deals.collect())
    got = {r.id: (r.ordinal, r.count30d) for r in serve.frequency(deals, deals, now).collect()}
    inside = [i for t, i in rows if t >= now - dt.timedelta(days=30)]
    assert got == {i: (0, 0) for _, i in rows} | {i: (k + 1, len(inside)) for k, i in enumerate(inside)}


def one_by_one(deal, checks):
    status, at, fails, over = deal
    for t, _, s in sorted(checks):
        at = t
        if s in ("active", "price_changed", "snapshot"):
            status = s
        fails = 0 if s == "active" else fails + (s == "snapshot")
        over = t if s == "snapshot" and fails >= 3 else over
    return status, at, fails, over


def test_check_history(spark):
    """Any number of checks of a deal, over days and within one; ties by id; what has no time or status does nothing."""
    r, now = random.Random(4), dt.datetime(2026, 4, 18)
    kinds = ["active", "price_changed", "snapshot", "snapshot", "snapshot", "unchecked", "strange"]
    deals = {i: ("unchecked", None if i % 2 else now, i % 3, now + dt.timedelta(days=9)) for i in range(60)}
    checks = [(k, r.choice([0, 0, 0, r.randrange(60)]), now + dt.timedelta(hours=r.randrange(24 * 40)), r.choice(kinds)) for k in range(900)]
    bad = [(1000, 1, None, "active"), (1001, 2, now, None), (1002, 777, now, "snapshot"), (1003, None, now, "snapshot")]
    d = spark.createDataFrame([(i, *v) for i, v in deals.items()], "id long, verification_status string, verified_at timestamp_ntz, verification_fail_count int, expires_at timestamp_ntz")
    c = spark.createDataFrame(checks + bad, "check_id long, id long, checked_at timestamp_ntz, status string")
    got = {x.id: tuple(x)[1:] for x in maintain.check_history(d, c).collect()}
    assert got == {i: one_by_one(v, [(t, k, s) for k, j, t, s in checks if j == i]) for i, v in deals.items()}
    assert maintain.check_history(d, c.limit(0)).count() == 60
    once = c.where("status IN ('active', 'snapshot')").dropDuplicates(["id"]).where("id < 60 AND checked_at IS NOT NULL").withColumn("checked_at", F.lit(now).cast("timestamp_ntz"))
    one = maintain.apply_checks(d, once, now).select(*d.columns)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, maintain.check_history(d, once).collect()))


def test_gate(spark):
    """As calls made one by one, where a refused call spends nothing."""
    r, start = random.Random(6), dt.datetime(2026, 4, 17, 14, 0)
    calls = [(i, start + dt.timedelta(seconds=r.randrange(100_000)), r.choice([None, -5, 0, 10, 400])) for i in range(800)]
    calls += [(i, start, 100) for i in range(800, 830)]
    spent, want = {}, {}
    for i, at, n in sorted(calls, key=lambda c: (c[1], c[0])):
        day = (at + dt.timedelta(hours=9)).date()
        want[i] = -(-spent.get(day, 0) // 150) < 100
        if want[i]:
            spent[day] = spent.get(day, 0) + max(0, n or 0)
    got = ops.gated(spark.createDataFrame(calls, "call_id long, at timestamp_ntz, tokens_in long"), limit=100).collect()
    assert {x.call_id: x.allowed for x in got} == want and 0 < sum(want.values()) < len(want)
