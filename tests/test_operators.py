import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from farewright.functions.jsmath import round_quantile
from farewright.operators import baseline, filters, maintain, merge, ops, serve
from farewright.sources import boards, markup, tables
from farewright.streaming import ingest

NOW = dt.datetime(2026, 4, 18, 12)
KEY = ("ICN", "NRT", "fsc")


def observations(spark, prices, key=KEY, at=NOW - dt.timedelta(days=1)):
    return spark.createDataFrame([(*key, p, at, i, i) for i, p in enumerate(prices)], "origin string, destination string, carrier_class string, price_krw int, observed_at timestamp_ntz, source_deal_id long, id long")


def seeds(spark, rows):
    return spark.createDataFrame(rows, "origin string, destination string, carrier_class string, p10_krw int, p50_krw int, p90_krw int")


@pytest.mark.parametrize("n, own, mixed, want", [
    (30, True, True, ("observed", "high", 1)), (15, True, True, ("mixed", "medium", 2)), (9, True, True, ("seed", "medium", 3)), (15, False, True, ("seed", "low", 4)), (9, False, False, (None, None, 5))])
def test_levels(spark, n, own, mixed, want):
    seed = seeds(spark, [(*KEY, 200, 300, 400)] * own + [("ICN", "NRT", "mixed", 1, 2, 3)] * mixed)
    keys = spark.createDataFrame([KEY], "origin string, destination string, carrier_class string")
    got = baseline.resolve_baseline(keys, observations(spark, [100 + 15 * i for i in range(n)]), seed, NOW).first()
    assert (got.source, got.confidence, got.level) == want and got.observation_count == n
    if n == 15 and own:
        assert got.p50_krw == 243


def test_force_seed_and_window(spark):
    seed = seeds(spark, [(*KEY, 200, 300, 400)])
    keys = spark.createDataFrame([KEY], "origin string, destination string, carrier_class string")
    old = observations(spark, range(50), at=NOW - dt.timedelta(days=31))
    assert baseline.resolve_baseline(keys, old, seed, NOW).first().source == "seed"
    assert baseline.resolve_baseline(keys, observations(spark, range(50)), seed, NOW, force_seed=keys).first().source == "seed"


def test_quantiles(spark):
    got = baseline.observed_quantiles(observations(spark, range(100, 1001, 100)), {"a": 0.5, "b": 0.9}).first()
    assert (got.n, got.a, got.b) == (10, 550, 910)


@pytest.mark.parametrize("views, want", [
    (list(range(10, 0, -1)), ["hot"] * 2 + ["trending"] * 2 + [None] * 6), ([5, 4, None, 0, -1], ["hot", None, None, None, None]), ([7] * 5, ["hot", "trending", None, None, None]), ([1], ["hot"])])
def test_signals(spark, views, want):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(views)], "run string, source_id int, views int")
    got = merge.social_signals(rows, ["run"]).orderBy("source_id").collect()
    assert [r.social_signal for r in got] == want


def deal(spark, **kw):
    """One deal as a frame."""
    base = {"id": 1, "dedupe_key": "k", "sources": ["a"], "source_urls": ["u"], "price_krw": 100, "posted_at": NOW, "social_signal": None, "discount_rate": 0.1, "expires_at": NOW, "hot_deal": False, "verification_status": "active", "verified_at": NOW, "verification_fail_count": 1}
    return spark.createDataFrame([base | kw], "id long, dedupe_key string, sources array<string>, source_urls array<string>, price_krw int, posted_at timestamp_ntz, social_signal string, discount_rate double, expires_at timestamp_ntz, hot_deal boolean, verification_status string, verified_at timestamp_ntz, verification_fail_count int")


def test_merge(spark):
    fold = lambda d: merge.fold_batch(d, ["posted_at", "id"], ingest.LATEST + ingest.KEPT)
    old = fold(deal(spark, sources=["a", "b"]))
    new = fold(deal(spark, id=2, sources=["b", "c"], price_krw=90, posted_at=NOW + dt.timedelta(hours=1), social_signal="trending", discount_rate=0.2, verification_status="unchecked").unionByName(deal(spark, id=3, dedupe_key="other")))
    got = {r.dedupe_key: r for r in merge.upsert(old, new, ingest.LATEST, ingest.KEPT).collect()}
    k = got["k"]
    assert (k.sources, k.price_krw, k.posted_at, k.social_signal, k.discount_rate, k.verification_status) == (["a", "b", "c"], 90, NOW, "hot", 0.2, "active")
    assert got["other"].social_signal is None


def test_watches_by_brute_force(spark):
    """The reduced deals decide every watch as all deals would: ties of price, no month, no class."""
    r = random.Random(5)
    months = [None, dt.date(2026, 3, 2), dt.date(2026, 3, 30), dt.date(2026, 4, 1)]
    d = [(i, r.choice(["A", "B", None]), r.choice(["X", "Y"]), r.choice(["fsc", "lcc", "mixed", None]), r.choice(months), r.choice([50_000, 60_000, 70_000])) for i in range(80)]
    w = [(i, r.choice(["A", "B"]), r.choice(["X", "Y"]), r.choice(["fsc", "lcc", "mixed"]), r.choice([None, "2026-03", "2026-04"]), r.choice([40_000, 55_000, 80_000]), r.random() < 0.8) for i in range(60)]
    deals = spark.createDataFrame(d, "id long, origin string, destination string, carrier_class string, depart_from date, price_krw int")
    deals = deals.withColumn("verification_status", F.lit("active")).withColumn("expires_at", F.lit(NOW + dt.timedelta(days=1)).cast("timestamp_ntz"))
    watches = spark.createDataFrame(w, "id long, origin string, destination string, carrier_class string, depart_month string, max_price_krw int, active boolean")
    want = {}
    for i, o, t, c, m, most, active in w:
        fits = [(p, k) for k, do, dd, dc, at, p in d if active and (do, dd) == (o, t) and p <= most and c in ("mixed", dc) and (m is None or (at and f"{at:%Y-%m}" == m))]
        if fits:
            want[i] = min(fits)
    got = {x.watch_id: (x.price_krw, x.deal_id) for x in maintain.match_watches(watches, deals, NOW).collect()}
    assert got == want and len(got) > 10


def test_state_machine(spark):
    d = spark.createDataFrame([(i, "unchecked", None, 2, NOW + dt.timedelta(days=1)) for i in range(5)], "id int, verification_status string, verified_at timestamp_ntz, verification_fail_count int, expires_at timestamp_ntz")
    checks = spark.createDataFrame([(0, "active"), (1, "price_changed"), (2, "snapshot"), (3, "unchecked")], "id int, status string")
    got = {r.id: (r.verification_status, r.verification_fail_count, r.expires_at == NOW, r.verified_at) for r in maintain.apply_checks(d, checks, NOW).collect()}
    assert got == {0: ("active", 0, False, NOW), 1: ("price_changed", 2, False, NOW), 2: ("snapshot", 3, True, NOW), 3: ("unchecked", 2, False, NOW), 4: ("unchecked", 2, False, None)}


def test_cooled_down(spark):
    rows = spark.createDataFrame([(None, 24), (NOW - dt.timedelta(hours=24), 24), (NOW - dt.timedelta(hours=25), 24)], "last timestamp_ntz, h int")
    assert [r[0] for r in rows.select(maintain.cooled_down(F.col("last"), F.col("h"), NOW)).collect()] == [True, False, True]


def test_search(spark):
    items = spark.createDataFrame([(i, f"Item {i}") for i in range(30)], "ord int, label string")
    assert filters.search(items, " ").count() == 12 and filters.search(items, "ITEM").count() == 20 and filters.search(items, "29").count() == 1


def test_usable(spark):
    d = spark.createDataFrame([("ICN", "NRT", 99.5, None, "KE", "lcc"), ("ICN", None, 1.0, None, None, None), ("ICN", "NRT", 0.0, None, None, None), ("ICN", "NRT", 5.0, "oneway", None, None)], "origin string, destination string, price_krw double, trip_type string, carrier_code string, carrier_class string")
    classes = spark.createDataFrame([("KE", "fsc")], "code string, carrier_class string")
    got = maintain.usable(d, classes).orderBy("price_krw").collect()
    assert [(r.price_krw, r.trip_type, r.carrier_class) for r in got] == [(5, "oneway", "mixed"), (100, "roundtrip", "fsc")]


def test_rates_that_do_not_fit(spark):
    got = spark.createDataFrame([(0.1234,), (-12.0,)], "r double").select(tables.sink_rate(F.col("r")).alias("r")).collect()
    assert [r.r and float(r.r) for r in got] == [0.123, None]


LIST_B = """<table><tr class="table_body notice"><td><a class="subject_link" href="/market/board/1020/read/1">공지</a></td></tr>
<tr class="table_body"><td><a class="subject_link" href="https://bbs.ruliweb.com/market/board/1020/read/77?x=1"><strong> 도쿄  왕복 </strong><span class="num_reply">(12)</span></a></td><td class="time">2026.04.18</td><td class="hit">1,234</td><td class="recomd">-</td></tr>
<tr class="table_body"><td><a class="subject_link" href="/market/board/1020/read/77">다시</a></td></tr><tr class="table_body"><td><a class="subject_link" href="/market/board/1020/read/78">오사카 <span class="num_reply">(3)</span></a></td><td class="time">09:05</td></tr></table>"""


def test_list_b(spark):
    got = boards.list_items(spark.createDataFrame([(1, LIST_B), (2, None)], "page int, html string"), "ruliweb", NOW).orderBy("pos").collect()
    assert [(r.source_id, r.title, r.posted_at, r.views, r.comments, r.recommends) for r in got] == [
        ("77", "도쿄 왕복", dt.datetime(2026, 4, 18), 1234, 12, None), ("78", "오사카", dt.datetime(2026, 4, 18, 9, 5), None, 3, None)]


def test_list_a_and_c(spark):
    a = """<table><tr class="baseList bbs"><td><a class="baseList-thumb" href="view.php?id=ppomppu4&no=9"></a><a href="view.php?id=ppomppu4&page=1&no=9"><em>[특가]</em> 괌</a></td><td><time>26/04/17</time></td></tr><tr class="baseList"><td><a href="/login.php">x</a></td></tr></table>"""
    got = boards.list_items(spark.createDataFrame([(a,)], "html string"), "ppomppu", NOW).collect()
    assert [(r.source_id, r.title, r.posted_at, r.source_url) for r in got] == [("9", "[특가] 괌", dt.datetime(2026, 4, 17), "https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu4&page=1&no=9")]
    c = """<script>var x = "<div class='list_item'>"</script><div class="list_item symph_row"><span class="list_subject" title="방콕 특가"><a data-role="list-title-text" href="/service/board/jirum/123?od=T31#c">x</a></span><span class="timestamp">2026-04-18 10:00:00</span></div><div class="list_item sold_out"><span class="list_subject"><a href="/service/board/jirum/5">y</a></span></div>"""
    got = boards.list_items(spark.createDataFrame([(c,)], "html string"), "clien", NOW).collect()
    assert [(r.source_id, r.title, r.posted_at, r.source_url) for r in got] == [("123", "방콕 특가", dt.datetime(2026, 4, 18, 1), "https://www.clien.net/service/board/jirum/123")]


def test_details_and_charset(spark):
    got = boards.detail_body(spark.createDataFrame([('<div class="board_main"></div><div id="quote"> a&nbsp; b\n c</div>',), (None,)], "html string"), "ppomppu").collect()
    assert [r.body for r in got] == ["a b c", ""]
    pages = spark.createDataFrame([(bytearray("서울".encode("euc-kr")), "text/html; charset=EUC-KR"), (bytearray("서울".encode()), None), (None, "x")], "content binary, content_type string")
    assert [r.html for r in markup.decode_pages(pages).collect()] == ["서울", "서울", None]


FEED = """<rss><item><title><![CDATA[도쿄 &amp;lt; 특가]]></title><link>https://www.playwings.co.kr/deals/abcdefghij1</link><pubDate>Sat, 18 Apr 2026 01:02:03 GMT</pubDate></item>
<item><title>again</title><link>/deals/abcdefghij1</link></item></rss><entry><title>둘</title><link rel="x" href="/deals/abcdefghij2?a=1"/><updated>2026-04-17T00:00:00Z</updated></entry>
<urlset><url><loc>https://www.playwings.co.kr/deals/abcdefghij3/</loc><lastmod>nonsense</lastmod></url><url><loc>https://other.example/deals/abcdefghij4</loc></url></urlset>"""


def test_feed(spark):
    from farewright.functions.dates import lit_time

    got = markup.feed_items(spark.createDataFrame([(FEED,)], "xml string"), lit_time(NOW)).orderBy("kind").collect()
    assert [(r.source_id, r.title, r.posted_at) for r in got] == [("abcdefghij1", "도쿄 < 특가", dt.datetime(2026, 4, 18, 1, 2, 3)), ("abcdefghij2", "둘", dt.datetime(2026, 4, 17)), ("abcdefghij3", "", NOW)]


def test_entities_and_meta(spark):
    x = spark.createDataFrame([("&amp;lt;&#44032;&#128293;&quot;",)], "t string").select(markup.decode_entities(F.col("t")).alias("t")).first().t
    assert x == '<가🔥"'
    title, body = markup.detail_meta(F.col("h"))
    got = spark.createDataFrame([('<meta content="제목" property="og:title"><meta name="description" content=" 설명 ">',)], "h string").select(title.alias("t"), body.alias("b")).first()
    assert (got.t, got.b) == ("제목", "설명")


@pytest.mark.parametrize("source, url, want", [
    ("ppomppu", "https://www.ppomppu.co.kr/zboard/view.php?id=1", True), ("ppomppu", "https://www.ppomppu.co.kr/my.php", False), ("ruliweb", "https://bbs.ruliweb.com/market/board/1020?view=x", False),
    ("ruliweb", "https://bbs.ruliweb.com/market/board/1020?page=2", True), ("clien", "https://www.clien.net/service/board/jirum/1", True), ("clien", "https://www.clien.net/service/board/jirumx", False), ("clien", "https://www.clien.net/service/board/jirum?po=1", False)])
def test_allowed(spark, source, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(boards.allowed_path(F.col("u"), source).alias("x")).first().x is want


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"origin":"PUS","destination":"KIX","carrierClass":"lcc","baselineKrw":123400,"p10Krw":101000,"p50Krw":123400,"p90Krw":177000,"confidence":"medium","sampledAt":"2025-02-03","source":"seed"}]')
    seed = tables.read_seed(spark, str(tmp_path / "s.json"))
    observed = seed.withColumn("source", F.lit("observed"))
    path = str(tmp_path / "market")
    tables.load_seed(seed.unionByName(observed), path)
    tables.load_seed(seed.withColumn("p50_krw", F.lit(1)), path)
    assert {r.source: r.p50_krw for r in spark.read.parquet(path).collect()} == {"seed": 1, "observed": 123400}


def test_snapshot_round_trip(spark):
    d = spark.createDataFrame([(i, True, "active", NOW + dt.timedelta(days=1), r) for i, r in enumerate((0.1, None, 0.3, 0.3, 0.2, 0.4))], "id int, hot_deal boolean, verification_status string, expires_at timestamp_ntz, discount_rate double")
    snap = maintain.daily_snapshot(d, NOW)
    assert snap.first().deal_ids == [5, 2, 3, 4, 0]
    assert [r.id for r in serve.snapshot_deals(snap, d.where("id <> 3")).orderBy("pos").collect()] == [5, 2, 4, 0]


def test_coverage(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, "b")], "title string, p int, c string")
    assert ops.parser_coverage(a, a.withColumn("p", F.lit(1)), ["p", "c"]).first().coverage == 0.5


def test_baselines_from_one_scan(spark):
    """route_baselines agrees with the resolver over separate tables, classes without a row included."""
    r = random.Random(5)
    first, last = NOW - dt.timedelta(days=300), NOW - dt.timedelta(days=200)
    rows = []
    for k, (o, d, c, n) in enumerate([("A", "B", "fsc", 40), ("A", "B", "mixed", 30), ("A", "C", "lcc", 14), ("B", "C", "fsc", 5), ("B", "C", "mixed", 3), ("C", "A", "lcc", 0)]):
        rows += [(o, d, c, r.randint(100, 900), NOW - dt.timedelta(days=r.randint(1, 29)), i % 4, 1000 * k + i) for i in range(n)]
        rows += [(o, d, c, r.randint(100, 900), first + dt.timedelta(days=r.randint(0, 99)), 1, 1000 * k + 500 + i) for i in range(4 * (k != 3))]
        rows += [(o, d, c, 5, NOW + dt.timedelta(days=1), 1, 1000 * k + 900)]
    obs = spark.createDataFrame(rows, "origin string, destination string, carrier_class string, price_krw int, observed_at timestamp_ntz, source_deal_id long, id long")
    seeded = F.col("origin") != "B"
    old = baseline.observed_quantiles(obs.where((F.col("observed_at") >= F.lit(first)) & (F.col("observed_at") < F.lit(last))), {"p10_krw": 0.1, "p50_krw": 0.5, "p90_krw": 0.9})
    seed = old.where(seeded).select(*baseline.KEY, *(round_quantile(F.col(p)).alias(p) for p in ("p10_krw", "p50_krw", "p90_krw")))
    keys = obs.select("origin", "destination").distinct().crossJoin(spark.createDataFrame([("fsc",), ("lcc",), ("mixed",)], "carrier_class string"))
    want = baseline.resolve_baseline(keys, obs, seed, NOW).select(*baseline.KEY, *baseline.RESOLVED).collect()
    got = baseline.route_baselines(obs, NOW, first, last, 30, seeded)
    assert sorted(map(repr, got.select(*baseline.KEY, *baseline.RESOLVED).collect())) == sorted(map(repr, want)) and len(want) == 12
    assert {x.level for x in want} == {1, 2, 3, 4, 5}
    newest = {tuple(x)[:3]: x.price_krw for x in baseline.latest_price(obs, NOW).collect()}
    assert {(x.origin, x.destination, x.carrier_class): x.price_krw for x in got.where("price_krw IS NOT NULL").collect()} == newest
    assert got.where("known").count() == 6
    assert baseline.route_baselines(obs.limit(0), NOW, first, last).count() == 0
