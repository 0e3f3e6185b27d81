"""Functions without a query of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from farewright import dims
from farewright.functions import dates, parsing, text
from farewright.operators import filters, maintain, merge, ops, serve
from farewright.sources import boards, markup, tables
from farewright.streaming import ingest

NOW = dt.datetime(2026, 4, 18, 12)


def column(spark, values, kind, *made):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [tuple(r)[1:] if len(made) > 1 else r[1] for r in df.select("i", *made).orderBy("i").collect()]


@pytest.mark.parametrize("source", ["ppomppu", "ruliweb", "clien"])
def test_pages_nested_deeply(spark, source):
    deep = "<div>" * 100_000 + "inside"
    html = deep + '</div><div class="board-contents view_content post_content"><td class="board-contents">body</td></div>'
    pages = spark.createDataFrame([(1, html), (2, "</b>" * 100_000 + "<i>" * 50_000 + "</i>" * 50_000), (3, deep)], "id int, html string")
    assert [r.body for r in boards.detail_body(pages, source).orderBy("id").collect()] == ["body", "", ""]
    assert boards.list_items(pages, source, NOW).count() == 0


def test_sinks(spark, tmp_path):
    deals = spark.createDataFrame([(1, "ICN", "x"), (2, "GMP", None)], "id int, origin string, body string")
    assert tables.public_deals(deals).columns == ["id", "origin"]
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.append(deals, path)
    assert tables.row_count(spark.read.parquet(path)) == 4
    new = spark.createDataFrame([(2, "CJU", "y"), (3, "PUS", None)], deals.schema)
    assert sorted(tuple(r) for r in tables.upserted(deals, new, ["id"]).collect()) == [(1, "ICN", "x"), (2, "CJU", "y"), (3, "PUS", None)]
    assert [json.loads(r.json) for r in tables.as_json(deals).orderBy("json").collect()] == [{"id": 1, "origin": "ICN", "body": "x"}, {"id": 2, "origin": "GMP"}]
    sent = []
    assert tables.notify(deals, sent.append) == 2 and {d["id"] for d in sent} == {1, 2}
    run = tables.finished_run("a", NOW, NOW + dt.timedelta(minutes=1), deals, new.where("id = 3")).first()
    assert (run.source, run.processed_count, run.saved_count, run.success) == ("a", 2, 1, True)
    assert [r.id for r in maintain.delete_keys(deals, new, "id").collect()] == [1]


def test_regions(spark):
    region, places = next(iter(dims.REGIONS.items()))
    df = spark.createDataFrame([(p,) for p in [*places, "XXX", None]], "destination string")
    assert df.where(filters.in_region(F.col("destination"), region)).count() == len(places)
    assert df.where(filters.in_region(F.col("destination"), "all")).count() == len(places) + 2
    f = filters.parse_filters({"region": region})
    deals = df.select("destination", F.lit(1).alias("price_krw"))
    assert filters.common(deals, f, NOW).count() == len(places)


def test_known_sources_drop_others(spark):
    assert column(spark, [["ppomppu", "elsewhere", "clien"], ["x"]], "array<string>", filters.known_sources(F.col("x"))) == [["ppomppu", "clien"], []]


def test_incomplete(spark):
    d = spark.createDataFrame([("a", "b", 1), (None, "b", 1), ("a", None, 1), ("a", "b", None)], "origin string, destination string, price_krw int")
    assert d.where(maintain.incomplete()).count() == 3


def test_model_fields(spark):
    assert column(spark, [" a ", "", "  ", None], "string", parsing.clean_field(F.col("x"))) == ["a", None, None, None]
    assert column(spark, ["1,200", " 3.5 ", "x", None], "string", parsing.clean_number(F.col("x"))) == [1200.0, 3.5, None, None]
    assert column(spark, ["2026-04-18", "2026-13-01", "2026-4-1"], "string", parsing.clean_date(F.col("x"))) == [dt.date(2026, 4, 18), None, None]


def test_texts(spark):
    one = lambda *c: spark.range(1).select(text.curation_text(*(F.lit(x).cast("string") for x in c)).alias("t")).first().t
    assert (one("a", "b", "c"), one(None, "b", "c"), one(None, None, "c")) == ("a", "b", "c")
    dots = text.dot_label(F.col("x"), F.lit(100), F.lit(200), F.lit(True))
    assert column(spark, [100, 200, 201, None], "int", dots) == ["하위 10%", "하위 50%", "평균 이상", "데이터 수집 중"]
    assert column(spark, [1], "int", text.dot_label(F.col("x"), F.lit(100), F.lit(200), F.lit(False))) == ["데이터 수집 중"]


def test_expiry(spark):
    got = column(spark, [NOW], "timestamp_ntz", dates.expires_at(F.col("x")), dates.body_expires_at(F.col("x")))
    assert got == [(NOW + dt.timedelta(days=30), NOW + dt.timedelta(days=7))]
    rows = spark.createDataFrame([(NOW - dt.timedelta(seconds=1),), (NOW,), (None,)], "t timestamp_ntz")
    assert ingest.expired(rows, NOW, "t").count() == 1


def test_caps(spark):
    items = spark.createDataFrame([(s, i) for s in "ab" for i in range(60)], "source string, pos int")
    assert {(r.source, r["count"]) for r in merge.capped(items).groupBy("source").count().collect()} == {("a", 40), ("b", 40)}
    assert merge.capped(items).agg(F.max("pos")).first()[0] == 39
    usage = spark.createDataFrame([(dt.date(2026, 4, d),) for d in range(1, 20)], "date date")
    assert sorted(r.date.day for r in ops.usage_days(usage).collect()) == list(range(13, 20))


def test_signals(spark):
    d = spark.createDataFrame([("hot", None), ("trending", "hot"), (None, "trending"), (None, None)], "a string, b string")
    assert [r[0] for r in d.select(merge.max_signal(F.col("a"), F.col("b"))).collect()] == ["hot", "hot", "trending", None]


def test_list_for_programs(spark):
    d = spark.createDataFrame([(1, 10, dt.date(2020, 1, 1)), (2, 90_000, None)], "id int, price_krw int, depart_from date").withColumns(
        {"expires_at": dates.lit_time(NOW + dt.timedelta(days=1)), "verification_status": F.lit("active"), "posted_at": dates.lit_time(NOW), "destination": F.lit("NRT"), "discount_rate": F.lit(0.1)})
    assert [r.id for r in serve.deal_list(d, filters.Filters(), NOW).collect()] == [2]
    assert [r.id for r in serve.deal_list(d, filters.Filters(), NOW, ready_only=False).collect()] == [1, 2]


def test_anchor_items(spark):
    page = '<a href="/deals/abcdefghij1">one</a><a class="x" href="/deals/abcdefghij1/">again</a><a href="/about">no</a><a href="https://www.playwings.co.kr/deals/abcdefghij2?a=1">two</a>'
    got = markup.anchor_items(spark.createDataFrame([(page,), (None,)], "html string"), dates.lit_time(NOW)).orderBy("pos").collect()
    assert [(r.source_id, r.title, r.posted_at) for r in got] == [("abcdefghij1", "one", NOW), ("abcdefghij2", "two", NOW)]


def test_seasons(spark):
    got = dims.seasons(spark)
    assert got.count() == 12 and [r.month for r in got.where("best").orderBy("month").collect()] == [2, 11]


def test_observations_are_appended_once(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 6)], "id int, price int").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.observe(spark.readStream.schema("id int, price int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
