import datetime as dt

import pytest
from pyspark.sql import functions as F

from farewright.functions import dates, jsmath, parsing, scoring, text
from farewright.operators import filters


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("x, want", [(-2.5, -2), (2.5, 3), (-2.6, -3), (0.49, 0)])
def test_halves_go_up(spark, x, want):
    assert one(spark, jsmath.round_half_up(lit(x))) == want


@pytest.mark.parametrize("price, q, want", [(200, (100, 200, 400), 50), (100, (100, 200, 400), 10), (400, (100, 200, 400), 90), (200, (300, 200, 400), None), (50, (0, 0, 10), 100), (0, (0, 5, 9), 0), (800, (100, 200, 400), 100), (440, (100, 200, 400), 91)])
def test_percentile(spark, price, q, want):
    assert one(spark, scoring.estimate_percentile(lit(price), *map(lit, q))) == want


def test_blend(spark):
    assert one(spark, jsmath.blend(lit(205.0), lit(300.0))) == 243
    assert one(spark, jsmath.blend(lit(None).cast("double"), lit(300.0))) == 300


def test_month_window():
    assert dates.month_window("2026-05") == (dt.datetime(2026, 4, 30, 15), dt.datetime(2026, 5, 31, 15))
    assert dates.month_window("2026-12")[1] == dt.datetime(2026, 12, 31, 15)


def test_formats(spark):
    assert [one(spark, text.format_discount(lit(x))) for x in (0.52, 0.295, 0.294, -0.1, 0.0)] == ["-52%", "-30%", "-29%", "+10%", "0%"]
    assert one(spark, text.format_percentile(lit(7.5))) == "p8"
    assert one(spark, text.format_krw(lit(135000))) == "135,000원"
    assert one(spark, text.clamp(lit("🔥" * 70))) == "🔥" * 60


def test_dedupe_key(spark):
    key = lambda o, p, m="2026-05": one(spark, text.dedupe_key(lit(o), lit("NRT"), lit(p), lit(m), lit("fsc")))
    assert key("ICN", 29500) == key("icn ", 29999) != key("ICN", 30000)


TITLES = [
    ("[대한항공] 인천-도쿄 왕복 29만원부터", ("ICN", "NRT", "roundtrip", 290_000, "KE", "fsc")),
    ("제주항공 김포→오사카 편도 450,000원", ("GMP", "KIX", "oneway", 450_000, "7C", "lcc")),
    ("인천LAX왕복 1,350,000원", ("ICN", "LAX", "roundtrip", 1_350_000, None, "mixed")),
    ("ICN-HND 특가 12.5만", ("ICN", "NRT", "roundtrip", 125_000, None, "mixed")),
    ("하노이 호치민 비엣젯 99,000원 vs 130,000원", ("ICN", "SGN", "roundtrip", 99_000, "VJ", "lcc")),
    ("KE 직항 뉴욕 80만", ("ICN", "JFK", "roundtrip", 800_000, "KE", "fsc")),
    ("괌 호텔 패키지 50만원", (None, None, None, None, None, "mixed")),
    ("도쿄 12,5만", ("ICN", "NRT", "roundtrip", 1_250_000, None, "mixed")),
    ("다낭 3만원", ("ICN", "DAD", "roundtrip", None, None, "mixed")),
]


@pytest.mark.parametrize("title, want", TITLES)
def test_titles(spark, title, want):
    got = spark.createDataFrame([(title, dt.datetime(2026, 4, 18))], "t string, p timestamp_ntz").select(*(c.alias(n) for n, c in parsing.parse_rules(F.col("t"), lit(None).cast("string"), F.col("p")).items())).first()
    assert (got.origin, got.destination, got.trip_type, got.price_krw, got.carrier_code, got.carrier_class) == want


@pytest.mark.parametrize("title, want", [
    ("2026-05-01 ~ 05-10 출발", (dt.date(2026, 5, 1), dt.date(2026, 5, 10))), ("2026-05-03", (dt.date(2026, 5, 3), dt.date(2026, 5, 3))), ("2026-02", (dt.date(2026, 2, 1), dt.date(2026, 2, 28))),
    ("3~5월", (dt.date(2026, 3, 1), dt.date(2026, 5, 31))), ("1~2월", (dt.date(2027, 1, 1), dt.date(2027, 2, 28))), ("5월 출발", (dt.date(2026, 5, 1), dt.date(2026, 5, 31))),
    ("2026-02-31", (dt.date(2026, 3, 3), dt.date(2026, 3, 3))), ("언젠가", (None, None)), ("13월", (None, None))])
def test_departures(spark, title, want):
    assert tuple(one(spark, parsing.depart_range(lit(title), dates.lit_time(dt.datetime(2026, 4, 18))))) == want


def test_page_prices(spark):
    assert one(spark, parsing.page_prices(lit("특가 150,000원 5천원 99000 원 12천원"))) == [150_000, 99_000, 12_000]
    page = "가" * 6826 + " 150,000원"  # the price starts in the last bytes that are read, and is cut
    assert one(spark, parsing.verify_price(lit(page), lit(150_000))[1]) == "missing"
    assert one(spark, parsing.verify_price(lit("지금 160,000원"), lit(150_000))[1]) == "matched"


def test_number_fidelity(spark):
    ok = lambda t: one(spark, text.keeps_numbers(lit(t), F.array(lit(30), lit(8))))
    assert ok("평균보다 31% 저렴") and ok("좋은 가격") and not ok("40% 할인") and not ok("역대가 30%")


def test_filters():
    f = filters.parse_filters({"region": "JP", "maxPrice": "300000", "month": "2026-05", "minDiscount": "250", "since": "7d"})
    assert f == filters.Filters("JP", 300_000, "2026-05", 100, "7d")
    assert filters.parse_filters(filters.to_params(f)) == f
    assert filters.parse_filters({"region": "XX", "maxPrice": "abc", "month": "2026-13", "since": "1y"}) == filters.Filters()
    assert filters.parse_filters({"maxPrice": "99999999"}).max_price == 10_000_000
    sea = filters.presets(dt.date(2026, 8, 1))
    assert sea["summer"] == {"month": "2027-07"}
    on = filters.toggle_preset(filters.Filters(), sea["sea"])
    assert filters.preset_active(on, sea["sea"]) and filters.toggle_preset(on, sea["sea"]) == filters.Filters()
    assert filters.is_deal_id("0f8fad5b-d9cb-469f") and not filters.is_deal_id("x' or 1=1")
    assert filters.watch_errors("ICN", "nrt", 40_000, "2026-5", "jet") == ["destination", "max_price", "month", "carrier_class"]


def test_relative_time(spark):
    now = dates.lit_time(dt.datetime(2026, 4, 18, 12))
    ago = lambda **kw: one(spark, dates.relative_time(dates.lit_time(dt.datetime(2026, 4, 18, 12) - dt.timedelta(**kw)), now))
    assert [ago(seconds=59), ago(minutes=5), ago(hours=3), ago(hours=25), ago(days=9)] == ["방금 전", "5분 전", "3시간 전", "어제 20:00", "2026-04-09"]
