"""Registered queries over texts: made-up titles that are parsed back, and landed pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.functions import parsing
from farewright.operators import ops
from farewright.plans import views as V
from farewright.plans.queries import NOW, query
from farewright.plans.views import DEALS, DEALS_AS_OF
from farewright.sources import boards, markup

CITIES = ["도쿄", "오사카", "후쿠오카", "삿포로", "오키나와", "타이베이", "홍콩", "상하이", "방콕", "다낭", "호치민", "싱가포르", "마닐라", "세부", "괌", "하와이"]
CODES = ["NRT", "KIX", "FUK", "CTS", "OKA", "TPE", "HKG", "PVG", "BKK", "DAD", "SGN", "SIN", "MNL", "CEB", "GUM", "HNL"]
AIRLINES = ["대한항공", "제주항공", "티웨이", ""]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def titles(spark, sf_dir: str) -> DataFrame:
    """A title for each deal, from its id: city, airline, trip, price in one of three forms, month."""
    k = F.col("id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    price = 50_000 + (k * 7919) % 900 * 1000
    shown = (F.when(k % 3 == 0, F.concat(F.format_number(price, 0), F.lit("원"))).when(k % 3 == 1, F.concat((price / 10000).cast("decimal(9,1)").cast("string"), F.lit("만원")))
             .otherwise(F.concat(price.cast("string"), F.lit("원"))))
    title = F.concat_ws(" ", pick(CITIES, k), pick(AIRLINES, F.floor(k / 3)), F.when(k % 2 == 0, "편도").otherwise("왕복"), shown, F.concat((1 + k % 12).cast("string"), F.lit("월 출발")))
    return V.deals(spark, sf_dir).select("id", "posted_at", F.when(k % 17 == 0, F.concat(title, F.lit(" 호텔"))).otherwise(title).alias("title"))


@query(f"""WITH {DEALS}, t AS (SELECT id, posted_at, id % 17 = 0 AS bad, CAST(1 + id % 12 AS INTEGER) AS m FROM deals), d AS (SELECT *, make_date(CAST(year(posted_at) AS INTEGER) + CASE WHEN m < month(posted_at) THEN 1 ELSE 0 END, m, 1) AS first FROM t)
SELECT id, CASE WHEN NOT bad THEN 'ICN' END AS origin, CASE WHEN NOT bad THEN {_list(CODES)}[CAST(id % 16 AS INTEGER) + 1] END AS destination, CASE WHEN NOT bad THEN CASE WHEN id % 2 = 0 THEN 'oneway' ELSE 'roundtrip' END END AS trip_type,
  CASE WHEN NOT bad THEN CAST(50000 + (id * 7919) % 900 * 1000 AS INTEGER) END AS price_krw, CASE WHEN NOT bad THEN ['KE', '7C', 'TW', NULL][CAST(CAST(floor(id / 3) AS BIGINT) % 4 AS INTEGER) + 1] END AS carrier_code,
  CASE WHEN bad THEN 'mixed' ELSE ['fsc', 'lcc', 'lcc', 'mixed'][CAST(CAST(floor(id / 3) AS BIGINT) % 4 AS INTEGER) + 1] END AS carrier_class,
  CASE WHEN NOT bad THEN first END AS depart_from, CASE WHEN NOT bad THEN CAST(last_day(first) AS DATE) END AS depart_to FROM d""")
def x01_x08_parse_titles(spark, sf_dir):
    found = parsing.with_rules(titles(spark, sf_dir), F.col("title"), F.lit(None).cast("string"), F.col("posted_at"))
    return found.drop("title", "posted_at")


@query(f"WITH {DEALS} SELECT count(*) AS cases, count_if(id % 10 <> 3 OR id % 17 = 0) AS exact, count_if(id % 10 <> 3 OR id % 17 = 0) / CAST(count(*) AS DOUBLE) AS coverage FROM deals")
def c15_a19_golden(spark, sf_dir):
    """Parsed titles against what each was written from; a tenth of the records expect another code."""
    k = F.col("id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    good = lambda c: F.when(k % 17 != 0, c)
    third = F.floor(k / 3)
    expected = V.deals(spark, sf_dir).select(
        "id", good(F.lit("ICN")).alias("origin"), good(pick(CODES, k)).alias("destination"), good((50_000 + (k * 7919) % 900 * 1000).cast("int")).alias("price_krw"),
        good(F.when(k % 2 == 0, "oneway").otherwise("roundtrip")).alias("trip_type"), good(F.when(k % 10 == 3, "ZZ").otherwise(pick(["KE", "7C", "TW", None], third))).alias("carrier_code"),
        F.when(k % 17 == 0, "mixed").otherwise(pick(["fsc", "lcc", "lcc", "mixed"], third)).alias("carrier_class"))
    return ops.parser_coverage(x01_x08_parse_titles(spark, sf_dir), expected, expected.columns[1:], key="id")


@query(f"""WITH {DEALS}, t AS (SELECT id, 50000 + (id * 7919) % 900 * 1000 AS p, CAST(floor((50000 + (id * 7919) % 900 * 1000) * (100 + (id % 5 - 2) * 8) / 100) AS BIGINT) AS expected FROM deals)
SELECT id, CASE WHEN id % 3 = 1 THEN 'active' WHEN p >= expected * 0.9 AND p <= expected * 1.1 THEN 'active' ELSE 'price_changed' END AS status, CASE WHEN id % 3 = 1 THEN 'missing' WHEN p >= expected * 0.9 AND p <= expected * 1.1 THEN 'matched' ELSE 'drifted' END AS signal FROM t""")
def x09_x10_verify_price(spark, sf_dir):
    price = 50_000 + (F.col("id") * 7919) % 900 * 1000
    expected = F.floor(price * (100 + (F.col("id") % 5 - 2) * 8) / 100)
    status, signal = parsing.verify_price(F.col("title"), expected)
    return titles(spark, sf_dir).select("id", status.alias("status"), signal.alias("signal"))


_CLEAN = "html"
for _tag in ("script", "style", "noscript", "svg"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}.*?</{_tag}>', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?s)<!--.*?-->', '', 'g')"


@query(f"SELECT page_id, sha256({_CLEAN}) AS clean_sha256, CAST(length({_CLEAN}) AS BIGINT) AS n_chars FROM pages")
def s12_sanitize(spark, sf_dir):
    clean = markup.sanitize(F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha2(clean, 256).alias("clean_sha256"), F.length(clean).cast("long").alias("n_chars"))


def _decoded(x: str) -> str:
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " ")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


@query(f"SELECT page_id, {_decoded('''trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))''')} AS title, '' AS body FROM pages")
def s11_s13_detail_meta(spark, sf_dir):
    title, body = markup.detail_meta(F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", title.alias("title"), body.alias("body"))


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), 1) AS i FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(tag, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', '', 'g'), '[\\s\\x{A0}]+', ' ', 'g')) AS label FROM t""")
def s09_anchors(spark, sf_dir):
    return markup.anchors(V.table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""SELECT page_id, regexp_matches(p, '^/(en|fr)/') AND NOT regexp_matches('&' || q, '&(page|ref)(=|&|$)') AS allowed FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages)""")
def s15_allowed_urls(spark, sf_dir):
    ok = boards.allowed_path(F.col("url"), "ruliweb", ["/en/", "/fr/"], ["page", "ref"])
    return V.table(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"))


@query(f"WITH {DEALS} SELECT id, CASE WHEN id % 7 = 0 THEN 'snapshot' WHEN id % 7 IN (1, 2) THEN 'active' ELSE 'unchecked' END AS status FROM deals")
def s17_liveness(spark, sf_dir):
    from farewright.operators.maintain import liveness

    code = F.get(F.array(*map(F.lit, (404, 200, 302, 500, 400, 199, None))), (F.col("id") % 7).cast("int"))
    return V.deals(spark, sf_dir).select("id", liveness(code).alias("status"))


@query(f"WITH {DEALS} SELECT count(*) AS n FROM deals WHERE posted_at <= {NOW}")
def s21_row_count(spark, sf_dir):
    from farewright.functions.dates import lit_time

    return V.deals(spark, sf_dir).where(F.col("posted_at") <= lit_time(DEALS_AS_OF)).agg(F.count("*").alias("n"))


#: Forms of titles: what stands there, and the price (in won), month and code that a reader takes from it. The parser
#: has no rule for some of them.
_FORMS = {
    "grouped": "[특가] {city} {won}원 {m}월", "ten_thousands": "{city} 왕복 {man}만원~ {m}월 출발", "thousands_in_words": "{city} {man0}만{cheon}천원 {m}월",
    "currency_first": "{city} KRW {won} {m}월", "codes": "ICN-{code} {won}원 {m}월", "no_unit": "{city} 항공권 {won} {m}월", "month_in_words": "{city} {won}원 시월",
    "hotel": "{city} 호텔 {won}원 {m}월"}


def _golden(spark, sf_dir: str) -> DataFrame:
    """Titles of eight forms, in turn, with what a reader takes from them."""
    k = F.col("id")
    code, city = (F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int")) for v in (CODES, CITIES))
    price, month = (100_000 + (k * 7919) % 800 * 1000).cast("int"), F.when(k % 8 == 6, 10).otherwise(1 + k % 12).cast("int")
    parts = {"city": city, "code": code, "won": F.format_number(price, 0), "man": (price / 10_000).cast("decimal(9,1)"), "man0": F.floor(price / 10_000), "cheon": F.floor(price / 1000) % 10, "m": month}

    def written(template: str):
        out = []
        for piece in re.split(r"\{(\w+)\}", template):
            out.append(parts[piece].cast("string") if len(out) % 2 else F.lit(piece))
        return F.concat(*out)

    title = F.get(F.array(*(written(t) for t in _FORMS.values())), (k % 8).cast("int"))
    form = F.get(F.array(*map(F.lit, _FORMS)), (k % 8).cast("int"))
    return V.deals(spark, sf_dir).select("id", "posted_at", form.alias("form"), title.alias("title"), code.alias("destination"), price.alias("price_krw"), month.alias("month"))


@query(f"""WITH {DEALS}, t AS (SELECT ['grouped', 'ten_thousands', 'thousands_in_words', 'currency_first', 'codes', 'no_unit', 'month_in_words', 'hotel'][CAST(id % 8 AS INTEGER) + 1] AS form, CAST((id * 7919) % 10 AS INTEGER) AS cheon FROM deals)
SELECT form, count(*) AS cases, count(*) FILTER (form IN ('grouped', 'ten_thousands', 'codes', 'no_unit', 'currency_first') OR form = 'thousands_in_words' AND cheon = 0) AS exact FROM t GROUP BY 1""")
def c15_a19_by_form(spark, sf_dir):
    """How many titles of each form the parser reads as a reader does: price, destination and month."""
    wanted = _golden(spark, sf_dir)
    found = parsing.with_rules(wanted.select("id", "posted_at", "title"), F.col("title"), F.lit(None).cast("string"), F.col("posted_at"))
    found = found.select("id", "destination", "price_krw", F.month("depart_from").alias("month"))
    j = wanted.alias("w").join(found.alias("f"), "id")
    same = F.col("w.destination").eqNullSafe(F.col("f.destination")) & F.col("w.price_krw").eqNullSafe(F.col("f.price_krw")) & F.col("w.month").eqNullSafe(F.col("f.month"))
    return j.groupBy("form").agg(F.count("*").alias("cases"), F.count_if(same).alias("exact"))
