"""Labels, lines and keys made of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farewright.dims import AIRPORTS, CITY_NAMES
from farewright.functions.dates import kst_date
from farewright.functions.jsmath import round_half_up


def mapped(table: dict[str, str], key: Column) -> Column:
    """Lookup in a small fixed table; null if absent."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def format_krw(n: Column) -> Column:
    return F.concat(F.format_number(F.coalesce(round_half_up(n), F.lit(0)), 0), F.lit("원"))


def format_discount(rate: Column) -> Column:
    """0.52 gives -52%, a rise of price +N%."""
    pct = round_half_up(F.coalesce(rate, F.lit(0.0)) * 100)
    text = F.abs(pct).cast("string")
    return F.when(pct == 0, "0%").when(pct > 0, F.concat(F.lit("-"), text, F.lit("%"))).otherwise(F.concat(F.lit("+"), text, F.lit("%")))


def format_percentile(p: Column) -> Column:
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(p, F.lit(0.0))))
    return F.concat(F.lit("p"), round_half_up(clamped).cast("string"))


def rounded_pct(rate: Column) -> Column:
    return round_half_up(rate * 100)


def verdict(hot: Column, rate: Column) -> Column:
    """hot, good (30 percent or more) or null."""
    return F.when(hot, "hot").when(rounded_pct(rate) >= 30, "good")


def badge(hot: Column, rate: Column, source: Column) -> Column:
    """Null without a baseline or a positive discount, unless hot."""
    pct = rounded_pct(rate)
    text = (F.when(hot, F.concat(F.lit("🔥 저점 "), format_discount(rate))).when(pct >= 30, F.concat(F.lit("큰 폭 할인 "), format_discount(rate)))
            .when(pct > 0, format_discount(rate)))
    return F.when(source.isNotNull() & rate.isNotNull(), text)


def dot_label(cheapest: Column, p10: Column, p50: Column, observed: Column) -> Column:
    return (F.when(~observed | cheapest.isNull(), "데이터 수집 중").when(cheapest <= p10, "하위 10%").when(cheapest <= p50, "하위 50%").otherwise("평균 이상"))


def health_state(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "unknown").when(minutes <= 30, "ok").when(minutes <= 120, "late").otherwise("down")


def frequency_text(ordinal: Column, count30d: Column) -> Column:
    return (F.when(ordinal <= 0, F.lit(None).cast("string")).when(ordinal == 1, "이 노선 30일 내 첫 등장")
            .when(ordinal <= 4, F.concat(F.lit("이 노선 30일 "), ordinal.cast("string"), F.lit("번째")))
            .otherwise(F.concat(F.lit("자주 올라오는 노선 (30일 "), count30d.cast("string"), F.lit("회)"))))


def saved_status(present: Column, hot: Column, rate: Column) -> Column:
    pct = rounded_pct(rate)
    return (F.when(~present, "지금은 리스트에 없어요").when(hot, "🔥 저점 갱신")
            .when(pct >= 20, F.concat(pct.cast("string"), F.lit("% 할인 중"))).otherwise("현재 리스트에 있음"))


def clamp(text: Column, most: int = 60) -> Column:
    """The first code points; empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def source_label(sources: Column) -> Column:
    """Distinct names, three shown; how many more, and in how many places if at least two."""
    unique = F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))
    n = F.size(unique)
    more = F.when(n > 3, F.concat(F.lit(" (외 "), (n - 3).cast("string"), F.lit("곳)"))).otherwise("")
    places = F.when(n >= 2, F.concat(F.lit(" · "), n.cast("string"), F.lit("곳 동시 등장"))).otherwise("")
    return F.concat(F.array_join(F.slice(unique, 1, 3), " · "), more, places)


def city_name(code: Column) -> Column:
    return F.coalesce(mapped(CITY_NAMES, code), code, F.lit(""))


def representative(code: Column) -> Column:
    """The airport that stands for a city's others; an unknown code in upper case."""
    up = F.upper(code)
    return F.coalesce(mapped({k: v[2] for k, v in AIRPORTS.items()}, up), up)


def class_label(carrier_class: Column) -> Column:
    return F.when(carrier_class == "fsc", "FSC").when(carrier_class == "lcc", "LCC").otherwise("혼합")


def curation_line(rate: Column, percentile: Column, carrier_class: Column, source: Column, confidence: Column) -> Column:
    """The rule-made line about a price, 60 code points at most."""
    pct = rounded_pct(rate)
    against = (F.when(pct > 0, F.concat(F.lit("시장 평균 대비 -"), pct.cast("string"), F.lit("%")))
               .when(pct < 0, F.concat(F.lit("시장 평균 대비 +"), F.abs(pct).cast("string"), F.lit("%"))).otherwise("시장 평균 수준"))
    tail = F.concat(F.lit(" · "), class_label(carrier_class), F.lit(" 분위수"))
    low = F.concat(F.lit(" · 하위 p"), F.greatest(F.lit(0), round_half_up(percentile)).cast("string"))
    main = F.concat(against, F.when((percentile <= 10) & (pct > 0), low).otherwise(""), tail, F.when(confidence == "low", " (참고용)").otherwise(""))
    return clamp(F.when(source.isNull() | rate.isNull(), "시장 평균 정보 수집 중").otherwise(main))


def curation_text(override: Column, written: Column, rule: Column) -> Column:
    return F.coalesce(override, written, rule)


#: Fixed value: words that a curated line must not hold.
BANNED = "(?i)역대가|Amadeus|Anthropic|Claude|LLM|API"


def keeps_numbers(text: Column, allowed: Column) -> Column:
    """No banned word, and every percentage in the text is within 1 of an allowed one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,9})\s*%"), F.lit(1)), lambda x: x.cast("int"))
    return ~text.rlike(BANNED) & F.forall(found, lambda n: F.exists(allowed, lambda a: F.abs(n - a) <= 1))


def search_url(origin: Column, destination: Column, depart: Column, as_of: Column) -> Column:
    """depart null: seven Korean days from as_of."""
    day = F.coalesce(depart.cast("date"), F.date_add(kst_date(as_of), 7))
    return F.concat(F.lit("https://www.skyscanner.co.kr/transport/flights/"), F.upper(F.trim(origin)), F.lit("/"), F.upper(F.trim(destination)), F.lit("/"), F.date_format(day, "yyMMdd"), F.lit("/"))


def stay_duration(start: Column, stop: Column) -> Column:
    days = F.datediff(stop, start)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("박 "), (days + 1).cast("string"), F.lit("일")))


def dedupe_key(origin: Column, destination: Column, price: Column, month: Column, carrier_class: Column) -> Column:
    """SHA-1 of route, price down to the thousand, month and class."""
    bucket = (F.floor(F.greatest(F.lit(0), price) / 1000) * 1000).cast("bigint").cast("string")
    return F.sha1(F.concat_ws("|", F.upper(F.trim(origin)), F.upper(F.trim(destination)), bucket, month, carrier_class))


def representative_month(depart_from: Column, posted_at: Column) -> Column:
    return F.date_format(F.coalesce(depart_from.cast("timestamp_ntz"), posted_at), "yyyy-MM")
