"""Fares from the titles and first lines of posts: price, trip, route, departure, carrier.

Java's word boundary takes Hangul for letters, so boundaries are stated as ASCII look-arounds.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.dims import AIRLINE_SHORT_NAMES, AIRLINES, AIRPORTS, DESTINATION_NAMES, ORIGIN_NAMES
from farewright.functions.text import mapped, representative

LEAST_KRW, MOST_KRW = 50_000, 50_000_000
BODY_CHARS = 500
#: Names of a dictionary that are tried one by one; larger dictionaries are looked up by hash.
FEW = 256
#: Fixed value: words of offers that are no fares.
EXCLUDED = ["패키지", "호텔", "숙박", "3박", "4박", "5박", "2박"]
_START, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once: the optimizer writes a plain column out wherever it
    is named, a variable of an array function is bound."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def prices(text: Column) -> Column:
    """All candidate prices, as longs: N만 (in ten thousands), N원 or N KRW, and bare grouped digits."""
    man = F.transform(_all(text, r"(\d{1,3}(?:[.,]\d{1,2})?)\s*만"), lambda x: F.floor(_number(x) * 10000 + 0.5))
    won = F.transform(_all(text, r"(\d{1,3}(?:,\d{3})+|\d{4,8})\s*(?:원|KRW|krw)"), lambda x: F.floor(_number(x)))
    bare = F.filter(F.transform(_all(text, r"(\d{1,3}(?:,\d{3}){1,2})" + _END), lambda x: F.floor(_number(x))), lambda n: n >= 10000)
    return F.concat(man, won, bare)


def parse_price(text: Column) -> Column:
    """The least candidate within the limits."""
    return F.array_min(F.filter(prices(text), lambda n: n.between(LEAST_KRW, MOST_KRW))).cast("int")


def parse_trip_type(text: Column) -> Column:
    return F.when(text.contains("편도"), "oneway").otherwise("roundtrip")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _day(y: Column, m: Column, d: Column) -> Column:
    """A day past the month's end runs over into the next month."""
    return F.date_add(F.make_date(y, m, F.lit(1)), F.least(F.greatest(d, F.lit(1)), F.lit(31)) - 1)


def depart_range(text: Column, posted_at: Column) -> Column:
    """struct(depart_from, depart_to): an ISO range, an ISO day or month, months m~n월, or one month;
    of those without a year, months that have passed are next year's."""
    iso = r"(\d{4})-(\d{2})-(\d{2})\s*[~-]\s*(\d{2})-(\d{2})"
    one = r"(\d{4})-(\d{2})(?:-(\d{2}))?"
    span = r"(\d{1,2})\s*[~\-–]\s*(\d{1,2})\s*월"
    single = r"(\d{1,2})\s*월"
    num = lambda pattern, i, name: _group(text, pattern, i).try_cast("int").alias(name)
    good = lambda m: m.between(1, 12)
    safe = lambda m: F.when(good(m), m).otherwise(1)
    pair = lambda a, b: F.struct(a.alias("depart_from"), b.alias("depart_to"))
    coming = lambda m: F.when(m < F.month(posted_at), F.year(posted_at) + 1).otherwise(F.year(posted_at))
    months = lambda a, b: _let(coming(b), lambda y: pair(F.make_date(y, safe(a), F.lit(1)), F.last_day(F.make_date(y, safe(b), F.lit(1)))))
    year = lambda y: F.coalesce(y, F.lit(2000))

    def days(x: Column) -> Column:
        return F.when(good(x.m1) & good(x.m2), pair(_day(year(x.y), safe(x.m1), x.d1), _day(year(x.y), safe(x.m2), x.d2)))

    def day(x: Column) -> Column:
        first = _day(year(x.y), safe(x.m), F.coalesce(x.d, F.lit(1)))
        return F.when(good(x.m), _let(first, lambda f: pair(f, F.when(x.d.isNotNull(), f).otherwise(F.last_day(f)))))

    dated = F.coalesce(
        _let(F.struct(num(iso, 1, "y"), num(iso, 2, "m1"), num(iso, 3, "d1"), num(iso, 4, "m2"), num(iso, 5, "d2")), days),
        _let(F.struct(num(one, 1, "y"), num(one, 2, "m"), num(one, 3, "d")), day))
    monthly = F.coalesce(
        _let(F.struct(num(span, 1, "a"), num(span, 2, "b")), lambda x: F.when(good(x.a) & good(x.b) & (x.a <= x.b), months(x.a, x.b))),
        _let(num(single, 1, "m"), lambda m: F.when(good(m), months(m, m))))
    nothing = pair(F.lit(None).cast("date"), F.lit(None).cast("date"))
    return F.coalesce(F.when(text.rlike(r"\d{4}-\d{2}"), dated), F.when(text.contains("월"), monthly), nothing)


def _haystack(text: Column) -> Column:
    """The text, and its runs of letters in upper case between blanks."""
    runs = F.concat(F.lit("\n "), F.upper(F.regexp_replace(text, "[^A-Za-z]+", " ")), F.lit(" "))
    return F.concat(text, F.when(text.rlike("[A-Za-z]{2}"), runs).otherwise(""))


def _is_token(name: str) -> bool:
    return name.isascii() and name.isalpha()


def _one_by_one(text: Column, ordered: list[str], tokens: bool) -> Column:
    keys = F.array(*(F.lit(f" {n.upper()} " if tokens and _is_token(n) else n) for n in ordered))
    found = lambda hay: F.trim(F.get(F.filter(keys, lambda k: F.contains(hay, k)), F.lit(0)))
    return _let(_haystack(text), found) if tokens else found(text)


def _by_hash(text: Column, ordered: list[str], tokens: bool) -> Column:
    """What a text can name, its runs of letters and its pieces of the names' lengths, is looked up in a
    table of the names by their crc32; the table's size adds nothing to what a text costs."""
    shown = [n.upper() if tokens and _is_token(n) else n for n in ordered]

    def ranks(token: bool) -> Callable[[Column], Column]:
        """The place of a piece among the names (or the tokens); null if it is none."""
        known = {shown[i]: i for i in reversed(range(len(ordered))) if (tokens and _is_token(ordered[i])) == token}
        size = 2 * len(known) + 1
        buckets: list[dict[str, int]] = [{} for _ in range(size)]
        for name, rank in known.items():
            buckets[zlib.crc32(name.encode()) % size][name] = rank
        table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        return lambda piece: F.element_at(F.get(table, F.pmod(F.crc32(piece), F.lit(size)).cast("int")), piece)

    lengths = sorted({len(n) for n in ordered if not (tokens and _is_token(n))})

    def best(t: Column) -> Column:
        of = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))
        none = F.array().cast("array<string>")
        pieces = F.concat(none, *(F.coalesce(of(n), none) for n in lengths))
        runs = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0)), F.upper) if tokens else none
        return F.least(F.array_min(F.transform(pieces, ranks(False))), F.array_min(F.transform(runs, ranks(True))))

    return _let(text, lambda t: F.get(F.from_json(F.lit(json.dumps(shown)), "array<string>"), best(t)))


def first_name(text: Column, names: list[str], tokens: bool = True, few: int = FEW) -> Column:
    """The first of names (longest first, then as listed) that the text has; null if none.

    tokens: ASCII names need no letter on either side, in any case, and are given in upper case; all others
    are plain substrings. A dictionary of more than a few names is looked up by hash."""
    ordered = sorted(names, key=len, reverse=True)
    return (_one_by_one if len(ordered) <= few else _by_hash)(text, ordered, tokens)


def _resolve(raw: Column, names: dict[str, str], destination: bool) -> Column:
    known = lambda up: F.when(up.isin(list(AIRPORTS)), up)
    code = _let(F.trim(raw), lambda t: F.coalesce(mapped(names, t), mapped(names, F.upper(t)), known(F.upper(t))))
    return _let(code, representative if destination else lambda c: F.when(c == "GMP", "GMP").otherwise(representative(c)))


def normalize_route(origin: Column, destination: Column) -> tuple[Column, Column]:
    return _resolve(origin, ORIGIN_NAMES, False), _resolve(destination, DESTINATION_NAMES, True)


def parse_route(text: Column) -> tuple[Column, Column]:
    """Names first, then AAA-BBB, then a lone known code; the origin is ICN if nothing says so."""
    arrow = r"\s*[-–>→=]\s*"
    left = _group(text, f"{_START}([A-Z]{{3}}){arrow}[A-Z]{{3}}{_END}", 1)
    right = _group(text, f"{_START}[A-Z]{{3}}{arrow}([A-Z]{{3}}){_END}", 1)
    lone = F.get(F.filter(_all(text, f"{_START}([A-Z]{{3}}){_END}"), lambda c: c.isin([a for a in AIRPORTS if a not in ("ICN", "GMP")])), F.lit(0))
    return normalize_route(F.coalesce(first_name(text, list(ORIGIN_NAMES)), left, F.lit("ICN")), F.coalesce(first_name(text, list(DESTINATION_NAMES)), right, lone))


def parse_carrier(text: Column) -> Column:
    """Code of the first full name (longest first), then short name, then code in the text."""
    by_name = lambda names: mapped(names, first_name(text, list(names), tokens=False))
    lone = F.get(F.filter(_all(text, f"{_START}([A-Z0-9]{{2,3}}){_END}"), lambda c: c.isin(list(AIRLINES))), F.lit(0))
    return F.coalesce(by_name({v[0]: k for k, v in AIRLINES.items()}), by_name(AIRLINE_SHORT_NAMES), lone)


def class_of(code: Column) -> Column:
    return F.coalesce(mapped({k: v[1] for k, v in AIRLINES.items()}, F.upper(F.trim(code))), F.lit("mixed"))


def _draft(title: Column, body: Column, posted_at: Column) -> Column:
    """A struct of what a text says; null for a text with an excluded word."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, BODY_CHARS))

    def fields(t: Column) -> Column:
        origin, destination = parse_route(t)
        return F.struct(
            origin.alias("origin"), destination.alias("destination"), parse_trip_type(t).alias("trip_type"), parse_price(t).alias("price_krw"), parse_carrier(t).alias("carrier_code"),
            depart_range(t, posted_at).alias("depart"))

    out = lambda t: reduce(lambda a, b: a | b, (t.contains(w) for w in EXCLUDED))
    return _let(text, lambda t: F.when(~out(t), fields(t)))


def _fields(draft: Column) -> dict[str, Column]:
    return {
        **{name: draft[name] for name in ("origin", "destination", "trip_type", "price_krw", "carrier_code")}, "carrier_class": class_of(draft["carrier_code"]),
        "depart_from": draft["depart"]["depart_from"], "depart_to": draft["depart"]["depart_to"]}


def parse_rules(title: Column, body: Column, posted_at: Column) -> dict[str, Column]:
    """All fields of a draft. A text with an excluded word has none, and class mixed."""
    return _fields(_draft(title, body, posted_at))


def with_rules(posts: DataFrame, title: Column, body: Column, posted_at: Column) -> DataFrame:
    """posts with all fields of parse_rules; the draft is made in a projection of its own, so that it
    is planned and computed once, not for each field."""
    return posts.select("*", _draft(title, body, posted_at).alias("_draft")).withColumns(_fields(F.col("_draft"))).drop("_draft")


def page_prices(body: Column) -> Column:
    """Prices that a page shows: grouped digits, five to seven digits and 원, N천원."""
    longs = lambda p, k: F.transform(_all(body, p), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint") * k)
    found = F.concat(longs(r"(\d{1,3}(?:,\d{3})+)", 1), longs(r"(?<!\d)(\d{5,7})\s*원", 1), longs(r"(?<!\d)(\d{1,4})\s*천원", 1000))
    return F.filter(found, lambda n: n.between(10_000, 10_000_000))


def verify_price(page: Column, expected: Column, most_bytes: int = 20_480) -> tuple[Column, Column]:
    """(status, signal) from the first bytes of a page: a price within a tenth of the expected one is
    a match; other prices are a drift; none says nothing."""
    cut = F.substring(page.cast("binary"), 1, most_bytes)
    body = F.make_valid_utf8(cut.cast("string"))
    found = page_prices(body)
    hit = F.exists(found, lambda n: n.between(expected * 0.9, expected * 1.1))
    return (F.when(hit, "active").when(F.size(found) > 0, "price_changed").otherwise("active"),
            F.when(hit, "matched").when(F.size(found) > 0, "drifted").otherwise("missing"))


def loose_int(text: Column) -> Column:
    n = F.regexp_replace(text, r"[,\s]", "").try_cast("int")
    return F.when(n >= 0, n)


def comment_count(text: Column) -> Column:
    return _group(text, r"\((\d+)\)", 1).try_cast("int")


def clean_field(text: Column) -> Column:
    """A model's text field: trimmed, null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def clean_number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def clean_date(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(text).try_cast("date"))
