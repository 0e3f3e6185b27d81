"""What built-in expressions can take from HTML and XML: cleaning, metadata, anchors, feeds."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_URL = "https://www.playwings.co.kr"
BODY_CHARS = 500


def sanitize(html: Column) -> Column:
    """Without a byte order mark, scripts, styles, noscript, svg and comments."""
    out = F.regexp_replace(html, "^﻿", "")
    for tag in ("script", "style", "noscript", "svg"):
        out = F.regexp_replace(out, f"(?is)<{tag}.*?</{tag}>", "")
    return F.regexp_replace(out, "(?s)<!--.*?-->", "")


def decode_entities(text: Column) -> Column:
    """Named references in a fixed order, &amp; first (so &amp;lt; becomes <), then decimal ones."""
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")
    valid = F.filter(numbers, lambda n: (n.cast("int") > 0) & (n.cast("int") < 0x110000) & ~n.cast("int").between(0xD800, 0xDFFF))
    return F.aggregate(valid, text, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))


def _meta(html: Column, attr: str, name: str) -> Column:
    """content of <meta attr="name">, with its attributes in either order."""
    q = name.replace(".", r"\.")
    ahead = F.regexp_extract(html, rf'(?is)<meta[^>]*\b{attr}="{q}"[^>]*\bcontent="([^"]*)"', 1)
    behind = F.regexp_extract(html, rf'(?is)<meta[^>]*\bcontent="([^"]*)"[^>]*\b{attr}="{q}"', 1)
    return F.coalesce(F.nullif(F.trim(ahead), F.lit("")), F.nullif(F.trim(behind), F.lit("")))


def detail_meta(html: Column) -> tuple[Column, Column]:
    """(title, body): the first of the usual metadata, the title falling back on <title>."""
    names = lambda what: [("property", f"og:{what}"), ("name", f"og:{what}"), ("name", what), ("name", f"twitter:{what}")]
    title = F.coalesce(*(_meta(html, a, n) for a, n in names("title")), F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))
    body = F.coalesce(*(_meta(html, a, n) for a, n in names("description")), F.lit(""))
    return decode_entities(F.coalesce(title, F.lit(""))), F.substring(decode_entities(body), 1, BODY_CHARS)


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", ""), r"[\s ]+", " "))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without their HTML, with a row (pos, href, label) for each anchor that has a href."""
    keep = [c for c in pages.columns if c != html]
    tags = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    one = pages.select(*keep, F.posexplode(tags).alias("pos", "tag"))
    return one.select(*keep, "pos", F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1).alias("href"), plain(F.col("tag")).alias("label"))


def deal_id(href: Column) -> Column:
    """The id of a deal page's URL on the feed's host; else null."""
    return F.nullif(F.regexp_extract(href, rf"^(?:{BASE_URL.replace('.', '[.]')})?/deals/([A-Za-z0-9]{{10,40}})/?(?:[?#].*)?$", 1), F.lit(""))


def _first(items: DataFrame, keep: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keep, "source_id").orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def anchor_items(pages: DataFrame, as_of: Column, html: str = "html") -> DataFrame:
    """Deal links of a page, the first of each id."""
    keep = [c for c in pages.columns if c != html]
    found = anchors(pages, html).withColumn("source_id", deal_id(F.col("href"))).where("source_id IS NOT NULL")
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(BASE_URL), "href")).otherwise(F.col("href"))
    return _first(found, keep, ["pos"]).select(*keep, "pos", "source_id", url.alias("source_url"), F.col("label").alias("title"), as_of.alias("posted_at"))


def _time(text: Column) -> Column:
    t = F.trim(text)
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z"]
    return F.coalesce(*(F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, ", ""), F.lit(f)).cast("timestamp_ntz") for f in forms))


def feed_items(feeds: DataFrame, as_of: Column, xml: str = "xml") -> DataFrame:
    """Deals of RSS items, then Atom entries, then sitemap URLs; the first of each id. A missing or
    unreadable date is as_of; sitemap rows have an empty title."""
    keep = [c for c in feeds.columns if c != xml]
    kinds = [
        (r"(?s)<item.*?</item>", r"<link>([^<]+)</link>", r"(?s)<title>(?:<!\[CDATA\[(.*?)\]\]>|(.*?))</title>", r"<pubDate>([^<]+)</pubDate>"),
        (r"(?s)<entry.*?</entry>", r'<link[^>]*href="([^"]+)"', r"(?s)<title[^>]*>(?:<!\[CDATA\[(.*?)\]\]>|(.*?))</title>", r"<updated>([^<]+)</updated>"),
        (r"(?s)<url[\s>].*?</url>", r"<loc>([^<]+)</loc>", None, r"<lastmod>([^<]+)</lastmod>")]
    out = None
    for k, (block, link, title, when) in enumerate(kinds):
        one = feeds.select(*keep, F.posexplode(F.regexp_extract_all(xml, F.lit(block), F.lit(0))).alias("pos", "b"))
        label = F.lit("") if title is None else F.trim(decode_entities(F.concat(F.regexp_extract("b", title, 1), F.regexp_extract("b", title, 2))))
        href = decode_entities(F.trim(F.regexp_extract("b", link, 1)))
        one = one.select(*keep, F.lit(k).alias("kind"), "pos", href.alias("href"), label.alias("title"), F.coalesce(_time(F.regexp_extract("b", when, 1)), as_of).alias("posted_at"))
        out = one if out is None else out.unionByName(one)
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(BASE_URL), "href")).otherwise(F.col("href"))
    found = out.withColumn("source_id", deal_id(F.col("href"))).where("source_id IS NOT NULL").withColumn("source_url", url)
    return _first(found, keep, ["kind", "pos"]).select(*keep, "kind", "pos", "source_id", "source_url", "title", "posted_at")


def _bytes_as(body: pd.Series, charset: pd.Series, fallback: str) -> pd.Series:
    """Charset by charset; one that Python does not know is the fallback, and a fallback of that kind UTF-8."""
    out = pd.Series([None] * len(body), index=body.index, dtype=object)
    for name, rows in body[body.notna()].groupby(charset):
        for known in (name, fallback, "utf-8"):
            try:
                codecs.lookup(known)
            except LookupError:
                continue
            out[rows.index] = [bytes(b).decode(known, "replace") for b in rows]
            break
    return out


def decode_pages(pages: DataFrame, content: str = "content", header: str = "content_type", fallback: str = "utf-8", out: str = "html") -> DataFrame:
    """Bytes to text by the header's charset, else the fallback; bad bytes become U+FFFD. Valid UTF-8 and
    Latin-1 are decoded by Spark; only what is left goes through Python, as Arrow batches."""
    named = F.lower(F.trim(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset=([^;]+)", 1)))
    charset = F.when(named == "", fallback).otherwise(named)
    utf8 = charset.isin("utf-8", "utf8") & F.is_valid_utf8(F.col(content).cast("string"))
    latin = charset.isin("iso-8859-1", "latin-1", "latin1")
    plain = F.coalesce(utf8 | latin, F.lit(False))
    other = F.pandas_udf(lambda body, name: _bytes_as(body, name, fallback), "string")
    rest = other(F.when(~plain, F.col(content)), charset)
    easy = F.when(utf8, F.col(content).cast("string")).when(latin, F.decode(content, "ISO-8859-1"))
    return pages.withColumn(out, F.coalesce(easy, rest)).drop(content)
