"""Registered queries over pages of boards and feeds, written from the deals: lists, details, feeds, charsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.functions import dates
from farewright.plans import views as V
from farewright.plans.queries import AS_OF, NOW, query
from farewright.plans.views import DEALS
from farewright.sources import boards, markup

#: Deals of a page.
PAGE = 40


def _say(template: str, **columns: Column | str) -> Column:
    """A text with columns (or those so named) in the places of {names}; null columns are empty."""
    out, rest = [], template
    for name, column in columns.items():
        head, _, rest = rest.partition("{" + name + "}")
        out += [F.lit(head), F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def _pages(spark, sf_dir, row: Column, head: str, tail: str) -> DataFrame:
    """(page, html): the rows of PAGE deals each, by id. Dealt by page before rows are made, to so many tasks: by
    their bytes, which are few beside the work of reading a page, all could go to one."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    d = V.deals(spark, sf_dir).select("id", "posted_at", "destination", F.floor(F.col("id") / PAGE).alias("page")).repartition(tasks, "page").withColumn("row", row)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "row"))), lambda r: r["row"])
    return d.groupBy("page").agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit(tail)).alias("html"))


def _listed(spark, sf_dir, source: str, row: Column, head: str, tail: str) -> DataFrame:
    got = boards.list_items(_pages(spark, sf_dir, row, head, tail), source, AS_OF)
    return got.select("page", F.col("source_id").cast("long").alias("id"), "source_url", "title", "posted_at", "views", "comments", "recommends")


TITLE = "destination || ' <' || id || '> & more'"


@query(f"""WITH {DEALS} SELECT CAST(floor(id / {PAGE}) AS BIGINT) AS page, id, 'https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu4&page=1&no=' || id AS source_url, '[특가] ' || {TITLE} AS title,
  CASE id % 3 WHEN 0 THEN CAST({NOW} AS DATE) + INTERVAL 9 HOUR + INTERVAL 5 MINUTE WHEN 1 THEN date_trunc('day', posted_at) + CASE WHEN year(posted_at) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END ELSE {NOW} END AS posted_at, CAST(NULL AS INTEGER) AS views, CAST(NULL AS INTEGER) AS comments, CAST(NULL AS INTEGER) AS recommends
FROM deals WHERE id % 11 <> 0""")
def s05_list_a(spark, sf_dir):
    """Lists of board A: thumbnails come first, some rows lead elsewhere, some posts are there twice; years have two
    digits, of this century."""
    link = _say('<a class="baseList-thumb" href="view.php?id=ppomppu4&no={a}"><img src="x"></a><a href="view.php?id=ppomppu4&amp;page=1&amp;no={b}"><em>[특가]</em>\n {c} &lt;{d}&gt; &amp; more</a>', a="id", b="id", c=F.col("destination"), d="id")
    link = F.when(F.col("id") % 11 == 0, _say('<a href="/login.php?no={a}">x</a>', a="id")).otherwise(link)
    time = F.when(F.col("id") % 3 == 0, "<td><time>9:05</time>").when(F.col("id") % 3 == 1, _say('<td class="list_time">{t}</td>', t=F.date_format("posted_at", "yy/MM/dd"))).otherwise("<td>")
    row = _say('<tr class="baseList bbs{k}"><td>{link}</td>{time}</tr>', k=F.col("id") % 2, link=link, time=time)
    row = F.concat(row, F.when(F.col("id") % 13 == 0, F.regexp_replace(row, "특가", "again")).otherwise(""))
    return _listed(spark, sf_dir, "ppomppu", row, "<table><tr class='head'><td>no</td></tr>", "</table>")


@query(f"""WITH {DEALS} SELECT CAST(floor(id / {PAGE}) AS BIGINT) AS page, id, 'https://bbs.ruliweb.com/market/board/1020/read/' || id || '?p=1' AS source_url, {TITLE} AS title,
  CASE id % 3 WHEN 0 THEN CAST({NOW} AS DATE) + INTERVAL 9 HOUR + INTERVAL 5 MINUTE WHEN 1 THEN date_trunc('minute', posted_at) ELSE {NOW} END AS posted_at, CAST(id % 5000 AS INTEGER) AS views, CAST(CASE WHEN id % 2 = 0 THEN id % 7 END AS INTEGER) AS comments, CAST(CASE WHEN id % 4 <> 0 THEN id % 50 END AS INTEGER) AS recommends
FROM deals WHERE id % 11 <> 0""")
def s06_list_b(spark, sf_dir):
    """Lists of board B: notices, titles in bold or beside their number of replies, counts with commas or dashes."""
    reply = F.when(F.col("id") % 2 == 0, _say('<span class="num_reply">({n})</span>', n=F.col("id") % 7)).otherwise("")
    title = _say("{c} &lt;{d}&gt;\n &amp; more", c=F.col("destination"), d="id")
    title = F.when(F.col("id") % 5 == 0, F.concat(F.lit("<strong> "), title, F.lit(" </strong>"))).otherwise(title)
    time = F.when(F.col("id") % 3 == 0, "09:05").when(F.col("id") % 3 == 1, F.date_format("posted_at", "yyyy.MM.dd HH:mm")).otherwise("soon")
    row = _say(
        '<tr class="table_body{n}"><td><a class="deco subject_link" href="/market/board/1020/read/{i}?p=1">{t} {r}</a><td class="hit">{v}</td><td class="recomd">{u}</td><td class="time">{w}</td></tr>',
        n=F.when(F.col("id") % 11 == 0, " Notice"), i="id", t=title, r=reply, v=F.format_number(F.col("id") % 5000, 0), u=F.when(F.col("id") % 4 != 0, F.col("id") % 50).otherwise(F.lit(None)), w=time)
    return _listed(spark, sf_dir, "ruliweb", row, "<script>var a = '<tr>'</script><table>", "")


@query(f"""WITH {DEALS} SELECT CAST(floor(id / {PAGE}) AS BIGINT) AS page, id, 'https://www.clien.net/service/board/jirum/' || id AS source_url, {TITLE} AS title,
  CASE id % 3 WHEN 0 THEN CAST({NOW} AS DATE) + INTERVAL 9 HOUR + INTERVAL 5 MINUTE WHEN 1 THEN date_trunc('second', posted_at) ELSE {NOW} END AS posted_at, CAST(NULL AS INTEGER) AS views, CAST(NULL AS INTEGER) AS comments, CAST(NULL AS INTEGER) AS recommends
FROM deals WHERE id % 11 <> 0 AND id % 7 <> 0""")
def s07_list_c(spark, sf_dir):
    """Lists of board C: hidden markup, rows that are sold out or notices, titles as attributes, Korean times."""
    title = _say("{c} &lt;{d}&gt; &amp; more", c=F.col("destination"), d="id")
    link = _say('<a data-role="list-title-text" href="/service/board/jirum/{i}?od=T31&amp;po=0#c">{t}</a>', i="id", t=title)
    subject = F.when(F.col("id") % 2 == 0, F.concat(F.lit('<span class="list_subject" title="'), title, F.lit('">'), F.regexp_replace(link, ">[^<]*</a>", ">...</a>"))).otherwise(
        F.concat(F.lit('<span class="list_subject"><a class="list_reply" href="#r">7</a>'), link))
    time = F.when(F.col("id") % 3 == 0, "09:05").when(F.col("id") % 3 == 1, F.date_format(dates.kst(F.col("posted_at")), "yyyy-MM-dd HH:mm:ss")).otherwise("")
    row = _say('<div class="list_item{k}"><!-- <div class="list_item"> -->{s}</span><style>.x{}</style><span class="timestamp">{w}</span></div>', k=F.when(F.col("id") % 11 == 0, " sold_out").when(F.col("id") % 7 == 0, " NoticeRow").otherwise(""), s=subject, w=time)
    return _listed(spark, sf_dir, "clien", row, "﻿<div class='board'>", "</div>")


@query(f"""WITH {DEALS} SELECT id, CASE id % 4 WHEN 3 THEN '' ELSE 'Fare to ' || destination || ' for ' || price_krw END AS body FROM deals""")
def s10_detail_bodies(spark, sf_dir):
    """Details of board B: the first container that holds anything, in the order of the containers' list."""
    text = _say("Fare&nbsp;to <b>{c}</b>\n\t for {p}", c=F.col("destination"), p=F.col("price_krw"))
    wrap = lambda head, tail: F.concat(F.lit(head), text, F.lit(tail))
    html = (F.when(F.col("id") % 4 == 0, wrap("<article>other</article><div class='x view_content'> <p>", "</p></div><div class='view_content'>second</div>"))
            .when(F.col("id") % 4 == 1, wrap("<div class='view_content'> &nbsp; </div><article>last</article><div class='board_main_view'><div>", "</div></div>"))
            .when(F.col("id") % 4 == 2, wrap("<section class='view_content'></section><article><p>", "</p>")).otherwise("<div class='other'>text</div>"))
    return boards.detail_body(V.deals(spark, sf_dir).select("id", html.alias("html")), "ruliweb").select("id", "body")


@query(f"""WITH {DEALS}, named AS (SELECT *, 'deal' || lpad(CAST(id AS VARCHAR), 10, '0') AS sid FROM deals)
SELECT CAST(floor(id / {PAGE}) AS BIGINT) AS page, CAST(id % 3 AS INTEGER) AS kind, sid AS source_id, CASE WHEN id % 2 = 0 THEN '' ELSE 'https://www.playwings.co.kr' END || '/deals/' || sid AS source_url,
  CASE id % 3 WHEN 0 THEN destination || ' <' || id || '> & more' WHEN 1 THEN destination || ' "' || id || '"' ELSE '' END AS title, CASE WHEN id % 5 = 0 THEN {NOW} ELSE date_trunc('second', posted_at) END AS posted_at
FROM named WHERE id % 11 <> 0""".replace("CASE WHEN id % 2 = 0 THEN '' ELSE 'https://www.playwings.co.kr' END", "'https://www.playwings.co.kr'"))
def s08_feed_items(spark, sf_dir):
    """Feeds of all three kinds: RSS items, Atom entries and sitemap URLs, some of other hosts, some twice, some without a date."""
    sid = F.concat(F.lit("deal"), F.lpad(F.col("id").cast("string"), 10, "0"))
    host = F.when(F.col("id") % 11 == 0, "https://other.example").when(F.col("id") % 2 == 0, "").otherwise(markup.BASE_URL)
    link = F.concat(host, F.lit("/deals/"), sid)
    day = lambda form: F.when(F.col("id") % 5 == 0, "some day").otherwise(F.date_format("posted_at", form))
    item = _say("<item><title><![CDATA[ {c} &lt;{i}> &amp; more]]></title><link>{l}</link><pubDate>{d}</pubDate></item>", c="destination", i="id", l=link, d=day("EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    entry = _say('<entry><title type="text">{c} &quot;{i}&quot;</title><link rel="alternate" href="{l}?a=1&amp;b=2"/><updated>{d}</updated></entry>', c="destination", i="id", l=link, d=day("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    url = _say("<url><loc>{l}</loc><lastmod>{d}</lastmod></url>", l=link, d=day("yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
    one = F.when(F.col("id") % 3 == 0, item).when(F.col("id") % 3 == 1, entry).otherwise(url)
    one = F.concat(one, F.when(F.col("id") % 13 == 0, F.regexp_replace(one, "more|type", "again")).otherwise(""))
    feeds = _pages(spark, sf_dir, one, "<?xml version='1.0'?><rss><channel>", "</channel></rss>").withColumnRenamed("html", "xml")
    got = markup.feed_items(feeds, dates.lit_time(AS_OF))
    return got.select("page", "kind", "source_id", F.regexp_replace("source_url", r"\?.*", "").alias("source_url"), "title", "posted_at")


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS n, md5(html) AS digest FROM pages")
def s14_charsets(spark, sf_dir):
    """Landed pages as bytes in three charsets, by the header or by the fallback, and back to text."""
    html, k = F.col("html"), F.col("page_id") % 3
    narrow = html.rlike(r"^[\x00-\xFF]*$") & (k == 1)
    content = F.when(narrow, F.encode(F.when(narrow, html).otherwise(""), "ISO-8859-1")).when(k == 2, F.encode(html, "UTF-16LE")).otherwise(F.encode(html, "UTF-8"))
    header = F.when(narrow, "text/html; charset=ISO-8859-1").when(k == 2, "text/html; Charset=utf-16le ; x=y").when(k == 0, "text/html")
    got = markup.decode_pages(V.table(spark, sf_dir, "pages").select("page_id", content.alias("content"), header.alias("content_type")))
    return got.select("page_id", F.length("html").cast("long").alias("n"), F.md5("html").alias("digest"))
