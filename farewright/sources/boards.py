"""Posts from landed pages of three boards and a feed: list rows, details, allowed URLs."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewright.functions.dates import lit_time
from farewright.functions.parsing import comment_count, loose_int
from farewright.sources.dom import Node, parts, squeezed

#: Where the boards are, and which of their paths may be read.
LIST_URLS = {
    "ppomppu": "https://www.ppomppu.co.kr/zboard/zboard.php?id=ppomppu4", "ruliweb": "https://bbs.ruliweb.com/market/board/1020",
    "clien": "https://www.clien.net/service/board/jirum", "playwings": "https://www.playwings.co.kr/deals/"}
PATHS = {
    "ppomppu": ["/zboard/zboard.php", "/zboard/view.php"], "ruliweb": ["/market/board/1020"],
    "clien": ["/service/board/jirum"], "playwings": ["/sitemap-index.xml", "/sitemap-", "/deals"]}
BLOCKED_KEYS = ["cate", "view", "view_cert", "view_best", "search_type", "search_key", "orderby", "range", "custom_list"]
BODY_TAGS = {
    "ppomppu": [("td", "board-contents"), (None, "board_main"), ("#", "quote"), (None, "view_body"), ("#", "contents_wrap")],
    "ruliweb": [("div", "view_content"), ("div", "board_main_view"), (None, "view_content"), ("article", None)],
    "clien": [("div", "post_content"), ("div", "post_article"), ("article", "post_article"), ("div", "post_view")]}
ITEMS = "source_id string, source_url string, title string, posted_at timestamp_ntz, views int, comments int, recommends int"


def allowed_path(url: Column, source: str, paths: list[str] | None = None, blocked: list[str] = BLOCKED_KEYS) -> Column:
    """Whether a page may be read: its path is listed; board B has no blocked query key, board C no
    query at all (and a slash after the listed path)."""
    paths = PATHS[source] if paths is None else paths
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    if source == "clien":
        ok = [(path == p) | path.startswith(p + "/") for p in paths]
    else:
        ok = [path.startswith(p) for p in paths]
    out = ok[0]
    for o in ok[1:]:
        out = out | o
    if source == "ruliweb":
        out = out & ~F.concat(F.lit("&"), query).rlike(f"&({'|'.join(blocked)})(=|&|$)")
    return out & (query == "") if source == "clien" else out


def post_time(text: Column, source: str, as_of: Column) -> Column:
    """The time a list row shows, null if it fits no form. HH:MM is of as_of's day; board A also has
    YY/MM/DD and ISO days, B dotted days with or without a time (UTC), C Korean times."""
    t = F.trim(text)
    day = F.date_format(as_of, "yyyy-MM-dd ")
    hm = F.regexp_extract(t, r"^(\d{1,2}):(\d{2})$", 0)
    today = F.when(hm != "", F.try_to_timestamp(F.concat(day, F.lpad(hm, 5, "0")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"))
    form = lambda p, f: F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz"))
    more = {
        "ppomppu": [F.when(t.rlike(r"^\d{2}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(F.concat(F.lit("20"), t), F.lit("yyyy/M/d")).cast("timestamp_ntz")), form(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd")],
        "ruliweb": [form(r"^\d{4}\.\d{1,2}\.\d{1,2}\s+\d{1,2}:\d{2}$", "yyyy.M.d H:mm"), form(r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d")],
        "clien": [x - F.expr("INTERVAL 9 HOURS") for x in (form(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), form(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}$", "yyyy-MM-dd HH:mm"))]}
    return F.coalesce(today, *more[source])


#: Links whose parts are plain: a path from the root or a name in the list's folder, and a query without escapes.
_PLAIN_LINK = re.compile(r"((?:/[A-Za-z0-9_-]+)+|[A-Za-z0-9_-]+\.php)(?:\?([A-Za-z0-9_&=-]+))?(#[A-Za-z0-9_-]+)?")
_ROOTS = {s: (re.match("[a-z]+://[^/]+", u)[0], u.split("?")[0].rpartition("/")[0] + "/") for s, u in LIST_URLS.items()}


def _linked(source: str, href: str) -> tuple[str, str, str]:
    """(URL, path, query) of a link on a list's page; by urllib, unless the link is plain."""
    root, folder = _ROOTS[source]
    if m := _PLAIN_LINK.fullmatch(href):
        url = (root if href[0] == "/" else folder) + href
        return url, m[1] if href[0] == "/" else folder[len(root):] + m[1], m[2] or ""
    url = urljoin(LIST_URLS[source], href)
    at = urlsplit(url)
    return url, at.path, at.query


def _number(query: str) -> str:
    """The first value of no that is not empty."""
    if _PLAIN_LINK.fullmatch(f"/q?{query}"):
        found = re.search("(?:^|&)no=([^&]+)", query)
        return found[1] if found else ""
    return parse_qs(query).get("no", [""])[0]


def _text(node: Node | None) -> str | None:
    return None if node is None else node.text.strip()


def _row_a(row: Node) -> dict | None:
    for a in row.all("a"):
        href = a.attrs.get("href", "")
        if "view.php" in href and "id=ppomppu4" in href and "baselist-thumb" not in a.attrs.get("class", "").lower():
            url, _, asked = _linked("ppomppu", href)
            no = _number(asked)
            title = squeezed(a.text)
            shown = row.first("time") or row.first(None, "list_time") or row.first(None, "date")
            return {"id": no, "url": url, "title": title, "shown": _text(shown)} if title and re.fullmatch(r"[0-9]+", no) else None
    return None


def _row_b(row: Node) -> dict | None:
    a = row.first("a", "subject_link")
    if a is None:
        return None
    url, path, _ = _linked("ruliweb", a.attrs.get("href", ""))
    found = re.search(r"/market/board/1020/read/([0-9]+)", path)
    if not found:
        return None
    strong, reply = a.first("strong"), a.first(None, "num_reply")
    title = squeezed(strong.text) if strong and squeezed(strong.text) else squeezed(a.text.replace(reply.text, "", 1) if reply else a.text)
    cell = lambda c: _text(row.first("td", c))
    return {"id": found[1], "url": url, "title": title, "shown": cell("time"), "views": cell("hit"), "recommends": cell("recomd"), "comments": _text(row.first(None, "num_reply"))} if title else None


def _row_c(row: Node) -> dict | None:
    cls = row.attrs.get("class", "").lower()
    subject = row.first("span", "list_subject")
    if subject is None or any(x in cls for x in ("notice", "blocked", "rule", "hongbo", "sold_out")):
        return None
    others = (a for a in subject.all("a") if not any(x in a.attrs.get("class", "").lower() for x in ("list_reply", "reply_symph")))
    a = subject.first("a", data_role="list-title-text") or next(others, None)
    href = _linked("clien", a.attrs.get("href", ""))[0].split("#")[0].split("?")[0] if a else ""
    inside = href.removeprefix(_ROOTS["clien"][0])
    url, path, _ = _linked("clien", inside if inside.startswith("/") and _PLAIN_LINK.fullmatch(inside) else href)
    found = re.fullmatch(r"/service/board/jirum/([0-9]+)", path)
    title = subject.attrs.get("title", "").strip() or (squeezed(a.text) if a else "")
    shown = row.first(None, "timestamp") or row.first(None, "time") or row.first(None, "date")
    return {"id": found[1], "url": url, "title": title, "shown": _text(shown)} if found and title else None


def _is_row(source: str) -> Callable[[Node], bool]:
    #: The classes of list rows, and of rows that are no posts.
    if source == "ppomppu":
        return lambda n: n.tag == "tr" and bool({"baseList", "list1", "list0", "common-list1", "common-list0"} & set(n.classes))
    if source == "ruliweb":
        return lambda n: n.is_a("tr", "table_body") and not {"notice", "best"} & {c.lower() for c in n.classes}
    return lambda n: n.is_a("div", "list_item")


_ITEM = {"ppomppu": _row_a, "ruliweb": _row_b, "clien": _row_c}
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|svg)\b.*?</\1>|<!--.*?-->")


_LISTED = "pos int, source_id string, source_url string, title string, shown string, views string, comments string, recommends string"
#: Pages whose rows are handed on together.
PAGES = 128


def _posts(html: str | None, source: str):
    """The values of _LISTED for each post of a page."""
    if html is None:
        return
    if source == "clien":
        html = _HIDDEN.sub("", html.removeprefix("\ufeff"))
    seen: set[str] = set()
    for pos, item in enumerate(item for row in parts(html, _is_row(source)) if (item := _ITEM[source](row))):
        if item["id"] not in seen:
            seen.add(item["id"])
            yield pos, item["id"], item["url"], item["title"], item.get("shown"), item.get("views"), item.get("comments"), item.get("recommends")


@F.udtf(returnType=_LISTED)
class ListRows:
    """list_rows(html, source): the list rows of a page, each when it closes, the first of each post id; pos
    counts the rows that are posts, from 0. A null page has none."""

    def eval(self, html: str, source: str):
        yield from _posts(html, source)


@F.udtf(returnType="body string")
class DetailBody:
    """detail_body(html, source): one row, the text of the first container of the board that has any; empty if
    none has. Of a container that comes more than once the first counts. Reading ends with the first
    choice."""

    def eval(self, html: str, source: str):
        choices = BODY_TAGS[source]
        which = lambda n: [i for i, (tag, cls) in enumerate(choices) if (n.is_a(id=cls) if tag == "#" else n.is_a(tag, cls))]
        texts: dict[int, str] = {}
        for node in parts(html or "", lambda n: bool(which(n))):
            for i in which(node):
                texts.setdefault(i, squeezed(node.text.replace("\u00a0", " ")))
            if texts.get(0):
                break
        yield (next((texts[i] for i in sorted(texts) if texts[i]), ""),)


def register(spark: SparkSession) -> None:
    """Makes list_rows and detail_body known to SQL: FROM pages, LATERAL list_rows(html, 'ruliweb')."""
    spark.udtf.register("list_rows", ListRows)
    spark.udtf.register("detail_body", DetailBody)


def list_items(pages: DataFrame, source: str, as_of: dt.datetime, html: str = "html") -> DataFrame:
    """pages and their list rows, the first of each post id on a page, in the page's order (pos). A
    row without a time has as_of; counts that are no numbers are null. Pages keep all columns but
    the HTML; a null page has no rows."""
    keep = [c for c in pages.columns if c != html]
    names = [f"_{n.split()[0]}" for n in _LISTED.split(", ")]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some = batch.slice(start, PAGES)
                found = [(i, *post) for i, page in enumerate(some.column(0)) for post in _posts(page.as_py(), source)]
                of, pos, *texts = zip(*found) if found else [()] * (len(names) + 1)
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in some.columns[1:]), pa.array(pos, pa.int32()), *(pa.array(t, pa.string()) for t in texts)],
                    names=[*some.schema.names[1:], *names])

    narrow = pages.select(F.col(html).alias("_html"), *keep)
    schema = narrow.drop("_html").withColumns({n: F.lit(0 if n == "_pos" else "") for n in names}).schema
    for f in schema.fields:
        f.nullable = True
    got = narrow.mapInArrow(run, schema)
    at = F.coalesce(post_time(F.coalesce("_shown", F.lit("")), source, lit_time(as_of)), lit_time(as_of))
    return got.select(
        *keep, F.col("_pos").alias("pos"), F.col("_source_id").alias("source_id"), F.col("_source_url").alias("source_url"), F.col("_title").alias("title"), at.alias("posted_at"),
        loose_int(F.col("_views")).alias("views"), comment_count(F.coalesce("_comments", F.lit(""))).alias("comments"), loose_int(F.col("_recommends")).alias("recommends"))


def detail_body(pages: DataFrame, source: str, html: str = "html", out: str = "body") -> DataFrame:
    """pages with the text of the first non-empty container of the board; empty if there is none."""
    got = pages.lateralJoin(DetailBody(F.col(html).outer(), F.lit(source)).toDF("_body"))
    return got.select(*(c for c in pages.columns if c != out), F.col("_body").alias(out))
