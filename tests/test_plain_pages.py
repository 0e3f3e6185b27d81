"""Plain markup is read by one expression, all else by the parser, with the same elements; pages go to all tasks."""

import random
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

from pyspark.sql import functions as F

from farewright.plans import board_queries
from farewright.sources import boards, dom
from tests.oracle import SF

BITS = ["<p>", '<p class="a b">', "</p>", "<div id=1>", "<div id='x'>", "</div>", "text", "&amp;", "&lt", "&not", "&notit;", "<br>", "<br/>", "<!-- c -->", "<!-- <p> -->", "<!--->", "<!doctype html>", "<script>",
        "</script>", '<script>a<b c</script>', "<style x='1'>", "</style>", "<title>", "</title>", "<a href='?a=1&amp;b&no=3&copy=4'>", "</a>", '<a b=c"d e="f>', '<a "', ">", "<", "</", "</p x>", "<A HREF=\"X\" Data-Q>",
        '<a href="x"b="y">', '<a x="1" x="2">', "\x00", "\r\n", "<?pi?>", "<![CDATA[x]]>", "é", " ", '<p\n class="z"\t>', "<svg>", "<sCRIPT>a<b</Script>", "<p/x>", "<p é='1'>", '<p x="&#39;&#x41;&quot;">', "<li", "<style>a</style >"]


def tree(node):
    out = []
    for p in node.parts:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif p:
            out.append(p if isinstance(p, str) else tree(p))
    return node.tag, node.attrs, out


def test_same_elements(monkeypatch):
    r = random.Random(5)
    pages = ["".join(r.choice(BITS[: r.choice((13, len(BITS)))]) for _ in range(r.randrange(1, 25))) for _ in range(4000)]
    wanted = [lambda n: n.tag == "p", lambda n: n.tag in ("a", "div", "script"), lambda n: True]
    got = [[tree(n) for n in dom.parts(p, w)] for p in pages for w in wanted]
    monkeypatch.setattr(dom, "_read_plain", lambda cut, html: iter([0]))
    assert got == [[tree(n) for n in dom.parts(p, w)] for p in pages for w in wanted]


def test_plain_pages_do_not_go_through_the_parser(monkeypatch):
    fed = []
    monkeypatch.setattr(HTMLParser, "feed", lambda self, data: fed.append(data))
    row = '<tr class="table_body"><td><a class="deco subject_link" href="/market/board/1020/read/{0}?p=1">t &lt;{0}&gt;</a><td class="hit">1,000</td></tr>\n'
    got = list(boards._posts("<script>var a = '<tr>'</script><table>" + "".join(row.format(i) for i in range(40)), "ruliweb"))
    assert fed == [] and [(x[1], x[3], x[5]) for x in got] == [(str(i), f"t <{i}>", "1,000") for i in range(40)]


def test_links():
    hrefs = ["/a/b?x=1#c", "view.php?id=ppomppu4&no=12", "view.php?no=&no=5", "../x", "//h/x", "/a//b", "/a/../b?no=%31", "?no=7", "", "#c", "view.php?", "http://[x", "https://h/a/../b?no=3", "/a.b?no=1&no=2", "/a?no=1+2", "x.php#y"]
    for source in boards._ROOTS:
        for href in hrefs:
            try:
                url = urljoin(boards.LIST_URLS[source], href)
            except ValueError:
                continue
            got = boards._linked(source, href)
            assert got == (url, urlsplit(url).path, urlsplit(url).query)
            assert boards._number(got[2]) == parse_qs(got[2]).get("no", [""])[0]


def test_pages_go_to_all_tasks(spark):
    """However few bytes the deals have."""
    pages = board_queries._pages(spark, SF, F.col("destination"), "", "").select(F.spark_partition_id().alias("p"), "page")
    assert pages.select("p").distinct().count() >= 8


def test_no_posts(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>")], "page int, html string")
    assert boards.list_items(pages, "clien", board_queries.AS_OF).count() == 0
    assert boards.list_items(pages.where("false"), "clien", board_queries.AS_OF).count() == 0
