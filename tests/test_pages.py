"""Pages as streams of elements, table functions in SQL, charsets, and JSON with a lifetime."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from farewright.sources import boards, dom, markup, tables

NOW = dt.datetime(2026, 4, 18, 12)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_parts(monkeypatch, chunk):
    """Elements in the page's order, nested ones after the one around them; unclosed, void, misnested and cut ones."""
    monkeypatch.setattr(dom, "CHUNK", chunk)
    html = "x<p>a<i>b</p>c<div><p id=1>d<p id=2>e<br>f</div>g<p/>h<p id='3'>i &amp; <b>j"
    got = [(n.attrs.get("id"), n.text) for n in dom.parts(html, lambda n: n.tag == "p")]
    assert got == [(None, "ab"), ("1", "def"), ("2", "ef"), (None, ""), ("3", "i & j")]
    assert list(dom.parts("", lambda n: True)) == [] and [n.tag for n in dom.parts("<br><hr>", lambda n: True)] == ["br", "hr"]


def test_only_what_is_wanted_is_held():
    """A page of many rows: what is handed on is not kept, what lies between is never kept."""
    cut = dom._Cutter(lambda n: n.tag == "li")
    for _ in range(2000):
        cut.feed("<p>between<ul><li>row <b>x</b></ul></p>")
        assert len(cut.ready) == 1 and cut.ready.pop().text == "row x" and not cut.found and len(cut.open) == 0


def test_sql(spark):
    boards.register(spark)
    row = '<tr class="table_body"><td><a class="subject_link" href="/market/board/1020/read/{0}">t{0}</a></td></tr>'
    spark.createDataFrame([(1, row.format(7) + row.format(8) + row.format(7)), (2, "<p>"), (3, None)], "page int, html string").createOrReplaceTempView("landed")
    got = spark.sql("SELECT page, r.pos, r.source_id, r.title FROM landed, LATERAL list_rows(html, 'ruliweb') r ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, "7", "t7"), (1, 1, "8", "t8")]
    got = spark.sql("SELECT page, body FROM landed, LATERAL detail_body(html, 'ruliweb') ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [(1, ""), (2, ""), (3, "")]


def test_columns_of_pages_stay(spark):
    """Also those that are called as the rows' are."""
    page = '<div class="list_item"><span class="list_subject"><a data-role="list-title-text" href="/service/board/jirum/5">t</a></span></div>'
    got = boards.list_items(spark.createDataFrame([("kept", page)], "views_of string, html string"), "clien", NOW).first()
    assert (got.views_of, got.source_id, got.title, got.posted_at, got.views) == ("kept", "5", "t", NOW, None)
    got = boards.detail_body(spark.createDataFrame([("old", "<div class='post_content'>new</div>")], "body string, html string"), "clien").first()
    assert got.body == "new" and got.asDict().keys() == {"html", "body"}


def test_charsets(spark):
    """What Spark decodes and what Python decodes agree with Python alone, on bytes of any kind."""
    r, rows = random.Random(1), []
    for name in (None, "utf-8", "UTF-8", "iso-8859-1", "euc-kr", "utf-16le", "ascii", "nonsense", "latin1"):
        for text in ("", "plain", "서울 é", None):
            body = None if text is None else text.encode({None: "utf-8", "nonsense": "utf-8"}.get(name, name), "replace")
            rows.append((body, name))
        rows += [(bytes(r.randrange(256) for _ in range(r.randrange(1, 30))), name) for _ in range(40)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), c and f"text/html; charset={c}") for i, (b, c) in enumerate(rows)], "i int, content binary, content_type string")
    got = {x.i: x.html for x in markup.decode_pages(df, fallback="utf-8").collect()}
    for i, (b, c) in enumerate(rows):
        assert got[i] == (None if b is None else b.decode({None: "utf-8", "nonsense": "utf-8"}.get(c, c), "replace"))


def test_json_lives_for_some_seconds(spark, tmp_path):
    cache, made = tables.JsonCache(spark, str(tmp_path / "c")), []

    def make(value):
        def f():
            made.append(value)
            return spark.createDataFrame([(value, None)], "a int, b string")

        return f

    get = lambda s, v, name="market": [r.json for r in cache.get(name, NOW + dt.timedelta(seconds=s), 600, make(v)).collect()]
    assert get(0, 1) == get(599, 2) == ['{"a":1}'] and made == [1]
    assert get(600, 3) == ['{"a":3}'] and get(601, 4) == ['{"a":3}'] and made == [1, 3]
    assert get(601, 5, "deals") == ['{"a":5}'] and get(10, 6) == ['{"a":1}'] and made == [1, 3, 5]
    assert cache.get("none", NOW, 30, lambda: spark.createDataFrame([], "a int")).collect() == []
