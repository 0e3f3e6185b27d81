"""Whole texts of long licences."""

from importlib.resources import files

from pyspark.sql import functions as F

from farewright.llm import license_scan
from farewright.llm.license_texts import forms
from tests.oracle import SF

LONG = ["Apache-2.0", "Artistic-1.0-Perl", "BSD-3-Clause-Regents", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]


def test_long_licences(spark):
    texts = {n: (files("farewright.llm") / "licenses" / f"{n}.txt").read_text("utf-8") for n in LONG}
    rows = [(n, t) for n, t in texts.items()] + [(n, " ".join(t.upper().split("\t")) + "\r\n") for n, t in texts.items()] + [("", t[: len(t) // 2]) for t in texts.values()]
    docs = spark.createDataFrame(rows, "name string, text string")
    got = license_scan.scan(docs, license_scan.known_digests(spark)).select("name", F.coalesce("license", F.lit("")).alias("license")).collect()
    assert len(got) == 3 * len(LONG) and all(r.name == r.license for r in got)


def test_planted_in_documents(spark):
    """A tenth of a table's rows are licences in one of their forms and writings; each is found, nothing else is."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    known, want, rows = forms(), {}, []
    writings = [lambda t: t, str.upper, lambda t: f"Copyright (c) 2024 Somebody\n\n{t}\r\n", lambda t: t.replace("license", "licence"), lambda t: t.replace(",", " ;").replace('"', "\u201d")]
    for i, (d, t) in enumerate(docs):
        if i % 10 == 0:
            name, body = known[i // 10 % len(known)]
            t, want[d] = writings[i // 10 % len(writings)](body), name
        rows.append((d, t))
    assert len({n for n, _ in known}) == 24 and len(known) > 40
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(table, license_scan.known_digests(spark)).select("doc_id", "license").collect()}
    assert got == {d: want.get(d) for d, _ in docs} and len(want) == -(-len(docs) // 10)


def test_every_form(spark):
    """With and without what follows the terms; a text that lacks a line of its terms is another text."""
    rows = forms()
    docs = spark.createDataFrame([(n, t) for n, t in rows] + [("", t.replace("warranty", "", 1)) for n, t in rows if "warranty" in t], "name string, text string")
    got = license_scan.scan(docs, license_scan.known_digests(spark)).select("name", F.coalesce("license", F.lit("")).alias("license")).collect()
    assert all(r.name == r.license for r in got) and sum(n == "GPL-3.0" for n, _ in rows) == 3


def test_own_texts(spark):
    more = spark.createDataFrame([("House", "Do with it what you like."), ("Null", None), ("Empty", " . "), (None, "No name."), ("ISC", "Two words")], "license string, text string")
    docs = spark.createDataFrame([(0, "do with it: what YOU like"), (1, ""), (2, None), (3, "no name"), (4, "two-words")], "i int, text string")
    got = license_scan.scan(docs, license_scan.known_digests(spark, more)).orderBy("i").collect()
    assert [r.license for r in got] == ["House", None, None, None, "ISC"]
