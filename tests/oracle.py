"""Runs a query and its SQL twin side by side."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(rows, names):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


def same(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*names).collect()]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = db.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert _rows(ours, names) == _rows(theirs, names)
