"""The manifest against a plain tree, for many sizes and shapes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from farewright.llm import merkle
from tests.llm.fixtures import edge, empty


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(nodes, fanout):
    """The root, and for each leaf the siblings to the left and right, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            s = i - i % fanout
            proofs[k].append(("".join(nodes[s:i]), "".join(nodes[i + 1 : s + fanout])))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


@pytest.mark.parametrize("fanout, levels, most", [(2, 1, 20), (2, 3, 40), (3, 2, 40), (16, 2, 300)])
def test_trees(spark, fanout, levels, most):
    r = random.Random(fanout * levels)
    rows = [(k, None if s == 3 else f"s{s}", h(f"{s}/{k}"), s) for s in range(7) for k in range(r.choice([1, fanout, fanout + 1, fanout**levels, fanout**levels + 1, r.randrange(1, most)]))]
    r.shuffle(rows)
    got = merkle.proofs(spark.createDataFrame(rows, "doc_id long, source string, leaf string, root int"), fanout=fanout, levels=levels).collect()
    names = sorted({x[1] for x in rows}, key=lambda s: (s is not None, s))
    own = {s: sorted((x[0], x[2]) for x in rows if x[1] == s) for s in names}
    lower = {s: plain([d for _, d in own[s]], fanout) for s in names}
    root, upper = plain([lower[s][0] for s in names], fanout)
    want = {}
    for s, up in zip(names, upper):
        for (k, d), p in zip(own[s], lower[s][1]):
            want[(k, s)] = (d, lower[s][0], root, p + up)
    assert {(x.doc_id, x.source): (x.leaf, x.subroot, x.root, [tuple(p) for p in x.proof]) for x in got} == want and len(got) == len(rows)


def test_edges(spark):
    """Nulls, repeated rows, a null source first; one row; no rows. Verified unless forged."""
    docs = edge(spark)
    leaves = docs.withColumn("leaf", merkle.leaf(*(F.col(c) for c in merkle.COLUMNS)))
    got = merkle.proofs(leaves).withColumn("ok", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).withColumn("bad", merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root"))
    rows = got.collect()
    assert len(rows) == docs.count() and all(x.ok and not x.bad for x in rows) and len({x.root for x in rows}) == 1
    assert {x.text for x in rows} == {x.text for x in docs.collect()}
    assert next(x.leaf for x in rows if x.doc_id == 3) == h("1:3" + "1:a" + "2:en" + "-" + "-")
    assert merkle.proofs(empty(spark).withColumn("leaf", F.lit("x"))).collect() == []
    lone = merkle.proofs(leaves.where("doc_id = 7")).withColumn("d", merkle.proof_digest(F.col("proof"))).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof == [] and lone.d == h("")


def test_many_equal_rows(spark):
    """A source that is one row over and over: places of their own, one root."""
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit(h("x")).alias("leaf"))
    got = merkle.proofs(rows).select("root", (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).distinct().collect()
    assert [(x.root, x.ok) for x in got] == [(plain([h("x")] * 3000, 16)[0], True)]
