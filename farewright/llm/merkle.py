"""A Merkle tree over a table: a tree for each source, and one over their roots.

Rows get their place among the leaves of their source from one sort by ranges: the place is the number
of rows in the ranges before, plus the place in the row's own range, so no source is sorted in one task.

Superblocks: places are bucketed by FANOUT ** LEVELS, and one applyInPandas call collapses LEVELS levels
of a bucket to its root. The bucket roots are the nodes of the next table, until every tree is one node;
each table is smaller by that factor. The roots of the sources are the leaves of the last tree, reduced
in the same way. Proofs go back down: a bucket's proof is the lower part of a node's in it, within the
bucket, and what its own root has, the upper part.

A digest is the lower-case hex SHA-256 of text. A run of FANOUT consecutive nodes (the last may have
fewer, even one) becomes the digest of their digests in a row; a tree of one node is that node.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farewright.llm.shared import fresh, written

FANOUT, LEVELS = 16, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "lefts array<string>, rights array<string>, subroot string, root string"


def leaf(*columns: Column) -> Column:
    """The digest of a row: of each value its UTF-8 bytes' number, a colon and the value, `-` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _height(n: int, fanout: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def _levels(digests: list[str], fanout: int, height: int) -> list[list[str]]:
    """The nodes of a bucket, and those of each level above, up to its root."""
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _numbered(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """rows with their place (from 0) in the order of columns by, nulls first. Equal rows share a range
    only as far as a random number deals them out."""
    row, part, first, before = fresh(rows, "row", "part", "first", "before")
    order = [F.col(c).asc_nulls_first() for c in by]
    dealt = rows.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33)), "ranges")
    # One row for each range: the window holds as many rows as there are partitions.
    starts = dealt.groupBy(part).agg(F.min(row).alias(first), F.count("*").alias("n"))
    starts = starts.withColumn(before, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return dealt.join(starts, part).withColumn(at, F.col(row) - F.col(first) + F.col(before)).drop(row, part, first, before)


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes: (tree, at, n, digest), n the number of the tree's nodes. The tables of bucket roots above it;
    the last has one node a tree."""
    width = fanout**levels

    def collapse(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        top = _levels(frame.sort_values("at")["digest"].tolist(), fanout, min(levels, _height(n, fanout)))[-1]
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "n": [-(-n // width)], "digest": top})

    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        bucket = out[-1].withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
        out.append(written(bucket.groupBy("tree", "bucket").applyInPandas(collapse, "tree long, at long, n long, digest string"), "merkle"))
    return out


def _descend(tables: list[DataFrame], tops: DataFrame, fanout: int, levels: int, extra: list[str]) -> DataFrame:
    """tops: (tree, at, lefts, rights, subroot, root) of the last table's nodes. The same of each node of the
    first table, with its extra columns."""
    width = fanout**levels

    def proofs(own: list[str]):
        def run(below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            below = below.sort_values("at")
            n, up = int(below["n"].iloc[0]), above.iloc[0]
            by_level, sizes = _levels(below["digest"].tolist(), fanout, min(levels, _height(n, fanout))), range(len(below))
            sides = []
            for nodes in by_level[:-1]:
                starts = [i - i % fanout for i in range(len(nodes))]
                sides.append([("".join(nodes[s:i]), "".join(nodes[i + 1 : s + fanout])) for i, s in enumerate(starts)])
            out = below[["tree", "at", *own]].copy()
            for k, name in enumerate(("lefts", "rights")):
                out[name] = [[side[i // fanout**j][k] for j, side in enumerate(sides)] + list(up[name]) for i in sizes]
            out["subroot"], out["root"] = up["subroot"], up["root"]
            return out

        return run

    for i in reversed(range(len(tables) - 1)):
        own = extra if i == 0 else []
        kept = tables[i].select("tree", "at", *own)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + _PROOF
        below = tables[i].withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
        above = tops.select("tree", F.col("at").alias("bucket"), "lefts", "rights", "subroot", "root")
        tops = below.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInPandas(proofs(own), schema)
        if i:
            tops = written(tops, "merkle_proofs")
    if len(tables) == 1:
        tops = tables[0].select("tree", "at", *extra).join(tops, ["tree", "at"])
    return tops


def proofs(rows: DataFrame, tree: str = "source", order: str = "doc_id", digest: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """rows with `subroot`, `root` and `proof`: array<struct<left, right>>, for each level on the way up
    what stands to the left and to the right of the node in its run.

    Leaves of a tree are ordered by `order` (null first), then by digest; trees by name (null first). Rows
    that agree in all of these are leaves of their own, in any order. No rows give no rows. Other
    columns are carried along under their names, but for those of the result."""
    keep = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    held = [f"c{i}" for i in range(len(keep))]
    of = dict(zip(keep, held))
    bare = rows.select(*(F.col(f"`{c}`").alias(h) for c, h in of.items()))
    placed = written(_numbered(bare, [of[tree], of[order], of[digest]], "place"), "places")
    trees = placed.groupBy(F.col(of[tree]).alias("name")).agg(F.min("place").alias("start"), F.count("*").alias("n"))
    trees = written(_numbered(trees, ["name"], "tree"), "trees")
    nodes = placed.join(trees, F.col(of[tree]).eqNullSafe(F.col("name")))
    nodes = written(nodes.select("tree", (F.col("place") - F.col("start")).alias("at"), "n", F.col(of[digest]).alias("digest"), *held), "leaves")
    lower = _climb(nodes.select("tree", "at", "n", "digest", *held), fanout, levels)
    number = trees.count()
    tops = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(number).cast("long").alias("n"), F.col("digest"))
    upper = _climb(written(tops.withColumn("subroot", F.col("digest")), "subroots"), fanout, levels)
    none = F.array().cast("array<string>")
    start = upper[-1].select("tree", "at", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    roots = _descend([upper[0].drop("subroot"), *upper[1:]], start, fanout, levels, [])
    roots = roots.drop("subroot").withColumnRenamed("tree", "one").join(upper[0].select("at", "subroot"), "at")
    roots = written(roots.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "lefts", "rights", "subroot", "root"), "roots")
    done = _descend(lower, roots, fanout, levels, held)
    proof = F.transform(F.arrays_zip("lefts", "rights"), lambda p: F.struct(p["lefts"].alias("left"), p["rights"].alias("right")))
    return done.select(*(F.col(h).alias(c) for c, h in of.items()), "subroot", "root", proof.alias("proof"))


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)
