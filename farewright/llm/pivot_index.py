"""Near-duplicate embeddings by an index of pivot permutations.

A vector is described by the NEAREST of PIVOTS reference vectors, in the order of their nearness. Two
vectors at a cosine of 0.95 have SHARED of these in common with a probability of 0.99, two unrelated ones
of 64 dimensions with 0.0003. Inverted lists are kept for combinations of KEY pivots: with the pivots of a
vector in one fixed order, rarest first, two vectors that share SHARED of NEAREST share KEY of their first
NEAREST - SHARED + KEY. What meets in a list is counted by its shared pivots (bit counts), then verified
by its cosine in double precision.

Equal vectors are one entry with a weight. In a list of more than CROWD entries, those within half the
angle of a leading entry become its ball: they are all linked with each other, so a large group costs one
row a list and no pairs. Two balls are linked as a whole, or not at all, where their centres and radii
decide it; else their members are compared in blocks, which give a number of links for each member.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.llm.components import components
from farewright.llm.shared import written

COSINE = 0.95
PIVOTS, NEAREST, SHARED, KEY = 256, 10, 5, 3
#: Vectors that pivots are chosen from, those with the least hashes; no two pivots are closer than APART.
SAMPLE, APART = 4096, 0.8
#: Entries of a list that are not yet a crowd; rounds of leading entries; members of a block.
CROWD, ROUNDS, BLOCK = 64, 2, 256
#: Radians that bounds of angles are kept away from the threshold by.
MARGIN = 1e-6


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, however large or small the components are."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Index:
    """The pivots, a row each, those that are near to fewest vectors of the sample first."""

    def __init__(self, sample: list[list[float]], pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, key: int = KEY, seed: int = 42):
        assert pivots % 64 == 0 and key <= shared <= nearest < pivots
        self.nearest, self.shared, self.key = nearest, shared, key
        self.dim = max(map(len, sample), default=1)
        rows, chosen = self.padded(sample), np.zeros((0, self.dim))
        for row in rows:
            if len(chosen) < pivots and not (chosen @ row > APART).any():
                chosen = np.vstack([chosen, row])
        rng = np.random.Generator(np.random.PCG64(seed))
        more = unit(rng.standard_normal((pivots, self.dim)))
        self.pivots = np.vstack([chosen, more])[:pivots]
        if len(rows):
            self.pivots = self.pivots[np.argsort(np.bincount(self.order(rows).ravel(), minlength=pivots), kind="stable")]

    def padded(self, vectors: list[list[float]]) -> np.ndarray:
        """Unit vectors as rows; shorter ones end in zeros, longer ones are cut (only for their description)."""
        out = np.zeros((len(vectors), self.dim))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v[: self.dim]
        out[~out.any(axis=1)] = 1.0
        return unit(out) if len(out) else out

    def order(self, units: np.ndarray) -> np.ndarray:
        """The nearest pivots of each row, nearest first; of equally near ones the first."""
        return np.argsort(-(units @ self.pivots.T), axis=1, kind="stable")[:, : self.nearest]

    def words(self, order: np.ndarray) -> np.ndarray:
        """The set of pivots as bits."""
        bits = np.zeros((len(order), len(self.pivots)), np.uint8)
        np.put_along_axis(bits, order, 1, axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<i8")

    def keys(self, order: np.ndarray) -> np.ndarray:
        """The inverted lists that each row stands in."""
        first = np.sort(order, axis=1)[:, : self.nearest - self.shared + self.key].astype(np.int64)
        of = np.zeros((len(order), math.comb(first.shape[1], self.key)), np.int64)
        for k, chosen in enumerate(combinations(range(first.shape[1]), self.key)):
            for c in chosen:
                of[:, k] = of[:, k] * len(self.pivots) + first[:, c]
        return of


def fit(vectors: DataFrame, pivots: int = PIVOTS) -> Index:
    """vectors: (v), distinct. An index whose pivots come from at most SAMPLE of them."""
    sample = vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE)
    return Index([r.v for r in sample.select("v").toLocalIterator()], pivots)


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _matrix(column: pa.Array) -> np.ndarray | None:
    """The rows as one array where all have one length."""
    rows = _lists(column)
    return np.vstack(rows) if rows and len({len(r) for r in rows}) == 1 else None


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row, of unit vectors; below any threshold where they differ in length."""
    x, y = _matrix(a), _matrix(b)
    if x is not None and y is not None and x.shape == y.shape:
        return (x * y).sum(axis=1)
    return np.array([p @ q if len(p) == len(q) else -2.0 for p, q in zip(_lists(a), _lists(b))])


def described(entries: DataFrame, index: Index) -> DataFrame:
    """entries: (node, v, ...) with their unit vectors `u`, sets of pivots `b0`, `b1`, ... and `keys`."""
    longs = len(index.pivots) // 64

    def run(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("v"))
            vectors = _lists(rows)
            order = index.order(index.padded(vectors))
            words, keys = index.words(order), index.keys(order)
            units = [unit(v[None, :])[0] for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(units, pa.list_(pa.float64())), *(pa.array(words[:, i]) for i in range(longs)), pa.array(list(keys), pa.list_(pa.int64()))],
                names=[*batch.schema.names, "u", *(f"b{i}" for i in range(longs)), "keys"])

    schema = entries.withColumn("u", F.col("v")).withColumns({f"b{i}": F.lit(0).cast("long") for i in range(longs)}).withColumn("keys", F.array().cast("array<bigint>")).schema
    for f in schema.fields:
        f.nullable = True
    return entries.mapInArrow(run, schema)


def _balls(met: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """(node, ball, angle): entries of crowded lists that a leading entry takes in, leading ones included.
    met: (key, node), lists of more than one entry."""
    half = math.cos(math.acos(cosine) / 2) + 1e-9

    def judge(batches):
        for batch in batches:
            c = _cosines(batch.column(2), batch.column(3))
            near = pa.array(c >= half)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(c).filter(near)], names=["node", "ball", "c"])

    taken = None
    for _ in range(ROUNDS):
        left = met if taken is None else met.join(taken.select("node"), "node", "left_anti")
        crowds = left.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CROWD)
        left = written(left.join(crowds, "key"), "crowds")
        if left.isEmpty():
            break
        company = left.groupBy("node").agg(F.sum("size").alias("company"))
        leads = written(left.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("l")).select("key", F.col("l.node").alias("ball")), "leads")
        pairs = left.join(leads, "key").select("node", "ball").distinct()
        pairs = pairs.join(leads.select(F.col("ball").alias("node")).distinct(), "node", "left_anti")
        asked = pairs.join(units.select("node", F.col("u").alias("a")), "node").join(units.select(F.col("node").alias("ball"), F.col("u").alias("b")), "ball")
        close = asked.select("node", "ball", "a", "b").mapInArrow(judge, "node long, ball long, c double")
        own = close.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "ball")).alias("k")).select("node", F.col("k.ball").alias("ball"), F.acos(F.least(-F.col("k.c"), F.lit(1.0))).alias("angle"))
        own = own.unionByName(leads.select(F.col("ball").alias("node"), "ball", F.lit(0.0).alias("angle")).distinct())
        taken = written(own if taken is None else taken.unionByName(own), "taken")
    return taken if taken is not None else met.sparkSession.createDataFrame([], "node long, ball long, angle double")


def _judged(pairs: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """(a, b, whole) of the pairs of balls that are linked as a whole, or may be in part.
    balls: (ball, u, radius)."""
    limit = math.acos(cosine)

    def judge(batches):
        for batch in batches:
            c, reach = _cosines(batch.column(2), batch.column(3)), batch.column(4).to_numpy()
            angle, lone = np.arccos(np.clip(c, -1, 1)), reach == 0
            whole = np.where(lone, c >= cosine, angle + reach <= limit - MARGIN)
            maybe = (c >= -1.5) & np.where(lone, whole, angle - reach <= limit + MARGIN)
            keep = pa.array(maybe)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(whole).filter(keep)], names=["a", "b", "whole"])

    side = lambda x: balls.select(F.col("ball").alias(x), F.col("u").alias(f"u{x}"), F.col("radius").alias(f"r{x}"))
    asked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ua", "ub", (F.col("ra") + F.col("rb")).alias("reach"))
    return asked.mapInArrow(judge, "a long, b long, whole boolean")


def _in_part(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(a, b, node, links): of pairs of balls (a, b), how many of the other ball's rows each member is linked
    with, for those with any. Members are compared block by block."""

    def judge(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.array([m["u"] for m in row[s]]) for s in ("ma", "mb"))
                near = x @ y.T >= cosine
                wx, wy = (np.array([m["n"] for m in row[s]]) for s in ("ma", "mb"))
                nodes = [m["node"] for m in row["ma"]] + [m["node"] for m in row["mb"]]
                links = np.concatenate([near @ wy, near.T @ wx])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["a"]] * len(some), pa.int64()), pa.array([row["b"]] * len(some), pa.int64()), pa.array(np.array(nodes)[some], pa.int64()), pa.array(links[some], pa.int64())],
                    names=["a", "b", "node", "links"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    held = members.join(asked, "ball", "left_semi")
    sizes = held.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # Dealt by block: the join's own partitions would hold all of a ball.
    dealt = held.join(sizes, "ball").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).repartition("ball", "block")
    blocks = written(dealt.groupBy("ball", "block").agg(F.collect_list(F.struct("node", "n", "u")).alias("m")), "blocks")
    side = lambda x: blocks.select(F.col("ball").alias(x), F.col("m").alias(f"m{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(judge, "a long, b long, node long, links long")


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: how many other rows are linked with it, the
    smallest vec_id that links reach, and whether that is its own.

    Null vectors, empty ones, those of zeros or with null or non-finite components link with nothing.
    Vectors of different lengths are never linked. Rows with one vector are linked with each other, also
    where they agree in vec_id. A null vec_id is never the smallest; a component of nothing else has null
    and its rows are kept. Other columns are left out. No rows give no rows."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(finite, F.col("v")))
    entries = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    entries = written(entries.withColumn("node", F.monotonically_increasing_id()), "entries")
    index = fit(entries, pivots)
    bits = [f"b{i}" for i in range(pivots // 64)]
    known = written(described(entries, index), "described")
    units = known.select("node", "n", "u")

    posted = known.select(F.explode("keys").alias("key"), "node", *bits)
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    met = written(posted.join(lists, "key"), "postings")
    taken = _balls(met.select("key", "node"), units, cosine)
    balled = written(known.select("node", "n", "first", "u").join(taken, "node", "left").withColumns({"ball": F.coalesce("ball", "node"), "angle": F.coalesce("angle", F.lit(0.0))}), "balls")
    each = balled.groupBy("ball").agg(F.sum("n").alias("weight"), F.max("angle").alias("radius"), F.min("first").alias("first"))
    balls = written(each.join(units.select(F.col("node").alias("ball"), "u"), "ball"), "centres")

    shown = met.join(taken.select("node", "ball"), "node", "left").groupBy("key", F.coalesce("ball", "node").alias("ball")).agg(*(F.bit_or(b).alias(b) for b in bits))
    p, q = shown.alias("p"), shown.alias("q")
    shared = sum((F.bit_count(F.col(f"p.{b}").bitwiseAND(F.col(f"q.{b}"))) for b in bits[1:]), F.bit_count(F.col("p.b0").bitwiseAND(F.col("q.b0"))))
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.ball") < F.col("q.ball")) & (shared >= index.shared)).select(F.col("p.ball").alias("a"), F.col("q.ball").alias("b")).distinct()
    judged = written(_judged(written(pairs, "candidates"), balls, cosine), "judged")
    whole, part = judged.where("whole"), judged.where("NOT whole").select("a", "b")
    counted = written(_in_part(part, balled.select("ball", "node", "n", "u"), cosine), "in_part")

    links = whole.select("a", "b").unionByName(counted.select("a", "b").distinct())
    both = whole.select("a", "b").unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(balls.select(F.col("ball").alias("b"), "weight"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("weight").alias("beside"))
    roots = components(links).withColumnRenamed("node", "ball")
    named = written(balls.drop("u").join(beside, "ball", "left").join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("ball", (F.col("weight") - 1 + F.coalesce("beside", F.lit(0))).alias("base"), "component_id")
    own = counted.groupBy("node").agg(F.sum("links").alias("links"))
    label = balled.select("node", "ball").join(own, "node", "left").join(named, "ball").select("node", (F.col("base") + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    label = entries.select("node", F.col("v").alias("w")).join(label, "node").drop("node")
    found = rows.join(label, F.col("v") == F.col("w"), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
