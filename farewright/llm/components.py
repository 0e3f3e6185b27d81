"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Large: each u links its larger neighbours to the least of its neighbourhood;
    small: each u links itself and its smaller neighbours to the least of those.

    The least neighbour is an aggregate with map-side combine, so a hub with very many edges costs
    one row per task; the join that follows has only plain equality keys, which AQE can split."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two columns of one type, any order, repeats and self links allowed.
    Returns (node, root) for each node of a link between two different nodes; root is the least
    node of its component. Each round is written to the shared folder; rounds go on until nothing
    changes, which takes about the logarithm of the longest path."""
    a, b = links.columns
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now := (row["n"], row["h"])) == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
