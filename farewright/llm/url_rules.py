"""URL filters by rule lists of any length.

A rule is a host and the start of a path. A URL's host is expanded into its suffixes of the numbers of
labels that rules have, and its path into its prefixes of the lengths that rules have; each pair is an
expression. Expressions meet rules
by an equi-join on the first bytes of their digests; the whole digest then confirms, and the longest
rule decides.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.llm.shared import fresh, lower_ascii, written

#: Hex digits of a digest that the join goes by.
SHORT = 8
#: Rule lists of no more rows are broadcast; longer ones are joined by shuffle.
MAX_BROADCAST_RULES = 100_000
#: So many pairs of label count and path length are looked up in one pass over the URLs.
PASS_SHAPES = 4096
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    """Host and path, with a byte between that no host has."""
    return F.sha2(F.concat_ws("/\n", host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages and four columns: host, path, rule (host and path of the rule that decides; null if
    none fits) and verdict (the rule's, or the default).

    A rule fits its host and all subdomains of it, if the path starts with the rule's. The longest
    host and path wins, then the longest host, then block. A null URL, or one without ://, has empty
    host and path, and no rule. Each different URL is judged once, so one URL on many rows costs
    little; repeated rows stay. Rules may repeat; those with a null host or path fit nothing. Added
    columns take other names if pages has columns of these names."""
    ruled = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host is not null and rule_path is not null").distinct()
    ruled = written(ruled.select("*", _digest(F.col("rule_host"), F.col("rule_path")).alias("digest")), "rules")
    shapes = sorted(tuple(r) for r in ruled.select(F.size(F.split("rule_host", r"\.")), F.length("rule_path")).distinct().collect())
    urls = pages.select(F.col(url).alias("url")).where("url is not null").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).where("h <> ''")
    expressions = None
    for k in range(0, len(shapes) or 1, PASS_SHAPES):
        pairs = F.from_json(F.lit(json.dumps([{"n": n, "cut": cut} for n, cut in shapes[k : k + PASS_SHAPES]])), "array<struct<n: int, cut: int>>")
        fit = F.filter(pairs, lambda s: (s["n"] <= F.size(F.split("h", r"\."))) & (s["cut"] <= F.length("p")))
        one = parts.select("url", F.explode(F.transform(fit, lambda s: _digest(F.call_function("substring_index", F.col("h"), F.lit("."), -s["n"]), F.substring("p", F.lit(1), s["cut"])))).alias("digest"))
        expressions = one if expressions is None else expressions.unionByName(one)
    expressions = expressions.withColumn("short", F.substring("digest", 1, SHORT))
    keyed = ruled.withColumn("short", F.substring("digest", 1, SHORT)).withColumnRenamed("digest", "whole")
    if ruled.count() <= MAX_BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    met = expressions.join(keyed, "short").where(F.col("digest") == F.col("whole"))
    size = F.length("rule_host") + F.length("rule_path")
    order = F.struct(size, F.length("rule_host"), (F.col("verdict") == "block").alias("b"), "verdict")
    best = met.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best"))
    host, path, rule, verdict, held = fresh(pages, "host", "path", "rule", "verdict", "judged")
    best = best.select(F.col("url").alias(held), F.col("best.rule").alias(rule), F.col("best.verdict").alias(verdict))
    out = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url))).join(best, F.col(url) == F.col(held), "left").drop(held)
    return out.withColumn(verdict, F.coalesce(verdict, F.lit(default)))
