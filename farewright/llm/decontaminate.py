"""Benchmark decontamination by a distributed positional inverted index.

Training texts become postings (term, document, positions) of every term that the benchmark uses,
written as a table. A benchmark window is looked up from its two rarest terms: their lists, shifted
by the terms' offsets in the window, are intersected on the start position. What is left is
intersected with the lists of the other terms. With slop 0 that is the exact phrase; with slop s,
each term may stand up to s words from its place (a proximity match).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewright.llm.shared import lower_ascii, written

WINDOW = 10
#: So many distinct benchmark terms go to the tasks at once; more are taken in blocks, with one pass
#: over the documents for each block.
MAX_TERMS = 1_000_000
#: So many rows of windows or candidate documents at most are broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Words gathered in a task before postings are handed on.
FLUSH_WORDS = 1 << 21
#: Words are runs of anything but ASCII that is neither digit nor letter; A-Z count as a-z.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

POSTINGS = "array<int>"


def words(text):
    """The words of a text column; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(wid, item, len, words) of each distinct window of each item: size consecutive words, or all
    of a shorter item. Items without words have none. A null item_id reads as an empty string."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    cut = items.where(n > 0).select("item", "w", F.explode(starts).alias("at")).select("item", F.expr(f"slice(w, at, {size})").alias("words"))
    return cut.select(F.xxhash64("words").alias("wid"), "item", F.size("words").alias("len"), "words").distinct()


def _post(batches, ids: dict[bytes, int], hashes: np.ndarray, schema: pa.Schema, heads: bool):
    """Postings of each batch of (d, th, id, text); heads: also a row for each document."""

    def posted(keys, parts):
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
        term = np.concatenate(parts)
        known = np.flatnonzero(term >= 0)
        doc, at, term = doc[known], at[known], term[known]
        order = np.argsort(doc * len(hashes) + term, kind="stable")
        doc, at, term = doc[order], at[order], term[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)], pa.int32()), pa.array(at))
        own = pa.array(doc[first])
        return pa.RecordBatch.from_arrays(
            [keys[0].take(own), keys[1].take(own), pa.nulls(len(first), schema.field("id").type),
             pa.array(hashes[term[first]]), lists, pa.nulls(len(first), pa.int64())], schema=schema)

    for batch in batches:
        d, th, own, texts = batch.columns
        sizes, parts, start, held = [], [], 0, 0
        for k in range(len(batch)):
            found = (texts[k].as_py() or b"").translate(_WORD_BYTES).split()
            sizes.append(len(found))
            parts.append(np.fromiter(map(ids.get, found, repeat(-1)), np.int64, len(found)))
            held += len(found)
            if held >= FLUSH_WORDS or k == len(batch) - 1:
                yield posted((d[start : k + 1], th[start : k + 1]), parts)
                parts, start, held = [], k + 1, 0
        if heads and len(batch):
            n = len(batch)
            empty = pa.array([[]] * n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([d, th, own, pa.nulls(n, pa.int64()), empty, pa.array(sizes, pa.int64())], schema=schema)


def told_apart(rows: DataFrame, name: str) -> int:
    """The number of rows, all of which must have a name of their own. Words of documents are compared
    with those of the benchmark as they are, and 64-bit names stand only for what is told apart here."""
    n, names = rows.agg(F.count("*"), F.count_distinct(name)).first()
    if n != names:
        raise ValueError(f"two rows of the benchmark have one {name}: their 64-bit hashes are equal")
    return n


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, th: hashes of id and text, 128 bits together, that stand for a row; rows that agree in
    both are alike in every answer."""
    return docs.select(F.xxhash64(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("utf8"))


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """The written index over whole texts: (d, th, id, term, positions, n_words). A posting row has
    term and positions (0-based, rising); a head row for each input row has id and n_words.
    terms: one column of distinct words."""
    spark = docs.sparkSession
    (word,) = terms.columns
    coded = written(terms.select(F.col(word).alias("word"), F.xxhash64(word).alias("term")), "terms")
    n = told_apart(coded, "term")
    source = keyed(docs, doc_id, text)
    schema = T.StructType([
        T.StructField("d", T.LongType()), T.StructField("th", T.LongType()), T.StructField("id", source.schema["id"].dataType),
        T.StructField("term", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("n_words", T.LongType())])
    parts = []
    for block in range(blocks := max(1, -(-n // max_terms))):
        rows = coded.where(F.pmod("term", F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(rows)}, np.array([r["term"] for r in rows], np.int64)))

        def run(batches, sent=sent, heads=block == 0):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
            arrow = arrow.set(4, pa.field("positions", pa.list_(pa.int32())))
            yield from _post(batches, *sent.value, arrow, heads)

        parts.append(source.mapInArrow(run, schema))
    index = parts[0]
    for p in parts[1:]:
        index = index.unionByName(p)
    return written(index, "postings")


def _bounded(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a written table of no more than so many rows; else the table as it is."""
    return F.broadcast(df) if df.count() <= most else df


def matches(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """(d, th, wid, start, len): where windows occur. wanted: wid, len, words, distinct by wid.
    start is that of the window as its rarest term places it."""
    posts = index.where(F.col("term").isNotNull()).select("d", "th", "term", "positions")
    seen = posts.groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
    spots = wanted.select("wid", "len", F.posexplode("words").alias("off", "word")).select("wid", "len", "off", F.xxhash64("word").alias("term"))
    ranked = spots.join(seen, "term").groupBy("wid", "len").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("by_n"))
    ranked = written(ranked.where(F.size("by_n") == F.col("len")), "ranked")
    anchors = written(ranked.select("wid", F.least("len", F.lit(2)).alias("need"), F.posexplode(F.slice("by_n", 1, 2)).alias("rank", "a"))
                      .select("wid", "need", "rank", "a.off", "a.term"), "anchors")
    hits = posts.join(_bounded(anchors), "term").select("d", "th", "wid", "need", "rank", F.explode("positions").alias("at"), "off")
    shift = F.sequence(F.lit(-slop), F.lit(slop)) if slop else F.array(F.lit(0))
    starts = hits.select("d", "th", "wid", "need", "rank", F.explode(F.transform(
        F.when(F.col("rank") == 0, F.array(F.lit(0))).otherwise(shift), lambda s: F.col("at") - F.col("off") + s)).alias("start"))
    both = starts.groupBy("d", "th", "wid", "need", "start").agg(F.bit_or(F.col("rank") + 1).alias("got"))
    found = both.where((F.col("start") >= 0) & (F.col("got") == F.when(F.col("need") == 2, 3).otherwise(1))).select("d", "th", "wid", "start")
    found = written(found.join(_bounded(ranked), "wid").select("d", "th", "wid", "start", "len", F.slice("by_n", F.lit(3), F.greatest(F.col("len") - 2, F.lit(0))).alias("rest")), "found")
    whole = found.where("len <= 2").select("d", "th", "wid", "start", "len")
    asked = found.where("len > 2").select("d", "th", "wid", "start", "len", F.explode("rest").alias("r")).select(
        "d", "th", "wid", "start", "len", "r.term", (F.col("start") + F.col("r.off")).alias("at"))
    holders = written(found.select("d", "th").distinct(), "holders")
    near = posts.join(_bounded(holders), ["d", "th"], "left_semi")
    there = F.exists("positions", lambda p: F.abs(p - F.col("at")) <= slop)
    kept = asked.join(near, ["d", "th", "term"]).where(there).groupBy("d", "th", "wid", "start", "len").agg(F.size(F.collect_set("at")).alias("k"))
    return whole.unionByName(kept.where("k = len - 2").drop("k"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """(d, th, doc_id, n_words, n_hit, items): for each row of docs its words, the words inside any
    occurrence of a benchmark window, and the sorted distinct ids (strings) of items with one.

    Null texts have no words; an empty or wordless item has no window; an item shorter than a window
    is one window. Windows that several items share count for each. Repeated rows of docs each get
    the same answer; an item_id on several rows is one item. No rows give no rows; with an empty
    benchmark nothing is hit. Other columns are left out, so their names do not matter."""
    cut = written(windows(benchmark, item_id, item_text, size), "windows")
    terms = cut.select(F.explode("words").alias("word")).distinct()
    index = build_index(docs, terms, doc_id, text)
    wanted = written(cut.select("wid", "len", "words").distinct(), "wanted")
    told_apart(wanted, "wid")
    found = written(matches(index, wanted, slop), "matches")
    from pyspark.sql import Window

    by_start = Window.partitionBy("d", "th").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("d", "th", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    fresh_words = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(by_start), F.lit(0))))
    hit = spans.withColumn("new", fresh_words).groupBy("d", "th").agg(F.sum("new").cast("long").alias("n_hit"))
    items = (found.select("d", "th", "wid").distinct().join(cut.select("wid", "item"), "wid").groupBy("d", "th")
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    heads = index.where(F.col("n_words").isNotNull()).select("d", "th", F.col("id").alias("doc_id"), "n_words")
    judged = hit.join(items, ["d", "th"])
    none = F.array().cast("array<string>")
    return heads.join(judged, ["d", "th"], "left").select(
        "d", "th", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
