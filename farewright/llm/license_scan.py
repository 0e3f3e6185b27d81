"""Licence scan: whole texts against known licences, by the digest of a canonical form.

The canonical form has A-Z lower-cased, copyright lines, bullets and punctuation gone, and
equivalent spellings made one. Texts that agree in it are the same licence; the lookup is one
hash join on SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewright.llm.license_texts import PHRASES, WORDS, forms
from farewright.llm.shared import fresh, lower_ascii

#: Digest lists of no more rows are broadcast; longer ones are joined by shuffle.
MAX_BROADCAST_DIGESTS = 100_000
#: A line that states a copyright: the word with (c), a sign, a year or a blank to fill in, or the
#: sign alone; and a line that only reserves all rights.
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n\x{80}-\x{10FFFF}]*((copyright[ \t]+(\(c\)|\x{A9}|&copy;|[0-9]{4}|<|\[|\{)|\(c\)[ \t]+|\x{A9})[^\n]*|all rights reserved[. \t]*(\n|$))")
BULLET = r"(^|\n)[ \t]*([0-9]{1,2}[.)]|[a-z][.)]|[-*+]|\x{2022})[ \t]+"
#: What words are not made of.
PUNCTUATION = r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{BF}\x{2000}-\x{206F}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text: its words, one space between; empty for null."""
    t = lower_ascii(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    t = F.regexp_replace(t, BULLET, "\n")
    t = F.btrim(F.regexp_replace(t, PUNCTUATION, " "))
    same = F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair))
    words = F.transform(F.split(t, " "), lambda w: F.when(w.isin(*WORDS), F.try_element_at(same, w)).otherwise(w))
    t = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    for old, new in PHRASES.items():
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.btrim(F.replace(t, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, license): of each known text in each of its forms. more: (license, text), texts of the user's
    own; those that are null or without a word are left out."""
    rows = spark.createDataFrame(forms(), "license string, text string")
    if more is not None:
        rows = rows.unionByName(more.select("license", "text"))
    named = rows.where("license IS NOT NULL").select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return named.select(F.sha2("form", 256).alias("digest"), "license").distinct()


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """docs and three columns: digest (of the canonical form), n_words (of it) and license (null if
    the whole text is none that is known).

    Null and empty texts, and texts of punctuation or copyright lines alone, have no words and match
    nothing. If known has several licences for a digest, the least name is given. Repeated rows each
    get the same answer; added columns take other names if docs has columns of these names."""
    digest, n, name, form, key = fresh(docs, "digest", "n_words", "license", "canonical", "known_digest")
    named = known.groupBy("digest").agg(F.min("license").alias(name)).withColumnRenamed("digest", key)
    if named.count() <= MAX_BROADCAST_DIGESTS:
        named = F.broadcast(named)
    out = docs.withColumn(form, canonical(F.col(text)))
    out = out.withColumn(n, F.when(F.col(form) == "", 0).otherwise(F.size(F.split(form, " "))).cast("long")).withColumn(digest, F.sha2(form, 256)).drop(form)
    return out.join(named, (F.col(digest) == F.col(key)) & (F.col(n) > 0), "left").drop(key)
