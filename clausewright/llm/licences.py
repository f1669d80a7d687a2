"""Licence scans by canonical digests.

A text is lower-cased, loses its copyright lines and rights-reserved lines, keeps only letters, digits and line ends, and takes one
of each pair of equivalent spellings; the digest of what is left, line ends aside, is hash-joined to the digests of known texts, so
case, punctuation, wrapping and layout make no difference. Each line is looked up in the same way among one-line notices, a fixed
list of a dozen digests that is part of the expression. All of it is built-in functions over a scan; the known texts are a list of
at most KNOWN, so they are the side that is broadcast, and a longer list is joined by a shuffle of digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read
from clausewright.llm.licence_texts import NOTICES, SPELLINGS, TEXTS

#: A line that is a copyright notice: the word or sign, maybe after "portions", and then a sign, a year, a placeholder or "by", or up to
#: six words of a name and one that ends a holder's name, such as inc. or foundation; not one that goes on about copyright holders.
COPYRIGHT = r"(?md)^[^a-z0-9©(\n]*((portions[\x20\t]+|some parts[\x20\t]+)?(copyright|copr)[\x20\t:.,]*(\(c\)|©|&copy;|by\x20|[0-9<\[{]|year|(the[\x20\t]+)?([^\x20\t\n,]+[\x20\t,]+){1,6}(inc|llc|ltd|gmbh|corp|corporation|foundation|et al|authors|other contributors|https?:)\b)|\(c\)[\x20\t]*(copyright|[0-9<\[{])|©)[^\n]*"
RIGHTS = r"(?md)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Known texts that are broadcast, as a digest and a name each; notices that are part of the expression.
KNOWN, NOTICES_MOST = 100_000, 2_000


def spelt(text: Column) -> Column:
    """Text of words with single spaces between, and line ends, in which whole words, never parts of one, take the spelling that stands for all."""
    wide = F.replace(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n "))
    wide = reduce(lambda c, s: F.replace(c, *[F.lit(f" {x} ".replace(" ", "  ")[1:-1]) for x in s]), SPELLINGS, F.concat(F.lit(" "), wide, F.lit(" ")))
    return F.trim(F.regexp_replace(wide, " +", " "))


def canonical_lines(text: Column) -> Column:
    """The lines that are left of a text, none empty; null for null."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), RIGHTS, "")
    return F.array_remove(F.transform(F.split(spelt(F.regexp_replace(t, PUNCTUATION, " ")), "\n"), lambda x: F.trim(x)), "")


def canonical(lines: Column) -> Column:
    """The lines as one, in which runs of words that a line end parted are spelt alike too."""
    return spelt(F.array_join(lines, " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(known, "license string, text string").withColumn("text", canonical(canonical_lines(F.col("text"))))
    return rows.select("license", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text", texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, digest, license, notices of each row of docs.

    digest: SHA-256 of the canonical text; license: the known licence with that digest, or null; notices: the licences that lines
    name, without repeats, in the order of their names. A null text counts as empty. An empty text has the digest of the empty
    string and no licence. Null and repeated doc_ids stay; other columns are left out."""
    if len(notices) > NOTICES_MOST:
        raise ValueError(f"{len(notices)} notices; an expression takes at most {NOTICES_MOST}")
    lines = docs.select("doc_id", canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    named = F.create_map(*[F.lit(x) for r in known_digests(docs.sparkSession, notices).collect() for x in (r["digest"], r["license"])])
    hits = F.transform(F.array_distinct(F.transform("lines", lambda x: F.sha2(x, 256))), lambda d: F.try_element_at(named, d))
    found = F.sort_array(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))
    whole = lines.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), found.alias("notices"))
    known = known_digests(docs.sparkSession, texts)
    return whole.join(F.broadcast(known) if len(texts) <= KNOWN else known, "digest", "left").select("doc_id", "digest", "license", "notices")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))
