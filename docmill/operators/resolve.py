"""Lookups with precedence: identifiers, names, files, and what remains after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_title
from .select import keep_first


def by_identifier(rows: DataFrame, listings: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` (ticker, isin) with resolved and cik: an ISIN wins outright, else the ticker; only what ``registry`` (ticker, cik) knows counts.

    ``listings`` is (isin, ticker, preferred, seq): the preferred kind first, else the first.
    """
    pick = listings.groupBy("isin").agg(F.min_by("ticker", F.struct((~F.col("preferred")).alias("p"), "seq")).alias("_listed"))
    known = registry.groupBy(F.upper("ticker").alias("_t")).agg(F.min("cik").alias("cik"))
    there = F.coalesce(F.col("isin"), F.lit("")) != ""
    wanted = rows.join(pick, "isin", "left").withColumn("_want", F.when(there, F.upper("_listed")).otherwise(F.upper("ticker")))
    return wanted.join(known, F.col("_want") == F.col("_t"), "left").withColumn("resolved", F.col("_t")).drop("_listed", "_want", "_t")


def by_code_or_name(companies: DataFrame, filings: DataFrame) -> DataFrame:
    """(company key columns, filing): filings whose code, whole or its first four, is the ticker; names only where no code meets.

    Both sides are made distinct before they meet, so pairs, which may be many more than rows, are not moved again.
    """
    codes = filings.select("filing", F.explode(F.array_distinct(F.array("sec_code", F.substring("sec_code", 1, 4)))).alias("ticker")).filter("ticker <> ''").distinct()
    first = companies.select("company", "ticker").distinct().join(codes, "ticker").select("company", "ticker", "filing")
    rest = companies.join(codes.select("ticker"), "ticker", "left_anti")
    second = rest.join(filings.select("filing", F.col("filer_name").alias("company")), "company").select("company", "ticker", "filing")
    return first.unionByName(second)


def exact_else_first(hits: DataFrame, key: str, wanted: str, found: str, seq: str) -> DataFrame:
    """One hit per key: a title equal but for case, else the first."""
    return keep_first(hits, [key], [(F.lower(found) != F.lower(wanted)), F.col(seq)])


def by_title(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """``cited`` (title) with doc_id of the last corpus row of the same normalised title."""
    last = corpus.groupBy(normal_title(F.col("title")).alias("_k")).agg(F.max("doc_id").alias("doc_id"))
    return cited.withColumn("_k", normal_title(F.col("title"))).join(last, "_k", "left").drop("_k")


def first_source(parts: list[DataFrame], key: str, value: str, seq: str) -> DataFrame:
    """(key, value): of several maps the first that has a key, and of that its first row."""
    every = None
    for i, part in enumerate(parts):
        one = part.select(key, value, F.lit(i).alias("_part"), F.col(seq).alias("_seq"))
        every = one if every is None else every.unionByName(one)
    return keep_first(every, [key], [F.col("_part"), F.col("_seq")]).select(key, value)


def ids_of_sources(parts: list[DataFrame], fallback: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """(id, source) of all parts, each once in order of the sources; the fallback only where all of them are empty."""
    every = None
    for i, part in enumerate(parts):
        one = part.select(key, F.lit(i).alias("source"), F.col(seq).alias("_seq"))
        every = one if every is None else every.unionByName(one)
    none = every.agg((F.count(F.lit(1)) == 0).alias("_none"))
    spare = fallback.select(key, F.lit(len(parts)).alias("source"), F.col(seq).alias("_seq")).join(F.broadcast(none), F.col("_none")).drop("_none")
    return keep_first(every.unionByName(spare), [key], [F.col("source"), F.col("_seq")]).select(key, "source")


def recovered(wanted: DataFrame, fetched: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """``fetched`` and, for what is wanted and not fetched, the cached rows, marked."""
    missing = wanted.select(key).join(fetched.select(key), key, "left_anti")
    from_cache = missing.join(cache, key).withColumn("from_cache", F.lit(True))
    return fetched.withColumn("from_cache", F.lit(False)).unionByName(from_cache, allowMissingColumns=True)


def retry(failures: DataFrame, most: int = 3) -> DataFrame:
    """(url, n, again): failures of each URL, and whether it is to be tried again."""
    return failures.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumn("again", F.col("n") < most)


def coalesced(*columns: Column) -> Column:
    """The first that is neither null nor empty; empty if none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))

