"""Eleven checks of a corpus: eight by what a row shows alone, three by what others show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_hash
from .reshape import quality_flags

#: A listing named in running text: the exchange, then the ticker.
LISTING = r"\((?:NYSE|NASDAQ|Nasdaq|AMEX|TSX|LSE|OTC)[A-Za-z ]*:\s*([A-Z][A-Z.]{0,5})\)"
#: Copies of each common line, one per salt, so that many tasks meet a line that a third of all rows hold.
SALTS = 16
CHECKS = ("empty", "stub", "markup", "entities", "mojibake", "paywall", "truncated", "date_mismatch", "ticker_mismatch", "cross_ticker", "boilerplate")


def boilerplate_share(docs: DataFrame, seq: str, text: str, least: int) -> DataFrame:
    """(seq, share): of a text's characters (without white space around lines), those in lines that ``least`` documents hold; no row for texts without lines."""
    line = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line")
    lines = docs.select(F.col(seq).alias("id"), line).withColumn("line", F.trim("line")).filter("line <> ''")
    mine = lines.groupBy("id", F.xxhash64("line").alias("h")).agg(F.sum(F.length("line")).alias("n"))
    common = mine.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    common = common.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("common"))
    met = mine.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(common, ["h", "salt"], "left")
    share = F.sum(F.when(F.col("common"), F.col("n")).otherwise(0)) / F.sum("n")
    return met.groupBy("id").agg(share.alias("share")).withColumnRenamed("id", seq)


def quality_suite(docs: DataFrame, seq: str = "doc_id", text: str = "text", ticker: str = "ticker", date: str = "date", year: str = "year", least: int = 5, most: float = 0.5) -> DataFrame:
    """(seq, and a boolean per check): what is wrong with each row of (seq, text, ticker, date, year); seq has to be unique.

    ticker_mismatch: the text names listings and the row's ticker is none of them.
    cross_ticker: rows of another ticker have the same content (blank texts have none).
    boilerplate: more than ``most`` of the text lies in lines that ``least`` documents hold.
    Nulls pass every check but empty and stub.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flags = quality_flags(F.col(text), F.col(date), F.col(year))
    named = F.regexp_extract_all(t, F.lit(LISTING), F.lit(1))
    flags["ticker_mismatch"] = F.coalesce((F.size(named) > 0) & ~F.array_contains(named, F.upper(F.col(ticker))), F.lit(False))
    key = F.when(F.trim(t) != "", content_hash(t))
    rows = docs.select(F.col(seq), F.col(ticker).alias("_ticker"), key.alias("_key"), *[flags[c].alias(c) for c in CHECKS if c in flags and c != "boilerplate"])
    shared = rows.filter("_key IS NOT NULL").groupBy("_key").agg((F.min("_ticker") != F.max("_ticker")).alias("_many")).filter("_many").select("_key", F.lit(True).alias("cross_ticker"))
    share = boilerplate_share(docs, seq, text, least)
    out = rows.join(shared, "_key", "left").join(share, seq, "left")
    out = out.withColumn("cross_ticker", F.coalesce("cross_ticker", F.lit(False))).withColumn("boilerplate", F.coalesce(F.col("share") > most, F.lit(False)))
    return out.select(seq, *CHECKS)


def check_counts(flags: DataFrame) -> DataFrame:
    """(check, n): rows that each check finds."""
    one = flags.agg(*[F.count_if(c).alias(c) for c in CHECKS])
    return one.unpivot([], list(CHECKS), "check", "n")
