"""Row predicates and the stage funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import base_domain, content_hash, host
from ..functions.text import lenient_date

# What marks quote pages and index profiles.
TICKER = (r"(?i)52\s+week\s+(range|high|low)", r"(?i)EPS\s*\(TTM\)", r"(?i)P/E\s*\(TTM\)", r"(?i)Prev(ious)?\s*Close")
TICKER_LEAST = 3
PROFILE = (r"(?i)Nature\s+Index", r"(?i)Collaboration\s+Score")


def is_ticker_page(text: Column) -> Column:
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in TICKER), F.lit(0)) >= TICKER_LEAST


def is_profile_page(text: Column) -> Column:
    return F.coalesce(text.rlike(PROFILE[0]) & text.rlike(PROFILE[1]), F.lit(False))


def date_outcome(value: Column, first: str | None, last: str | None) -> Column:
    """inside, outside or unparseable; only what is outside is to be dropped."""
    d = lenient_date(value)
    inside = (d >= F.to_date(F.lit(first)) if first else F.lit(True)) & (d <= F.to_date(F.lit(last)) if last else F.lit(True))
    return F.when(d.isNull(), "unparseable").when(inside, "inside").otherwise("outside")


def without_domains(df: DataFrame, excluded: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is not in ``excluded`` (domain), nor its last two labels if it has more."""
    h = host(F.col(url))
    first = df.join(excluded, h == excluded["domain"], "left_anti")
    return first.join(excluded, (F.size(F.split(h, r"\.")) > 2) & (base_domain(h) == excluded["domain"]), "left_anti")


def funnel(df: DataFrame, stages: list[tuple[str, Column]], text: str, seq: str) -> DataFrame:
    """``df`` with outcome: the first stage whose condition holds, else duplicate or kept.

    A duplicate shares its first 2000 characters with an earlier row; the first rows of all
    contents are found by an aggregation, so a hot content is no hot task.
    """
    chain = None
    for name, drop in stages:
        drop = F.coalesce(drop, F.lit(False))
        chain = F.when(drop, name) if chain is None else chain.when(drop, name)
    marked = df.withColumn("_stage", chain).withColumn("_hash", content_hash(F.col(text)))
    firsts = marked.groupBy("_hash").agg(F.min(seq).alias("_first"))
    out = marked.join(firsts, marked["_hash"].eqNullSafe(firsts["_hash"]), "left")
    return out.withColumn("outcome", F.coalesce("_stage", F.when(F.col(seq) > F.col("_first"), "duplicate").otherwise("kept"))).select(*df.columns, "outcome")


def rule(form: str, t: dict[str, Column]) -> Column:
    """Relevance rules over named conditions; ``off`` marks what is off topic."""
    return {
        "and": lambda: t["a"] & t["b"],
        "and_not": lambda: t["a"] & t["b"] & ~t["off"],
        "strong_weak": lambda: ((t["a"] & t["c"]) | (t["b"] & t["d"])) & ~t["off"],
        "context": lambda: (t["a"] | ((t["b"] | (t["c"] & t["d"])) & t["e"])) & ~t["off"],
        "rescue": lambda: t["a"] & t["b"] & (~t["off"] | t["title"]),
        "core": lambda: t["a"] & t["b"] & t["c"] & ~t["off"] & ~(t["d"] & ~t["e"]),
    }[form]()


def starts_with_any(codes: Column, prefixes: list[str]) -> Column:
    """Whether any code of an array starts with any prefix; null is false."""
    return F.coalesce(F.exists(codes, lambda c: F.array_contains(F.array(*[c.startswith(p) for p in prefixes]), True)), F.lit(False))
