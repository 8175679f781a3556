"""The public pipelines: landed tables in, document tables and reports out.

Each is a function of DataFrames, so it composes with any reader; ``python -m docmill``
runs them from the command line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions import transcripts
from .functions.keys import bare_host, content_hash, url_hash
from .functions.pages import extraction
from .operators import filters, reshape
from .operators.select import keep_first
from .sinks import files as sinks


@dataclass(frozen=True)
class Config:
    """What the funnel from pages to documents keeps."""

    min_words: int = 100
    first_date: str | None = None
    last_date: str | None = None
    two_passes: bool = True
    ticker_pages: bool = False
    profile_pages: bool = False

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


#: Named variants of a configuration.
PRESETS: dict[str, Callable[[Config], Config]] = {"plain": lambda c: c, "strict": lambda c: c.with_(min_words=max(c.min_words, 200)), "lenient": lambda c: c.with_(min_words=min(c.min_words, 30), ticker_pages=True, profile_pages=True)}


def page_text(html: F.Column) -> F.Column:
    raw = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(raw, r"[ \t\n\r\f\x0B]+", " "))


def documents(pages: DataFrame, excluded: DataFrame | None = None, known: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Pages (page_id, url, html and, if there, query, title, date) to the document table.

    In order: excluded domains, URLs known or seen before, pages without text (of two passes,
    or of all between tags), too few words, quote and profile pages, dates outside the range (unreadable ones stay), contents seen before.
    """
    rows = pages.withColumn("_key", url_hash(F.col("url")))
    if excluded is not None:
        rows = filters.without_domains(rows, excluded)
    if known is not None:
        rows = rows.join(known.select(url_hash(F.col("url")).alias("_key")).distinct(), "_key", "left_anti")
    rows = keep_first(rows, ["_key"], [F.col("page_id")])
    if config.two_passes:
        rows = rows.withColumn("_page", extraction(F.col("html"), config.min_words)).filter(F.col("_page.method") != "failed")
        rows = rows.withColumn("_text", T.clean(F.col("_page.text"))).withColumn("_title", F.nullif("_page.title", F.lit("")))
    else:
        rows = rows.withColumn("_text", T.clean(page_text(F.col("html")))).withColumn("_title", F.lit(None).cast("string"))
    rows = rows.filter(T.word_count(F.col("_text")) >= config.min_words)
    if not config.ticker_pages:
        rows = rows.filter(~filters.is_ticker_page(F.col("_text")))
    if not config.profile_pages:
        rows = rows.filter(~filters.is_profile_page(F.col("_text")))
    given = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    if "date" in pages.columns and (config.first_date or config.last_date):
        rows = rows.filter(filters.date_outcome(F.col("date"), config.first_date, config.last_date) != "outside")
    rows = keep_first(rows, [content_hash(F.col("_text"))], [F.col("page_id")])
    return reshape.to_documents(rows, company=given("query"), title=F.coalesce(F.nullif(given("title"), F.lit("")), F.col("_title")), link=F.col("url"), snippet=T.snippet(F.col("_text")), date=T.lenient_date(given("date")), source=bare_host(F.col("url")), full_text=F.col("_text"))


def transcript_documents(pages: DataFrame) -> DataFrame:
    """Transcript pages (url, html) to documents: company is the ticker; addresses without a quarter are no transcripts."""
    rows = pages.select("url", transcripts.from_address(F.col("url")).alias("a"), transcripts.parsed_page("html").alias("p")).filter("a IS NOT NULL")
    text = F.concat_ws("\n", F.nullif("p.prepared", F.lit("")), F.nullif("p.questions", F.lit("")))
    title = F.concat_ws(" ", "a.ticker", "a.quarter", F.col("a.year").cast("string"))
    return reshape.to_documents(rows, company=F.col("a.ticker"), title=title, link=F.col("url"), snippet=T.snippet(text), date=F.col("a.pub_date"), source=F.lit("transcripts"), full_text=text)


def report(docs: DataFrame) -> DataFrame:
    """(company, first, n, body): a Markdown section per company, in order of first appearance of its link."""
    article = sinks.markdown_article(F.col("title"), F.col("source"), F.col("link"), F.date_format("date", "yyyy-MM-dd"), F.col("full_text"), level=3)
    return sinks.markdown_groups(docs, "company", "link", article)


def head(docs: DataFrame, limit: int = 20) -> tuple[DataFrame, int]:
    """The first rows by link, and how many there are."""
    return docs.orderBy("link").limit(limit), docs.count()
