"""Rows of five kinds of sources as one table of document chunks, with provenance beside it.

A reshaper takes the landed rows of a source and its id, and gives the eight document columns and
a provenance table: the link, the source, and what only that kind of source knows.  Columns
that a source may lack are empty, zero or false.  Chunking, dates and years come after, in one
place, for all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import mixed_timestamp
from ..functions.text import chunk_text
from ..schemas import DOC
from .reshape import to_documents

REGISTER = "https://find-and-update.company-information.service.gov.uk/company/"


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _value(df: DataFrame, name: str, kind: str, default: object) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)


def _date(df: DataFrame, name: str) -> Column:
    """Times stay as they are; text is read as it is written, null where it is no date."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    kind = df.schema[name].dataType.typeName()
    return F.col(name).cast("timestamp_ntz") if kind.startswith(("timestamp", "date")) else mixed_timestamp(F.nullif(F.col(name).cast("string"), F.lit("")))


def _provenance(df: DataFrame, link: Column, source: str, texts: tuple[str, ...] = (), **others: Column) -> DataFrame:
    return df.select(link.alias("link"), F.lit(source).alias("source_parquet"), *[_text(df, t).alias(t) for t in texts], *[c.alias(n) for n, c in others.items()])


def scraped(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have the document columns, or some of them; a canonical company wins, a missing source file is the source's own."""
    company = _text(df, "company")
    if "company_canonical" in df.columns:
        company = F.coalesce(F.nullif(F.col("company_canonical"), F.lit("")), company)
    file = F.coalesce(F.nullif(_text(df, "source_file"), F.lit("")), F.lit(source.rsplit("/", 1)[-1]))
    docs = to_documents(df, company=company, date=_date(df, "date"), source_file=file, **{c: _text(df, c) for c in ("title", "link", "snippet", "source", "full_text")})
    return docs, _provenance(df, _text(df, "link"), source)


def agency_filings(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows (company, form, filing_date, url, full_text; ticker, words): the title is form and date."""
    form = _text(df, "form")
    docs = to_documents(
        df, company=_text(df, "company"), title=F.concat(form, F.lit(" "), _text(df, "filing_date")), link=_text(df, "url"), date=_date(df, "filing_date"),
        source=F.concat(F.lit("SEC EDGAR "), form), full_text=_text(df, "full_text"), source_file=F.lit(source),
    )
    return docs, _provenance(df, _text(df, "url"), source, ("ticker", "form"), words=_value(df, "words", "long", 0))


def storage_filings(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the national storage mechanism; the company of the list, where it is null that of the hit."""
    company = F.coalesce(F.col("csv_company"), F.col("hit_company"), F.lit(""))
    docs = to_documents(
        df, company=company, title=_text(df, "headline"), link=_text(df, "download_url"), date=_date(df, "publication_date"), source=F.concat(F.lit("FCA NSM "), _text(df, "type_code")),
        full_text=_text(df, "full_text"), source_file=F.lit(source),
    )
    kept = ("hit_lei", "disclosure_id", "type_code", "type", "file_kind", "document_date")
    return docs, _provenance(df, _text(df, "download_url"), source, kept, lei=_text(df, "csv_lei"), file_size_mb=_value(df, "file_size_mb", "double", 0.0), words=_value(df, "words", "long", 0))


def register_filings(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the company register; the link is the company's history of filings."""
    number, kind = _text(df, "company_number"), _text(df, "filing_type")
    link = F.when(number == "", "").otherwise(F.concat(F.lit(REGISTER), number, F.lit("/filing-history")))
    docs = to_documents(
        df, company=_text(df, "company"), title=F.concat(kind, F.lit(" "), _text(df, "filing_date")), link=link, snippet=_text(df, "description"), date=_date(df, "filing_date"),
        source=F.concat(F.lit("Companies House "), kind), full_text=_text(df, "full_text"), source_file=F.lit(source),
    )
    more = {"pages": _value(df, "pages", "long", 0), "paper_filed": _value(df, "paper_filed", "boolean", False), "pdf_size_mb": _value(df, "pdf_size_mb", "double", 0.0), "words": _value(df, "words", "long", 0)}
    return docs, _provenance(df, link, source, ("company_number", "filing_type"), **more)


def one_site(df: DataFrame, source: str, company: str = "", site: str = "") -> tuple[DataFrame, DataFrame]:
    """Pages (title, url, text) of one site of one company, without dates."""
    docs = to_documents(df, company=F.lit(company), title=_text(df, "title"), link=_text(df, "url"), source=F.lit(site), full_text=_text(df, "text"), source_file=F.lit(source))
    return docs, _provenance(df, _text(df, "url"), source, words=_value(df, "words", "long", 0))


def merged(parts: list[tuple[Callable[..., tuple[DataFrame, DataFrame]], DataFrame, str]], snippet: int = 200) -> tuple[DataFrame, DataFrame]:
    """(chunks, provenance) of all parts (reshaper, rows, source id).

    Chunks have the document columns and chunk_ix; the snippet is the head of the chunk.
    """
    shaped = [reshaper(rows, source) for reshaper, rows, source in parts]
    docs = reduce(DataFrame.unionByName, [d for d, _ in shaped])
    rest = [F.col(c) for c in DOC.fieldNames() if c not in ("full_text", "snippet")]
    chunks = docs.select(*rest, F.posexplode(chunk_text("full_text")).alias("chunk_ix", "full_text")).withColumn("snippet", F.substring("full_text", 1, snippet))
    provenance = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for _, p in shaped])
    return chunks.select(*DOC.fieldNames(), "chunk_ix"), provenance
