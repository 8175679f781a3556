"""Sources of any shape to the document table, and its quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, chunk_text, snippet
from ..schemas import DOC


def to_documents(df: DataFrame, **columns: Column) -> DataFrame:
    """The eight columns of the document table: those given, by name; missing ones are null for date and empty otherwise."""
    out = []
    for field in DOC.fields:
        value = columns.get(field.name, F.lit(None)).cast(field.dataType)
        out.append((value if field.name == "date" else F.coalesce(value, F.lit(""))).alias(field.name))
    return df.select(*out)


def union_documents(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contract_documents(contracts: DataFrame) -> DataFrame:
    """Contract rows as documents: what is known in one line, and the whole row as JSON."""
    known = [F.nullif(F.col(c), F.lit("")) for c in ("ticker", "asset_class", "contract_size", "quote_currency")]
    whole = F.to_json(F.struct(*[F.col(c) for c in contracts.columns]))
    return to_documents(contracts, company=F.col("exchange"), title=F.col("product_name"), link=F.col("source_url"), snippet=F.concat_ws(" | ", *known), source=F.lower("exchange"), full_text=whole)


def chunked(docs: DataFrame, limit: int = 200) -> DataFrame:
    """One row per chunk of full_text, with chunk_ix and a snippet of the chunk."""
    rest = [c for c in docs.columns if c not in ("full_text", "snippet")]
    rows = docs.select(*rest, F.posexplode(chunk_text(F.col("full_text"))).alias("chunk_ix", "full_text"))
    return rows.withColumn("snippet", snippet(F.col("full_text"), limit)).select(*docs.columns, "chunk_ix")


def promoted(abstract: Column, status: Column, text: Column, least: int = 500) -> Column:
    """The text of a file that was read and is long enough, else the abstract."""
    return F.when((status == "ok") & (F.length(text) >= least), text).otherwise(F.coalesce(abstract, F.lit("")))


def quality_flags(text: Column, date: Column | None = None, year: Column | None = None) -> dict[str, Column]:
    """Marks of bad rows, by what the text shows alone."""
    t = F.coalesce(text, F.lit(""))
    words = F.size(ascii_words(t))
    flags = {
        "empty": F.trim(t) == "", "stub": words < 50, "markup": t.rlike(r"<(div|span|p|br|script|table)[ />]"), "entities": t.rlike(r"&(amp|lt|gt|nbsp|quot|#[0-9]+);"),
        "mojibake": t.rlike("Ã.|â€|�"), "paywall": F.lower(t).rlike("subscribe to (continue|read)|sign in to read|already a subscriber"), "truncated": t.rlike(r"(\.\.\.|…)\s*\z"),
        "boilerplate": F.lower(t).rlike("all rights reserved|cookie policy|terms of (use|service)"),
    }
    if date is not None and year is not None:
        flags["date_mismatch"] = F.coalesce(F.year(date) != year, F.lit(False))
    return flags


def two_tiers(blob: Column, title: Column, topic: str, field: str, off: str, strict: str, institutional: str) -> tuple[Column, Column]:
    """(a, b): a by the whole text; b a subset of a, by the title alone."""
    has = lambda c, p: F.coalesce(F.lower(c).rlike(p), F.lit(False))
    a = has(blob, topic) & has(blob, field) & ~has(blob, off)
    return a, a & has(title, strict) & ~has(title, institutional)


# Formats that hold no text.
BINARY = ("geotiff", "netcdf", "grib", "hdf", "kml")


def source_bucket(form: Column, access: Column, kind: Column, binary: tuple[str, ...] = BINARY) -> Column:
    """excluded_paid, skip_binary, api_numeric or deep, by the first rule that holds."""
    f, a, k = (F.lower(F.coalesce(c, F.lit(""))) for c in (form, access, kind))
    raster = f.rlike("|".join(binary))
    readable = f.contains("pdf") | f.contains("html")
    return (
        F.when(a.contains("paid") & ~a.contains("free") & ~a.contains("mixed"), "excluded_paid").when(raster & ((k == "imagery") | ~readable), "skip_binary")
        .when(f.contains("api") & (k == "numeric") & ~readable & ~f.contains("web"), "api_numeric").otherwise("deep")
    )


def urls_in(field: Column) -> Column:
    """The http(s) addresses of a field that may hold several."""
    parts = F.transform(F.split(F.coalesce(field, F.lit("")), r"[;\s]+"), lambda x: F.regexp_replace(x, "^,+|,+$", ""))
    return F.filter(parts, lambda x: x.rlike("^https?://"))
