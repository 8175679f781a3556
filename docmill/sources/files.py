"""Landed files as tables: lists, delimited files, JSON, XML, catalogues and archives.

Each reader is a thin ``spark.read`` call before a function from rows to rows, which also
works on text that is already in a table.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patents import IN_RESULT

_EDGE = r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a list, stripped; blank ones and comments are left out."""
    return lines.withColumn(column, strip(F.col(column))).filter((F.col(column) != "") & ~F.col(column).startswith("#"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.text(path))


def bare_domain(entry: Column) -> Column:
    """Lower case, without scheme and www., cut at the first slash."""
    return F.regexp_replace(F.replace(F.regexp_replace(F.lower(entry), "^https?://", ""), F.lit("www."), F.lit("")), "/[\\s\\S]*", "")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(domain): the distinct domains of an exclusion list, small enough to broadcast."""
    return read_list(spark, path).select(bare_domain(F.col("value")).alias("domain")).filter("domain <> ''").distinct()


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A file with a header, all columns strings, a byte order mark tolerated; ValueError names what is missing."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int | None = None, equals: tuple[str, str] | None = None) -> DataFrame:
    """Rows that match (column, value; trimmed, any case), without the first ``skip``, at most ``limit``."""
    if equals is not None:
        df = df.filter(F.upper(F.trim(F.col(equals[0]))) == equals[1].strip().upper())
    df = df.orderBy(*order).offset(skip)
    return df if limit is None else df.limit(limit)


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Named columns of a tab-separated file, all strings; empty ones are null."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"')
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


TARGETS = "targets array<struct<company:string,assignee:string,ids:array<string>,granted_only:boolean,limit:int>>, themes array<struct<company:string,assignee:string,ids:array<string>,granted_only:boolean,limit:int>>"


def targets(documents: DataFrame, column: str = "value", limit: int = 50) -> DataFrame:
    """(company, assignee, ids, granted_only, limit, theme) of JSON target files; fields that are not there take defaults."""
    parsed = documents.select("*", F.from_json(column, TARGETS).alias("_p"))
    kinds = [parsed.select(*documents.columns, F.explode(f"_p.{k}").alias("t"), F.lit(k == "themes").alias("theme")) for k in ("targets", "themes")]
    t = kinds[0].unionByName(kinds[1])
    none = F.array().cast("array<string>")
    fields = [F.coalesce("t.company", F.lit("")).alias("company"), F.coalesce("t.assignee", "t.company", F.lit("")).alias("assignee"), F.coalesce("t.ids", none).alias("ids")]
    return t.select(*[c for c in documents.columns if c != column], *fields, F.coalesce("t.granted_only", F.lit(False)).alias("granted_only"), F.coalesce("t.limit", F.lit(limit)).alias("limit"), "theme")


def from_parallel_arrays(df: DataFrame, arrays: list[str]) -> DataFrame:
    """One row per place of arrays that run side by side."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*rest, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def cluster_ids(json: Column) -> Column:
    """Patent numbers in results.cluster[].result[].id, in order, each once."""
    kind = "results struct<cluster:array<struct<result:array<struct<id:string>>>>>"
    flat = F.flatten(F.transform(F.from_json(json, kind)["results"]["cluster"], lambda c: F.transform(c["result"], lambda r: F.regexp_extract(r["id"], IN_RESULT, 1))))
    return F.array_distinct(F.filter(flat, lambda x: x != ""))


def sitemap_locations(xml: Column) -> Column:
    """The locations of a sitemap or sitemap index, whatever its namespace."""
    return F.xpath(xml, F.lit('//*[local-name()="loc"]/text()'))


def robots_sitemaps(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(*[c for c in lines.columns if c != column], F.regexp_extract(column, r"^(?i)\s*sitemap:\s*(\S+)", 1).alias("sitemap")).filter("sitemap <> ''")


def feed_entry(xml: Column) -> list[Column]:
    """id, title, authors (joined) and published of an Atom entry."""
    at = lambda path: F.lit(f'//*[local-name()="{path}"]')
    text = lambda path: F.regexp_replace(strip(F.xpath_string(xml, at(path))), r"\s+", " ")
    names = F.xpath(xml, F.lit('//*[local-name()="author"]/*[local-name()="name"]/text()'))
    return [text("id").alias("id"), text("title").alias("title"), F.array_join(names, ", ").alias("authors"), F.substring(text("published"), 1, 10).alias("published")]


def hyperlink(cell: Column) -> tuple[Column, Column]:
    """(url, name) of a =HYPERLINK("url","name") cell; another cell is a name alone."""
    pattern = r'HYPERLINK\("([^"]*)"\s*,\s*"([^"]*)"\)'
    there = cell.rlike(pattern)
    return F.regexp_extract(cell, pattern, 1), F.when(there, F.regexp_extract(cell, pattern, 2)).otherwise(strip(cell))


def catalogue(lines: DataFrame, key: list[str], order: str, column: str = "value") -> DataFrame:
    """(key, category, entry, field, value) of Markdown catalogues: ## category, ### entry, - **field**: value.

    Headings are carried down within each file, so files are independent of each other.
    """
    down = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    heading = lambda p: F.last(F.nullif(F.regexp_extract(column, p, 1), F.lit("")), ignorenulls=True).over(down)
    rows = lines.select("*", heading(r"^##\s+([^#].*)$").alias("category"), heading(r"^###\s+(.+)$").alias("entry"))
    pattern = r"^-\s+\*\*([^*]+)\*\*:\s*(.*)$"
    return rows.filter(F.col(column).rlike(pattern) & F.col("entry").isNotNull()).select(*key, "category", "entry", F.lower(F.regexp_extract(column, pattern, 1)).alias("field"), strip(F.regexp_extract(column, pattern, 2)).alias("text"))


def payload_kind(data: Column) -> Column:
    """pdf, zip, html or bin by the first bytes."""
    head = F.lower(F.decode(F.substring(data, 1, 500), "ISO-8859-1"))
    start = F.substring(F.hex(data), 1, 8)
    return F.when(start == "25504446", "pdf").when(F.substring(start, 1, 4) == "504B", "zip").when(head.rlike(r"^\s*<!doctype") | head.contains("<html"), "html").otherwise("bin")


def archive_member(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with member and text: the largest HTML member of each ZIP, names without XBRL first; the first encoding that decodes."""

    def one(data: bytes | None) -> tuple[str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                pages = [i for i in z.infolist() if i.filename.lower().endswith((".html", ".htm", ".xhtml"))]
                if not pages:
                    return None, None
                best = max(pages, key=lambda i: ("xbrl" not in i.filename.lower(), i.file_size))
                raw = z.read(best)
        except (zipfile.BadZipFile, KeyError):
            return None, None
        for name in ("utf-8", "shift_jis", "euc-jp", "cp932"):
            try:
                return best.filename, raw.decode(name)
            except UnicodeDecodeError:
                continue
        return best.filename, raw.decode("utf-8", "replace")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(x) for x in part[content]]
            yield part.drop(columns=[content]).assign(member=[f[0] for f in found], text=[f[1] for f in found])

    return files.mapInPandas(run, files.drop(content).schema.add("member", "string").add("text", "string"))


def newest_file(files: DataFrame, path: str = "path") -> DataFrame:
    """The last path of a listing: names carry timestamps."""
    return files.agg(F.max(path).alias(path)).filter(F.col(path).isNotNull())


def daily_index(spark: SparkSession, index: DataFrame, first: str, last: str, kind: str) -> DataFrame:
    """Every day of a range with the landed entries of one document type; days without any stay, with nulls."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.join(index.filter(F.col("doc_type") == kind), "day", "left")
