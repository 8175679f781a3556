"""Checks across rows, files in and out, and functions by name in SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registered
from ..lineage import shared_folder
from ..operators import checks, merging
from ..sinks import files as sinks
from ..sinks import records
from ..sources import zipped
from .common import Registry, table
from .corpus import CHUNK_SQL, SPLIT
from .records import split_fields

R = Registry()

# Ticker, date, year and damage of a document by its id, in words that Spark and DuckDB share.
_ROWS = """doc_id, CASE doc_id % 4 WHEN 0 THEN 'AAA' WHEN 1 THEN 'bb' WHEN 2 THEN 'C.A' END AS ticker, CASE doc_id % 3 WHEN 0 THEN DATE '2024-02-03' WHEN 1 THEN DATE '2023-12-31' END AS date, 2024 - doc_id % 2 AS year,
CASE WHEN doc_id % 17 = 0 THEN 'One text that several hold (NASDAQ: AAA)' WHEN doc_id % 19 = 0 THEN concat('Cookie line', chr(10), ' All lines are common ', chr(10)) ELSE
concat(text, CASE doc_id % 9 WHEN 0 THEN ' (NYSE: AAA)' WHEN 1 THEN ' (Nasdaq GS:  BB) (LSE: Z)' WHEN 2 THEN '<br />' WHEN 3 THEN ' &nbsp; Ã©' WHEN 4 THEN ' Subscribe to continue' WHEN 5 THEN concat(chr(10), 'Cookie line', chr(10), ' All lines are common') WHEN 6 THEN '...' ELSE '' END) END AS text"""
_TEXT = "coalesce(text, '')"
_CHECKED = f"""WITH d AS MATERIALIZED (SELECT {{rows}} FROM documents), w AS (SELECT *, regexp_extract_all({_TEXT}, '\\((?:NYSE|NASDAQ|Nasdaq|AMEX|TSX|LSE|OTC)[A-Za-z ]*:\\s*([A-Z][A-Z.]{{{{0,5}}}})\\)', 1) AS named, CASE WHEN trim({_TEXT}, ' ') <> '' THEN substr(text, 1, 2000) END AS k FROM d),
x AS (SELECT k FROM w WHERE k IS NOT NULL GROUP BY k HAVING min(ticker) <> max(ticker)),
l AS (SELECT doc_id, trim(unnest(string_split_regex({_TEXT}, '\\r?\\n')), ' ') AS line FROM d), c AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 5),
b AS (SELECT doc_id, sum(CASE WHEN line IN (SELECT line FROM c) THEN length(line) ELSE 0 END) / sum(length(line)) AS share FROM l WHERE line <> '' GROUP BY doc_id)
SELECT w.doc_id, trim({_TEXT}, ' ') = '' AS "empty", len({SPLIT}) < 50 AS stub, regexp_matches({_TEXT}, '<(div|span|p|br|script|table)[ />]') AS markup, regexp_matches({_TEXT}, '&(amp|lt|gt|nbsp|quot|#[0-9]+);') AS entities, regexp_matches({_TEXT}, 'Ã.|â€|\\x{{{{FFFD}}}}') AS mojibake,
regexp_matches(lower({_TEXT}), 'subscribe to (continue|read)|sign in to read|already a subscriber') AS paywall, regexp_matches({_TEXT}, '(\\.\\.\\.|…)\\s*$') AS truncated, coalesce(year(date) <> year, false) AS date_mismatch, coalesce(len(named) > 0 AND NOT list_contains(named, upper(ticker)), false) AS ticker_mismatch,
coalesce(k IN (SELECT k FROM x), false) AS cross_ticker, coalesce(share > 0.5, false) AS boilerplate FROM w LEFT JOIN b USING (doc_id)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(*split_fields(_ROWS.replace("chr(10)", "char(10)")))


@R.add(_CHECKED.format(rows=_ROWS).replace("{{", "{").replace("}}", "}"))
def quality_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven marks per document."""
    return checks.quality_suite(_rows(spark, sf))


@R.add("SELECT 'check' AS \"check\", 0::BIGINT AS n WHERE false UNION ALL " + "SELECT * FROM (UNPIVOT (SELECT " + ", ".join(f'CAST(count_if("{c}") AS BIGINT) AS "{c}"' for c in checks.CHECKS) + " FROM (" + _CHECKED.format(rows=_ROWS).replace("{{", "{").replace("}}", "}") + ")) ON COLUMNS(*) INTO NAME \"check\" VALUE n)")
def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_counts(checks.quality_suite(_rows(spark, sf)))


@R.add("""WITH s AS (SELECT p_partkey, p_name, substr(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+\\z', '', 'g'), 1, 40) AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS i FROM s)
SELECT slug || '_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || '.md' AS file, '# ' || p_name || chr(10) AS content FROM n""".replace("\\\\z", "\\z"))
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown file per part, written and read again."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    named = sinks.record_names(table(spark, sf, "part"), F.col("p_type"), "p_partkey")
    records.write_records(named, folder, F.col("file"), F.concat(F.lit("# "), "p_name", F.lit("\n")))
    return records.read_records(spark, folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("content"))


@R.add("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END, '') AS note FROM orders")
def zipped_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tab-separated members of archives, one per block of keys, read again for two of their columns."""
    folder = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}"
    note = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 5000).alias("shelf"), F.col("o_orderkey").cast("string").alias("k"), note.alias("note"))
    member = F.concat_ws("\n", F.lit("o_orderkey\tunused\tnote"), F.concat_ws("\n", F.collect_list(F.concat_ws("\t", "k", F.lit("x"), F.concat(F.lit('"'), "note", F.lit('"'))))))
    shelves = rows.groupBy("shelf").agg(member.alias("text")).select("shelf", F.lit("part.tsv").alias("member"), F.encode("text", "UTF-8").alias("content"))
    sinks.write_archives(shelves, f"{folder}/packed", "shelf")
    packed = spark.read.parquet(f"{folder}/packed")
    records.write_records(packed, f"{folder}/zips", F.concat(F.lit("orders-"), F.col("shelf").cast("string"), F.lit(".zip")), F.col("archive"))
    return zipped.read_zipped(spark, f"{folder}/zips", ["o_orderkey", "note"])


@R.add(r"""SELECT page_id, regexp_replace(lower(regexp_replace(url, '#.*', '', 's')), '/+$', '') AS k, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS t,
CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS us, CAST(page_id * 100 // 7 AS BIGINT) AS p, CAST(try_strptime(CAST(20240100 + page_id % 40 AS VARCHAR), '%Y%m%d') AS DATE) AS d, CASE i WHEN 0 THEN url ELSE 'https://b.example/' || page_id END AS link
FROM pages, (SELECT unnest([0, 1]) AS i)""")
def named_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's functions called by name from SQL, a table function among them."""
    registered.register(spark)
    return spark.sql(
        """SELECT page_id, url_key(p.url) AS k, url_host(p.url) AS h, plain_title(p.url) AS t, us_patent_number(concat(CASE WHEN page_id % 2 = 0 THEN 'US00' ELSE 'EP' END, page_id, 'B1')) AS us,
        floor_percent(page_id, 7) AS p, date_from_number(20240100 + page_id % 40) AS d, f.url AS link FROM {pages} AS p, LATERAL urls_in(concat(p.url, ';', 'https://b.example/', page_id, ', ftp://c')) AS f""",
        pages=table(spark, sf, "pages"),
    )


# Landed rows of five sources, from the documents by their id, in words that Spark and DuckDB share.
_WHEN = "CASE doc_id % 4 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '2023-12-31T10:00:00Z' WHEN 2 THEN 'soon' END"
_LANDED = {
    "runs/a/scrape.parquet": f"doc_id, concat('firm ', doc_id % 7) AS company, CASE WHEN doc_id % 2 = 0 THEN concat('Firm ', doc_id % 7, ' plc') ELSE '' END AS company_canonical, concat('t', doc_id) AS title, concat('https://a/', doc_id) AS link, {_WHEN} AS date, text AS full_text, CASE WHEN doc_id % 3 = 0 THEN 'own.parquet' END AS source_file",
    "sec/filings.parquet": f"doc_id, concat('firm ', doc_id % 7) AS company, CASE WHEN doc_id % 3 > 0 THEN '10-K' END AS form, {_WHEN} AS filing_date, concat('https://s/', doc_id) AS url, text AS full_text, doc_id AS words",
    "fca/nsm.parquet": f"doc_id, CASE WHEN doc_id % 3 > 0 THEN concat('firm ', doc_id % 7) END AS csv_company, 'hit' AS hit_company, 'L1' AS csv_lei, NULL AS hit_lei, 'Annual' AS headline, concat('https://f/', doc_id) AS download_url, {_WHEN} AS publication_date, 'ACS' AS type_code, 0.5 AS file_size_mb, text AS full_text",
    "uk/filings.parquet": f"doc_id, concat('firm ', doc_id % 7) AS company, CASE WHEN doc_id % 3 > 0 THEN concat('00', doc_id) END AS company_number, 'AA' AS filing_type, {_WHEN} AS filing_date, CASE WHEN doc_id % 2 = 0 THEN 'full accounts' END AS description, 12 AS pages, text AS full_text",
    "site/pages.parquet": "doc_id, concat('t', doc_id) AS title, concat('https://q/', doc_id) AS url, text, 7 AS words",
}
_AT = {"runs/a/scrape.parquet": "date", "sec/filings.parquet": "filing_date", "fca/nsm.parquet": "publication_date", "uk/filings.parquet": "filing_date"}
_DOCS = {
    "runs/a/scrape.parquet": "coalesce(nullif(company_canonical, ''), company) AS company, title, link, '' AS source, coalesce(source_file, 'scrape.parquet') AS source_file, full_text AS text",
    "sec/filings.parquet": "company, coalesce(form, '') || ' ' || coalesce(filing_date, '') AS title, url AS link, 'SEC EDGAR ' || coalesce(form, '') AS source, 'sec/filings.parquet' AS source_file, full_text AS text",
    "fca/nsm.parquet": "coalesce(csv_company, hit_company) AS company, headline AS title, download_url AS link, 'FCA NSM ' || type_code AS source, 'fca/nsm.parquet' AS source_file, full_text AS text",
    "uk/filings.parquet": f"company, filing_type || ' ' || coalesce(filing_date, '') AS title, coalesce('{merging.REGISTER}' || company_number || '/filing-history', '') AS link, 'Companies House ' || filing_type AS source, 'uk/filings.parquet' AS source_file, full_text AS text",
    "site/pages.parquet": "'Firm Q' AS company, title, url AS link, 'q.example' AS source, 'site/pages.parquet' AS source_file, text",
}
_ALL = " UNION ALL ".join(f"SELECT doc_id AS k, {_DOCS[s]}, {f'CAST(try_cast({_AT[s]} AS TIMESTAMP) AS TIMESTAMP)' if s in _AT else 'CAST(NULL AS TIMESTAMP)'} AS date FROM (SELECT {rows} FROM documents WHERE doc_id % 5 = {i})" for i, (s, rows) in enumerate(_LANDED.items()))


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kinds = (merging.scraped, merging.agency_filings, merging.storage_filings, merging.register_filings, functools.partial(merging.one_site, company="Firm Q", site="q.example"))
    docs = table(spark, sf, "documents")
    return merging.merged([(kind, docs.filter(F.col("doc_id") % 5 == i).selectExpr(*split_fields(rows)), source) for i, (kind, (source, rows)) in enumerate(zip(kinds, _LANDED.items(), strict=True))])


@R.add(f"""WITH RECURSIVE t AS (SELECT * FROM ({_ALL})), {CHUNK_SQL}
SELECT company, title, link, substr(chunk, 1, 200) AS snippet, date, source, md5(chunk) AS full_text, source_file, chunk_ix, coalesce(CAST(year(date) AS VARCHAR), 'undated') AS year FROM chunked JOIN t USING (k)""")
def merged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Five kinds of sources as one table of chunks, each with the folder it goes to."""
    chunks, _ = _merged(spark, sf)
    return chunks.withColumn("full_text", F.md5("full_text")).withColumn("year", sinks.year_of(F.col("date")))


@R.add("SELECT CASE doc_id % 5 WHEN 0 THEN 'https://a/' || doc_id WHEN 1 THEN 'https://s/' || doc_id WHEN 2 THEN 'https://f/' || doc_id WHEN 3 THEN CASE WHEN doc_id % 3 > 0 THEN '" + merging.REGISTER + """00' || doc_id || '/filing-history' ELSE '' END ELSE 'https://q/' || doc_id END AS link,
['runs/a/scrape.parquet', 'sec/filings.parquet', 'fca/nsm.parquet', 'uk/filings.parquet', 'site/pages.parquet'][doc_id % 5 + 1] AS source_parquet, CASE WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 3 > 0 THEN '10-K' ELSE '' END END AS form, CASE WHEN doc_id % 5 = 2 THEN 'L1' END AS lei,
CASE WHEN doc_id % 5 = 3 THEN CASE WHEN doc_id % 3 > 0 THEN '00' || doc_id ELSE '' END END AS company_number, CASE WHEN doc_id % 5 = 3 THEN false END AS paper_filed, CAST(CASE doc_id % 5 WHEN 1 THEN doc_id WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 7 END AS BIGINT) AS words FROM documents""")
def merged_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """What each kind of source knows besides, by link; columns of other kinds are null."""
    return _merged(spark, sf)[1].select("link", "source_parquet", "form", "lei", "company_number", "paper_filed", "words")


QUERIES, ORACLE_SQL = R.queries, R.sql
