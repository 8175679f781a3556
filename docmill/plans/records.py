"""Documents of mixed sources, their filters, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import bare_host, host
from ..operators import filters, graph, mining, reshape, resolve
from ..operators.select import keep_first
from ..sinks import files as sinks
from .common import Registry, table
from .corpus import HOST, SPLIT

R = Registry()


def split_fields(text: str) -> list[str]:
    """The fields of a select list, at commas outside of brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


@R.add("""SELECT s_name AS company, 'Annual report' AS title, 'https://f.example/' || s_suppkey AS link, '' AS snippet, CAST(NULL AS TIMESTAMP) AS date, 'filing' AS source, coalesce(s_name, '') AS full_text, '' AS source_file FROM supplier
UNION ALL SELECT c_name, '', '', substr(c_mktsegment, 1, 4), TIMESTAMP '2024-02-03', 'crm', '', 'c.parquet' FROM customer""")
def document_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources of other shapes as one document table."""
    a = reshape.to_documents(table(spark, sf, "supplier"), company=F.col("s_name"), title=F.lit("Annual report"), link=F.concat(F.lit("https://f.example/"), F.col("s_suppkey").cast("string")), source=F.lit("filing"), full_text=F.col("s_name"))
    b = reshape.to_documents(table(spark, sf, "customer"), company=F.col("c_name"), snippet=F.substring("c_mktsegment", 1, 4), date=F.lit("2024-02-03"), source=F.lit("crm"), source_file=F.lit("c.parquet"))
    return reshape.union_documents([a, b])


@R.add("SELECT p_brand AS company, p_name AS title, concat_ws(' | ', nullif(p_type, ''), CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END) AS snippet, lower(p_brand) AS source FROM part")
def contract_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("exchange"), F.col("p_name").alias("product_name"), F.lit("").alias("ticker"), F.col("p_type").alias("asset_class"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("").alias("contract_size"), F.lit(None).cast("string").alias("quote_currency"), F.lit("x").alias("source_url"))
    return reshape.contract_documents(rows).select("company", "title", "snippet", "source")


@R.add("SELECT p_partkey, to_json({'name': p_name, 'size': p_size}) AS json FROM part")
def rows_as_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("json"))


_BLANK = "trim(coalesce(text, ''), ' ')"


@R.add(f"""SELECT CAST(count_if({_BLANK} = '') AS BIGINT) AS "empty", CAST(count_if(len({SPLIT}) < 50) AS BIGINT) AS stub, CAST(count_if(regexp_matches(coalesce(text, ''), '<(div|span|p|br|script|table)[ />]')) AS BIGINT) AS markup,
CAST(count_if(regexp_matches(coalesce(text, ''), '&(amp|lt|gt|nbsp|quot|#[0-9]+);')) AS BIGINT) AS entities, CAST(count_if(regexp_matches(lower(coalesce(text, '')), 'all rights reserved|cookie policy|terms of (use|service)')) AS BIGINT) AS boilerplate FROM documents""")
def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    flags = reshape.quality_flags(F.col("text"))
    return table(spark, sf, "documents").agg(*[F.count_if(flags[k]).alias(k) for k in ("empty", "stub", "markup", "entities", "boilerplate")])


@R.add("""WITH t AS (SELECT doc_id, regexp_matches(b, 'tion') AND regexp_matches(b, 'the') AND NOT regexp_matches(b, '!!') AS a, regexp_matches(b, 'ing') AND NOT regexp_matches(b, 'ment') AS s FROM (SELECT doc_id, lower(coalesce(text, '')) AS b FROM documents))
SELECT doc_id, a, a AND s AS b FROM t WHERE a""")
def two_tier_filter(spark: SparkSession, sf: str) -> DataFrame:
    a, b = reshape.two_tiers(F.col("text"), F.col("text"), "tion", "the", "!!", "ing", "ment")
    return table(spark, sf, "documents").select("doc_id", a.alias("a"), b.alias("b")).filter("a")


# Format, access and kind of a row by its key, in words that Spark and DuckDB share.
_CATALOG = """p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'GeoTIFF' WHEN 1 THEN 'API JSON' WHEN 2 THEN 'PDF; API' WHEN 3 THEN 'HTML, KML' WHEN 4 THEN 'shapefile' WHEN 5 THEN 'NetCDF/HDF' WHEN 6 THEN 'Web API' WHEN 7 THEN 'zarr, COG raster' END AS form,
CASE p_partkey % 5 WHEN 0 THEN 'Paid' WHEN 1 THEN 'free' WHEN 2 THEN 'paid/free' WHEN 3 THEN 'Mixed paid' END AS access, CASE p_partkey % 4 WHEN 0 THEN 'imagery' WHEN 1 THEN 'Numeric' WHEN 2 THEN 'text' END AS kind"""


@R.add(f"""WITH c AS (SELECT {_CATALOG} FROM part), l AS (SELECT p_partkey, lower(coalesce(form, '')) AS f, lower(coalesce(access, '')) AS a, lower(coalesce(kind, '')) AS k FROM c),
m AS (SELECT *, regexp_matches(f, 'geotiff|netcdf|grib|hdf|kml') AS b FROM l)
SELECT p_partkey, CASE WHEN contains(a, 'paid') AND NOT contains(a, 'free') AND NOT contains(a, 'mixed') THEN 'excluded_paid' WHEN k = 'imagery' AND b THEN 'skip_binary' WHEN b AND NOT contains(f, 'html') AND NOT contains(f, 'pdf') THEN 'skip_binary'
WHEN contains(f, 'api') AND k = 'numeric' AND NOT regexp_matches(f, 'pdf|html|web') THEN 'api_numeric' ELSE 'deep' END AS bucket FROM m""")
def source_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr(*split_fields(_CATALOG))
    return rows.select("p_partkey", reshape.source_bucket(F.col("form"), F.col("access"), F.col("kind")).alias("bucket"))


@R.add(f"""WITH x AS (SELECT DISTINCT {HOST} AS domain FROM pages WHERE page_id % 7 = 0) SELECT page_id FROM pages WHERE {HOST} NOT IN (SELECT domain FROM x)
AND NOT (len(string_split({HOST}, '.')) > 2 AND array_to_string(string_split({HOST}, '.')[-2:], '.') IN (SELECT domain FROM x))""")
def excluded_domains(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    listed = pages.filter("page_id % 7 = 0").select(host(F.col("url")).alias("domain")).distinct()
    return filters.without_domains(pages, listed).select("page_id")


@R.add("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY ANODIZED STEEL', 'PROMO PLATED TIN') OR (starts_with(p_brand, 'Brand#1') OR starts_with(p_type, 'STANDARD')) AND p_size > 0 AND p_name >= 'a' AND p_name <= 'm'")
def code_filters(spark: SparkSession, sf: str) -> DataFrame:
    """A category, a prefix in either of two delimited lists, a set date, and a range of strings."""
    either = filters.starts_with_any(F.split(F.concat("p_brand", F.lit("; x")), "; "), ["Brand#1"]) | filters.starts_with_any(F.split("p_type", "; "), ["STANDARD"])
    return table(spark, sf, "part").filter(F.col("p_type").isin("ECONOMY ANODIZED STEEL", "PROMO PLATED TIN") | (either & (F.col("p_size") > 0) & (F.col("p_name") >= "a") & (F.col("p_name") <= "m"))).select("p_partkey")


@R.add("SELECT source, CAST(floor(avg(CASE WHEN doc_id % 40 >= 21 THEN 1.0 ELSE 0 END) * 100) AS INTEGER) AS percent, CAST(count_if(doc_id % 40 >= 10) AS BIGINT) AS dated FROM documents GROUP BY source")
def share_since_year(spark: SparkSession, sf: str) -> DataFrame:
    """The percentage from a year on, and rows whose year has four digits, by source; years come as text."""
    year = F.concat(F.lit("20"), (F.col("doc_id") % 40).cast("string"))
    n = F.coalesce(year.try_cast("double"), F.lit(0.0))
    recent = F.when((F.length(year) == 4) & (n >= 2021), 1.0).otherwise(0.0)
    return table(spark, sf, "documents").groupBy("source").agg(F.floor(F.avg(recent) * 100).cast("int").alias("percent"), F.count_if(F.length(year) == 4).alias("dated"))


@R.add("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def grouped_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))


@R.add("SELECT 'u' || user_id AS url, count(*) AS n, count(*) < 3 AS again FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.retry(table(spark, sf, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url")))


@R.add("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def longest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A global order with a tie-breaker, and its head (the feature is the top of the list)."""
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@R.add(f"""WITH l AS (SELECT {HOST} AS host, page_id, url FROM pages) SELECT host, count(*) AS n, CAST(count_if(page_id % 2 = 0) AS BIGINT) AS even FROM l GROUP BY host""")
def host_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_id") % 2 == 0).alias("even"))


@R.add(r"""SELECT page_id, round(0.8 * (CAST(contains(lower(url), 'news') AS INT) + CAST(contains(lower(url), 'report') AS INT)) / 2 + 0.3 / (1 + abs(len(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')) - 1)) + 0.15 / (1 + page_id % 400), 9) AS score FROM pages""")
def best_first(spark: SparkSession, sf: str) -> DataFrame:
    return graph.best_first(table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 400).alias("days")), ("news", "report")).select("page_id", "score")


@R.add()
def internal_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.internal_links(table(spark, sf, "pages"))


@R.add()
def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    rules = pages.select(host(F.col("url")).alias("host")).distinct().select("host", F.lit("User-agent: *\nDisallow: /private\n").alias("robots"))
    return graph.robots_allowed(pages, rules)


@R.add()
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    seen, none = pages.select("url"), spark.createDataFrame([("facebook.com",)], "domain string")
    return graph.frontier(graph.resolved_links(pages), seen, none, pages.groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")), 50)


@R.add("""WITH b AS (SELECT CAST(min(year(o_orderdate)) AS INT) AS lo, CAST(max(year(o_orderdate)) AS INT) AS hi FROM orders), y AS (SELECT unnest(range(lo, hi + 1)) AS y, unnest(range(hi - lo + 1)) AS i, hi - lo + 1 AS n, lo, hi FROM b),
s AS (SELECT y FROM y WHERE n <= 5 OR y IN (lo, hi) OR (i % (n // 5) = 0 AND i // (n // 5) BETWEEN 1 AND 3)), t AS (SELECT DISTINCT lower(p_type) AS t FROM part)
SELECT DISTINCT CASE WHEN contains(t, 'steel') THEN '' ELSE 'steel ' END || t || ' ' || y AS query FROM t, s WHERE query NOT IN (SELECT DISTINCT CASE WHEN contains(lower(p_type), 'steel') THEN '' ELSE 'steel ' END || lower(p_type) || ' ' || (SELECT lo FROM b) FROM part WHERE p_size % 2 = 0)""")
def jargon_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts as terms of one topic, over years of the orders, without what was asked before."""
    lo, hi = table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    part = table(spark, sf, "part").select(F.lower("p_type").alias("term"), "p_size", "p_partkey")
    terms = part.groupBy("term").agg(F.min("p_partkey").alias("rank"))
    asked = part.filter("p_size % 2 = 0").select(F.concat(F.when(F.col("term").contains("steel"), "").otherwise("steel "), "term", F.lit(f" {lo}")).alias("query")).distinct()
    return mining.expand_jargon(terms, "steel", mining.sampled_years(lo, hi, 5), asked)


@R.add("SELECT c_custkey, replace(t, '{0}', CASE WHEN k = 0 THEN 'T' || c_custkey ELSE c_name END) AS query FROM customer, (SELECT * FROM (VALUES (0, '{0} supply chain'), (0, '{0} suppliers'), (0, '{0} customers'), (0, '{0} 10-K'), (1, '{0} supply chain'), (1, '{0} suppliers'), (1, '{0} customers revenue'), (1, '{0} annual report')) v(k, t)) WHERE k = 1 OR c_custkey % 2 = 0")
def company_queries(spark: SparkSession, sf: str) -> DataFrame:
    firms = table(spark, sf, "customer").select(F.concat("c_name", F.lit(" Inc.")).alias("company"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).alias("ticker"))
    out = mining.company_queries(firms)
    return out.join(table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" Inc.")).alias("company")), "company").select("c_custkey", "query")


@R.add("SELECT DISTINCT p_type || ' ' || c_mktsegment AS query FROM (SELECT DISTINCT p_type FROM part), (SELECT DISTINCT c_mktsegment FROM customer)")
def term_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts with the few segments of the market."""
    segments = tuple(sorted(r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()))
    return mining.pairs_of_terms(table(spark, sf, "part").select(F.col("p_type").alias("method")), segments)


@R.add("""WITH b AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INT) - CAST(o_custkey % 9 AS INT) AS lo, CAST(max(year(o_orderdate)) AS INT) AS hi FROM orders GROUP BY o_custkey),
y AS (SELECT o_custkey, unnest(range(lo, hi + 1)) AS y, unnest(range(hi - lo + 1)) AS i, hi - lo + 1 AS n, lo, hi FROM b)
SELECT o_custkey, CAST(y AS INT) AS year FROM y WHERE n <= 4 OR y IN (lo, hi) OR (i % (n // 4) = 0 AND i // (n // 4) BETWEEN 1 AND 2)""")
def sampled_years(spark: SparkSession, sf: str) -> DataFrame:
    """At most four years of each customer's orders, and some before, evenly spaced."""
    first = F.min(F.year("o_orderdate")) - F.col("o_custkey").cast("int") % 9
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(first.cast("int").alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    return spans.select("o_custkey", F.explode(mining.years_between(F.col("lo"), F.col("hi"), 4)).alias("year"))


@R.add("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@R.add("SELECT doc_id, coalesce(nullif(text, ''), source) AS body, CASE WHEN doc_id % 2 = 0 AND length(text) >= 500 THEN text ELSE coalesce(source, '') END AS promoted, coalesce(nullif(lang, ''), nullif(source, ''), '') AS company FROM documents")
def promoted_texts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("failed")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif("text", F.lit("")), "source").alias("body"), reshape.promoted(F.col("source"), status, F.col("text")).alias("promoted"), resolve.coalesced(F.col("lang"), F.col("source")).alias("company"))


_WORDS = f"format('{{:,}}', len({SPLIT}))"


@R.add(f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, '### ' || CASE WHEN coalesce(lang, '') = '' THEN 'Untitled' ELSE lang END || chr(10) || chr(10) || '| | |' || chr(10) || '|---|---|' || chr(10)
|| CASE WHEN coalesce(source, '') = '' THEN '' ELSE '| **Source** | ' || source || ' |' || chr(10) END || '| **Words** | ' || {_WORDS} || ' |' || chr(10) || chr(10) || CASE WHEN coalesce(text, '') = '' THEN '' ELSE text || chr(10) END AS a FROM documents)
SELECT source, min(doc_id) AS first, count(*) AS n, md5('---' || chr(10) || chr(10) || CASE WHEN source = '' THEN '' ELSE '## ' || source || chr(10) || chr(10) END || string_agg(a, chr(10) ORDER BY doc_id)) AS body FROM d GROUP BY source""")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    article = sinks.markdown_article(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text"), level=3)
    return sinks.markdown_groups(table(spark, sf, "documents"), "source", "doc_id", article).withColumn("body", F.md5("body"))


@R.add("""WITH s AS (SELECT p_partkey, p_brand, substr(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+\\z', '', 'g'), 1, 40) AS slug FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS j FROM s)
SELECT p_partkey, slug || '_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || '.md' AS file, p_brand || CASE WHEN j > 1 THEN '__' || j ELSE '' END || '.pdf' AS member, substr(sha256('u' || p_partkey), 1, 8) || '_' || p_brand AS artefact FROM n""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = sinks.record_names(table(spark, sf, "part"), F.col("p_type"), "p_partkey")
    url = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    return sinks.readable_names(parts, "p_brand", "p_partkey", ".pdf").select("p_partkey", "file", "member", sinks.artefact_name(url, F.col("p_brand")).alias("artefact"))


@R.add("SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'undated' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, count(*) AS n FROM orders GROUP BY 1")
def years_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return table(spark, sf, "orders").groupBy(sinks.year_of(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))


# Authors, venue, numbers and link of a row by its key, in words that Spark and DuckDB share.
_PAPER = """p_partkey, concat('Anna Bell', CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', C. D.' ELSE ', C. D., , E. F., G. H., I. J.' END) AS authors, 2000 + p_size AS year, concat(p_name, CASE WHEN p_partkey % 7 = 0 THEN ' {A&amp;B} & C' ELSE '' END) AS title,
CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS venue, p_type AS source, CASE WHEN p_partkey % 5 = 0 THEN concat('10.1/', p_partkey) END AS doi, CASE WHEN p_partkey % 2 = 0 THEN concat('24', p_partkey) ELSE '' END AS arxiv, CASE WHEN p_partkey % 11 > 0 THEN concat('https://p.example/', p_partkey) END AS link"""
_LETTERS = "concat(CASE WHEN {n} > 702 THEN chr(97 + (({n} - 703) // 676) % 26) ELSE '' END, CASE WHEN {n} > 26 THEN chr(97 + (({n} - 27) // 26) % 26) ELSE '' END, chr(97 + ({n} - 1) % 26))"
_CLEAN = "replace(replace(regexp_replace({0}, '[{{}}]', '', 'g'), '&amp;', 'and'), '&', 'and')"
_KEYED = f"""WITH p AS (SELECT {_PAPER} FROM part), b AS (SELECT *, 'bell' || year || regexp_extract(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), '^ ?([a-z0-9]*)', 1) AS base FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey)::INT AS i FROM b),
f AS (SELECT base, list(l ORDER BY l) AS free FROM (SELECT DISTINCT base FROM n) x, (SELECT unnest(range(2, 27))::INT AS l) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.base = x.base || chr(96 + l)) GROUP BY base),
k AS (SELECT n.*, base || CASE WHEN i = 1 THEN '' WHEN i - 1 <= len(free) THEN chr(96 + free[i - 1]) ELSE '-' || {_LETTERS.format(n="(i - 1 - len(free))::INT")} END AS citekey FROM n JOIN f USING (base))"""


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.citekeys(table(spark, sf, "part").selectExpr(*split_fields(_PAPER)), F.col("authors"), "year", F.col("title"), "p_partkey")


@R.add(_KEYED + f"""SELECT p_partkey, citekey, CASE WHEN arxiv <> '' AND venue IS NULL THEN '@misc{{' ELSE '@article{{' END || citekey || ',' || chr(10) || '  author    = {{' || array_to_string(list_filter(list_transform(string_split(authors, ','), lambda a: trim(a)), lambda a: a <> ''), ' and ') || '}},' || chr(10)
|| '  title     = {{' || {_CLEAN.format("title")} || '}},' || chr(10) || '  year      = {{' || year || '}}' || coalesce(',' || chr(10) || '  journal   = {{' || {_CLEAN.format("venue")} || '}}', '') || coalesce(',' || chr(10) || '  doi       = {{' || doi || '}}', '')
|| CASE WHEN arxiv <> '' AND venue IS NULL THEN ',' || chr(10) || '  eprint    = {{' || arxiv || '}},' || chr(10) || '  archivePrefix = {{arXiv}}' ELSE '' END || coalesce(',' || chr(10) || '  url       = {{' || link || '}}', '') || chr(10) || '}}' AS entry FROM k""")
def bibliography(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a reference list under unique keys."""
    names = ("authors", "title", "year", "venue", "doi", "arxiv", "link")
    return _papers(spark, sf).select("p_partkey", "citekey", sinks.bibtex(F.col("citekey"), *[F.col(c) for c in names]).alias("entry"))


@R.add(_KEYED + """SELECT p_partkey, '- [' || citekey || '] ' || CASE WHEN len(string_split(authors, ',')) > 4 THEN array_to_string(string_split(authors, ',')[:3], ',') || ', et al.' ELSE authors END || ' (' || year || '). *' || trim(title) || '*. ' || coalesce(venue, source) || '.'
|| CASE WHEN doi IS NOT NULL THEN ' doi:' || doi WHEN arxiv <> '' THEN ' arXiv:' || arxiv ELSE '' END AS line FROM k""")
def reference_lines(spark: SparkSession, sf: str) -> DataFrame:
    names = ("authors", "title", "year", "venue", "source", "doi", "arxiv")
    return _papers(spark, sf).select("p_partkey", sinks.reference_line(F.col("citekey"), *[F.col(c) for c in names]).alias("line"))


QUERIES, ORACLE_SQL = R.queries, R.sql
