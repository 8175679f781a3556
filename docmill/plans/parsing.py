"""Readers, dates, addresses and nested fields, over text made from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, dates, patents, transcripts
from ..functions import text as T
from ..functions.entities import name_guard, search_name
from ..operators import graph
from ..operators.reshape import urls_in
from ..sources import files
from .common import Registry, spread, table

R = Registry()


@R.add(r"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^[ \t\r\n\f\v]+', ''), '[ \t\r\n\f\v]+\z', '') AS line FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY doc_id""")
def line_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("value"))
    return files.entries(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@R.add(r"SELECT DISTINCT regexp_replace(replace(regexp_replace(lower(url), '^https?://', ''), 'www.', ''), '/(?s:.*)', '') AS domain FROM pages")
def exclusion_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(files.bare_domain(F.col("url")).alias("domain")).distinct()


_NASTY = "CASE page_id % 4 WHEN 0 THEN '%PDF-1.7 ' || html WHEN 1 THEN 'PK' || html WHEN 2 THEN 'plain ' || page_id ELSE html END"


@R.add(f"SELECT page_id, CASE WHEN starts_with(d, '%PDF') THEN 'pdf' WHEN starts_with(d, 'PK') THEN 'zip' WHEN regexp_matches(lower(substr(d, 1, 200)), '^\\s*<!doctype') OR contains(lower(substr(d, 1, 200)), '<html') THEN 'html' ELSE 'bin' END AS kind FROM (SELECT page_id, {_NASTY} AS d FROM pages)")
def payload_kinds(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.expr(_NASTY).cast("binary").alias("d"))
    return pages.select("page_id", files.payload_kind(F.col("d")).alias("kind"))


@R.add("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE 'https://x.example/' || s_suppkey END AS url, s_name AS name FROM supplier")
def hyperlink_cells(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), "s_name", F.lit(" "))).otherwise(F.concat(F.lit('=HYPERLINK("https://x.example/'), F.col("s_suppkey").cast("string"), F.lit('", "'), "s_name", F.lit('")')))
    url, name = files.hyperlink(cell)
    return table(spark, sf, "supplier").select("s_suppkey", url.alias("url"), name.alias("name"))


@R.add("SELECT o_custkey, o_orderkey, o_orderstatus AS form FROM orders WHERE o_orderstatus IN ('F', 'O')")
def parallel_arrays(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "orders").select("o_custkey", F.array("o_orderkey").alias("o_orderkey"), F.array("o_orderstatus").alias("form"))
    return files.from_parallel_arrays(one, ["o_orderkey", "form"]).filter(F.col("form").isin("F", "O")).select("o_custkey", "o_orderkey", "form")


# A page of search results by a row's key, in words that Spark and DuckDB share.
_RESULTS = """concat('{"results":{"cluster":[{"result":[{"id":"patent/US', 1000000 + s_suppkey, 'B2/en"},{"id":"patent/USD0', s_suppkey, 'S1/en"},{"id":"patent/EP', 2000000 + s_suppkey, '/de"}]},{"result":[{"id":"patent/US', 1000000 + s_suppkey, 'B2/en"},{"id":"scholar/US', s_suppkey, 'A1"},{"id":"x/patent/US77777A"},{"id":"patent/WO20', s_suppkey, 'A3"}]}]}}')"""


@R.add(f"""WITH j AS (SELECT s_suppkey, unnest(range(2)) AS c, CAST({_RESULTS} AS JSON) AS x FROM supplier), r AS (SELECT s_suppkey, c, unnest(range(CAST(json_array_length(x, '$.results.cluster[' || c || '].result') AS BIGINT))) AS i, x FROM j),
m AS (SELECT s_suppkey, regexp_extract(json_extract_string(x, '$.results.cluster[' || c || '].result[' || i || '].id'), '^patent/([A-Z]{{2}}[0-9A-Z]+)', 1) AS id FROM r) SELECT DISTINCT s_suppkey, id FROM m WHERE id <> ''""")
def nested_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(files.cluster_ids(F.expr(_RESULTS))).alias("id"))


@R.add("SELECT page_id, url AS loc FROM pages")
def sitemap_locations(spark: SparkSession, sf: str) -> DataFrame:
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), safe, F.lit("</loc></url></urlset>"))
    return table(spark, sf, "pages").select("page_id", F.explode(files.sitemap_locations(xml)).alias("loc"))


@R.add("SELECT page_id, url || '/sitemap.xml' AS sitemap FROM pages WHERE page_id % 2 = 0")
def robots_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("SITEMAP:  "), "url", F.lit("/sitemap.xml\n"))).otherwise(""))
    return files.robots_sitemaps(table(spark, sf, "pages").select("page_id", F.explode(F.split(robots, "\n")).alias("value")))


@R.add("SELECT 's' || s_suppkey AS id, s_name AS title, s_name || ', Second Author' AS authors, '2024-03-15' AS published FROM supplier")
def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(F.lit('<entry xmlns="http://www.w3.org/2005/Atom"><id>s'), F.col("s_suppkey").cast("string"), F.lit("</id><title>\n  "), "s_name", F.lit("</title><published>2024-03-15T00:00:00Z</published><author><name>"), "s_name", F.lit("</name></author><author><name>Second Author</name></author></entry>"))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    every = rows.join(table(spark, sf, "supplier"), "s_suppkey").select(*files.feed_entry(xml))
    return every.distinct()


@R.add("SELECT r_name AS category, n_name AS entry, unnest(['format', 'url']) AS field, unnest(['HTML; PDF', 'https://' || n_nationkey || '.example']) AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as entries under their regions, one file per region, read back from its lines."""
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("file"), F.lit(0).alias("n"), F.concat(F.lit("## "), "r_name").alias("value"))
    lines = F.array(F.concat(F.lit("### "), "n_name"), F.lit("- **Format**: HTML; PDF "), F.concat(F.lit("- **URL**: https://"), F.col("n_nationkey").cast("string"), F.lit(".example")), F.lit("free text"))
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").alias("file"), "n_nationkey", F.posexplode(lines).alias("at", "value")).select("file", (F.col("n_nationkey") * 10 + F.col("at") + 1).alias("n"), "value")
    return files.catalogue(regions.unionByName(nations), ["file"], "n").drop("file")


@R.add("SELECT s_suppkey, s_name AS company, s_name AS assignee, CAST([] AS VARCHAR[]) AS ids, s_suppkey % 2 = 0 AS granted_only, 50 AS \"limit\", s_suppkey % 3 = 0 AS theme FROM supplier")
def json_targets(spark: SparkSession, sf: str) -> DataFrame:
    granted = F.when(F.col("s_suppkey") % 2 == 0, ',"granted_only":true').otherwise("")
    json = F.concat(F.lit('{"'), F.when(F.col("s_suppkey") % 3 == 0, "themes").otherwise("targets"), F.lit('":[{"company":"'), "s_name", F.lit('"'), granted, F.lit("}]}"))
    return files.targets(table(spark, sf, "supplier").select("s_suppkey", json.alias("value")))


@R.add("SELECT c_custkey, c_name FROM customer WHERE upper(trim(c_mktsegment)) = 'BUILDING' ORDER BY c_custkey LIMIT 50 OFFSET 10")
def csv_page(spark: SparkSession, sf: str) -> DataFrame:
    return files.page(table(spark, sf, "customer"), [F.col("c_custkey")], 10, 50, ("c_mktsegment", " building ")).select("c_custkey", "c_name")


@R.add("SELECT d AS day, count(o_orderkey) AS n FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-03-31', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d AND o_orderstatus = 'F' GROUP BY d")
def daily_index(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("doc_type"), "o_orderkey")
    return files.daily_index(spark, index, "1995-01-01", "1995-03-31", "F").groupBy("day").agg(F.count("o_orderkey").alias("n"))


@R.add("SELECT max(url) AS path FROM pages")
def newest_file(spark: SparkSession, sf: str) -> DataFrame:
    return files.newest_file(table(spark, sf, "pages").select(F.col("url").alias("path")))


_FORMS = "CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m') WHEN 3 THEN strftime(ts, '%Y') WHEN 4 THEN 'not-a-date' END"


@R.add(f"SELECT event_id, coalesce(try_strptime(d, '%Y-%m-%dT%H:%M:%S'), try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y-%m'), try_strptime(d, '%Y')) AS at FROM (SELECT event_id, {_FORMS} AS d FROM events)")
def strict_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 6
    d = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd")).when(kind == 2, F.date_format("ts", "yyyy-MM")).when(kind == 3, F.date_format("ts", "yyyy")).when(kind == 4, "not-a-date")
    return table(spark, sf, "events").select("event_id", dates.strict_timestamp(d).alias("at"))


@R.add("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS at FROM orders")
def mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    kind, d = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    told = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "MMMM d, yyyy")).when(kind == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:30:00+00:30"))).when(kind == 3, F.date_format(d, "yyyy/MM/dd")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", dates.mixed_timestamp(told).cast("date").alias("at"))


# A text with a date in one of several forms, valid or not, or beyond what is looked at; words that Spark and DuckDB share.
_DAY, _MON, _YEAR = "extract(day FROM o_orderdate)", "extract(month FROM o_orderdate)", "extract(year FROM o_orderdate)"
_MONTH_NAME = "CASE " + _MON + " " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(dates.MONTHS)) + " END"
_TOLD = f"""concat('Report of ', CASE o_orderkey % 8 WHEN 0 THEN concat({_DAY}, ' ', {_MONTH_NAME}, ' ', {_YEAR}) WHEN 1 THEN upper(concat({_MONTH_NAME}, '  ', {_YEAR})) WHEN 2 THEN concat({_YEAR}, '-', lpad(cast({_MON} AS STRING), 2, '0'), '-', lpad(cast({_DAY} AS STRING), 2, '0'))
WHEN 3 THEN concat({_DAY}, '/', {_MON}, '/', {_YEAR}) WHEN 4 THEN concat(repeat('x ', 300), {_DAY}, '/', {_MON}, '/', {_YEAR}) WHEN 5 THEN concat({_MON}, '/', {_DAY}, '/', {_YEAR}) WHEN 6 THEN concat('31 February ', {_YEAR}, ' or 77/88/', {_YEAR}) ELSE 'late' END, ' for holders.')"""


@R.add(f"""WITH t AS (SELECT o_orderkey, substr({_TOLD}, 1, 500) AS x, CAST(o_orderdate AS DATE) AS d FROM orders),
h AS (SELECT o_orderkey, d, regexp_replace(regexp_extract(x, '(?i)([0-9]{{1,2}}\\s+(?:{"|".join(dates.MONTHS)})\\s+[0-9]{{4}})', 1), '\\s+', ' ', 'g') AS a, regexp_replace(regexp_extract(x, '(?i)((?:{"|".join(dates.MONTHS)})\\s+[0-9]{{4}})', 1), '\\s+', ' ', 'g') AS b,
regexp_extract(x, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS c, regexp_extract(x, '([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})', 1) AS s FROM t),
f AS (SELECT o_orderkey, CAST(coalesce(try_strptime(a, '%d %B %Y'), try_strptime('1 ' || b, '%d %B %Y'), try_strptime(c, '%Y-%m-%d'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y')) AS DATE) AS in_text, CASE WHEN o_orderkey % 2 = 0 THEN d + 1 END AS in_file FROM h)
SELECT o_orderkey, in_text, in_file, greatest(in_text, in_file) AS best FROM f""".replace("AS STRING", "AS VARCHAR"))
def content_dates(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("D:"), F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyyMMdd"), F.lit("101500Z")))
    a, b = dates.date_in_text(F.expr(_TOLD)), dates.metadata_date(meta)
    return table(spark, sf, "orders").select("o_orderkey", a.alias("in_text"), b.alias("in_file"), dates.latest(a, b).alias("best"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS at FROM orders")
def number_dates(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", dates.number_date(number).alias("at"))


@R.add("""SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN NULL ELSE upper('tk') || CASE c_custkey % 4 WHEN 2 THEN '.A' ELSE '' END END AS ticker, CASE c_custkey % 4 WHEN 1 THEN NULL ELSE 'Q' || (c_custkey % 4 + 1) END AS quarter,
CASE c_custkey % 4 WHEN 1 THEN NULL ELSE CAST(2000 + c_custkey % 25 AS INTEGER) END AS year, CASE c_custkey % 4 WHEN 1 THEN NULL ELSE '2024-05-12' END AS pub_date FROM customer""")
def transcript_addresses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://www.x.example/earnings/call-transcripts/2024/05/12/Some-Firm-tk"), F.when(k % 4 == 2, "-a").otherwise(""), F.lit("-"), F.when(k % 4 != 1, F.concat(F.lit("q"), (k % 4 + 1).cast("string"), F.lit("-"))).otherwise(""), (k % 25 + 2000).cast("string"), F.lit("-earnings-call-transcript/"))
    return table(spark, sf, "customer").select("c_custkey", transcripts.from_address(url).alias("x")).select("c_custkey", "x.ticker", "x.quarter", "x.year", "x.pub_date")


@R.add("SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN ['Anna Bell', 'Carl van Dorn'] ELSE ['Carl van Dorn'] END AS names FROM supplier")
def text_speakers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Carl van Dorn, Chief Officer: welcome\nThe Board: no\nJOHN DOE: no\nOperator: no\n  Carl van Dorn: again\nand so on: "), F.when(F.col("s_suppkey") % 2 == 0, "\nAnna Bell: yes").otherwise(""))
    return table(spark, sf, "supplier").select("s_suppkey", transcripts.speakers_in_text(text).alias("names"))


@R.add("""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' Open the line for questions. Q&A session now' WHEN 1 THEN ' Questions and Answers: go' ELSE '' END AS t FROM documents),
p AS (SELECT doc_id, t, CASE doc_id % 3 WHEN 0 THEN instr(lower(t), 'q&a session') WHEN 1 THEN instr(lower(t), 'questions and answers') ELSE 0 END AS pos FROM t)
SELECT doc_id, length(CASE WHEN pos = 0 THEN t ELSE trim(substr(t, 1, pos - 1), ' ') END) AS prepared, length(CASE WHEN pos = 0 THEN '' ELSE trim(substr(t, pos), ' ') END) AS questions FROM p""")
def remarks_and_questions(spark: SparkSession, sf: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 3 == 0, " Open the line for questions. Q&A session now").when(F.col("doc_id") % 3 == 1, " Questions and Answers: go").otherwise("")
    cut = transcripts.split_at_marker(F.concat(F.coalesce("text", F.lit("")), more))
    return table(spark, sf, "documents").select("doc_id", cut.alias("c")).select("doc_id", F.length("c.prepared").cast("long").alias("prepared"), F.length("c.questions").cast("long").alias("questions"))


@R.add("SELECT page_id, 'Call of ' || page_id AS headline, '2024-05-12' AS date, 'TK' || page_id AS ticker FROM pages WHERE page_id % 2 = 0")
def news_articles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    kind = F.when(F.col("page_id") % 2 == 0, "NewsArticle").otherwise("WebPage")
    html = F.concat("html", F.lit('<script type="application/ld+json">{"@type":"Organization"}</script><script type="application/ld+json">{"@type":"'), kind, F.lit('","headline":"Call of '), k, F.lit('","datePublished":"2024-05-12","about":[{"name":"x"},{"tickerSymbol":"NYSE TK'), k, F.lit('"}]}</script>'))
    found = table(spark, sf, "pages").select("page_id", transcripts.news_article(html).alias("x"))
    return found.filter("x IS NOT NULL").select("page_id", "x.headline", "x.date", "x.ticker")


@R.add()
def transcript_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", transcripts.parsed_page("html").alias("x")).select("page_id", "x.*")


@R.add()
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", patents.page_fields("html").alias("fields"))


@R.add("SELECT p_partkey, 'US' || p_partkey || 'B2' AS number, CAST(p_partkey AS VARCHAR) AS us, p_name AS title, ['H01'] AS codes, contains(upper(p_name), 'A') AS held FROM part")
def patent_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    number = patents.publication_number(F.concat(F.lit("US-00"), k, F.lit("-B2")))
    texts = F.array(F.struct(F.lit("de").alias("language"), F.lit("x").alias("text")), F.struct(F.lit("en").alias("language"), F.col("p_name").alias("text")))
    codes = F.array(F.struct(F.lit("H01").alias("code")), F.struct(F.lit("").alias("code")))
    names = F.array(F.struct(F.col("p_name").alias("name")))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("US"), patents.us_number(number), F.lit("B2")).alias("number"), patents.us_number(number).alias("us"), patents.localized(texts).alias("title"), patents.plucked(codes, "code").alias("codes"), patents.names_like(names, ["a"]).alias("held"))


# Running text and an address with patent numbers of all shapes, and what only looks like one.
_CITING = "concat('see US', 10000000 + s_suppkey, 'B2, EP', 2000000 + s_suppkey, ' and IN', 20000 + s_suppkey, 'A, RU', 33333, 'C1; US', s_suppkey, 'A or USA12345B', s_suppkey, ' (ZA', 99999 - s_suppkey, 'B) US', 10000000 + s_suppkey, 'B2')"
_CITED_AT = "concat('https://patents.google.com/patent/USD0', s_suppkey, 'S1/en?oq=http://x.example/patent/US1')"


@R.add(rf"""SELECT s_suppkey, list_filter(regexp_extract_all({_CITING}, '\b([A-Z]{{2}}\d{{5,}}[A-Z]\d?)\b', 1), lambda x, i: list_position(regexp_extract_all({_CITING}, '\b([A-Z]{{2}}\d{{5,}}[A-Z]\d?)\b', 1), x) = i) AS numbers, 
list_filter(list_concat(regexp_extract_all({_CITED_AT}, 'patents\.google\.com/patent/([A-Z]{{2}}[0-9A-Z]+)', 1), regexp_extract_all({_CITING}, '\b([A-Z]{{2}}\d{{5,}}[A-Z]\d?)\b', 1)), lambda x, i: list_position(list_concat(regexp_extract_all({_CITED_AT}, 'patents\.google\.com/patent/([A-Z]{{2}}[0-9A-Z]+)', 1), regexp_extract_all({_CITING}, '\b([A-Z]{{2}}\d{{5,}}[A-Z]\d?)\b', 1)), x) = i) AS of_hit FROM supplier""")
def patent_numbers(spark: SparkSession, sf: str) -> DataFrame:
    told = F.expr(_CITING)
    return table(spark, sf, "supplier").select("s_suppkey", patents.numbers_in(told).alias("numbers"), patents.numbers_of_hit(F.expr(_CITED_AT), told).alias("of_hit"))


@R.add("SELECT DISTINCT src, dst, direction FROM (SELECT l_orderkey AS src, l_partkey AS dst, 'backward' AS direction FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey, 'forward' FROM lineitem)")
def citation_edges(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("patent_id"), F.array(F.col("l_partkey").cast("string")).alias("citations_backward"), F.array(F.col("l_suppkey").cast("string")).alias("citations_forward"))
    return patents.citation_edges(lists).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "direction")


@R.add("SELECT DISTINCT 'C' || p_size AS code FROM part WHERE lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_partkey % 7 = 0)")
def field_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts as fields, each with the codes of its sizes; those wanted in another case."""
    part = table(spark, sf, "part")
    fields = part.groupBy(F.col("p_type").alias("name")).agg(F.sort_array(F.collect_set(F.concat(F.lit("C"), F.col("p_size").cast("string")))).alias("codes"))
    wanted = part.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("seq"), F.upper("p_type").alias("name"))
    return patents.field_codes(fields, wanted).select("code")


# Group names: every known one in turn, in other cases, longer, cut, empty and unknown.
_GROUP_NAMES = "[" + ", ".join(f"'{g}'" for g in contracts.GROUPS) + "]"
_GROUP_OF = "CASE p_partkey % 5 WHEN 0 THEN concat(' ', upper(g), ' ') WHEN 1 THEN concat('rare ', g, ' ii') WHEN 2 THEN substr(g, 1, 5) WHEN 3 THEN g ELSE CASE WHEN p_partkey % 10 = 4 THEN '' ELSE 'wood' END END"
_ADDRESS_OF = "concat('https://x.example/', CASE p_partkey % 8 WHEN 0 THEN 'Sugar-11' WHEN 1 THEN 'stock-index' WHEN 2 THEN 'carbon/oil' WHEN 3 THEN 'Metals' WHEN 4 THEN 'FX-gas' WHEN 5 THEN 'cotton-equity' ELSE 'y' END)"
_GROUP_MAP = "[" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in contracts.GROUPS.items()) + "]"


@R.add(f"""WITH n AS (SELECT p_partkey, {_GROUP_NAMES}[p_partkey % {len(contracts.GROUPS)} + 1] AS g FROM part), t AS (SELECT p_partkey, lower(trim({_GROUP_OF})) AS g, lower({_ADDRESS_OF}) AS a FROM n),
e AS (SELECT *, {_GROUP_MAP} AS m FROM t)
SELECT p_partkey, coalesce(list_filter(m, lambda x: x.k = g)[1].v, list_filter(m, lambda x: contains(g, x.k) OR contains(x.k, g))[1].v, '') AS of_group,
CASE WHEN regexp_matches(a, 'energy|oil|gas|power') THEN 'energy' WHEN regexp_matches(a, 'agriculture|agri|sugar|coffee|cocoa|cotton') THEN 'agriculture' WHEN regexp_matches(a, 'emission|carbon') THEN 'emissions' WHEN contains(a, 'metal') THEN 'metals'
WHEN regexp_matches(a, 'financial|interest|equity|fx|index') THEN 'financials' ELSE '' END AS of_address FROM e""")
def asset_classes(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").withColumn("g", F.element_at(F.array(*[F.lit(g) for g in contracts.GROUPS]), (F.col("p_partkey") % len(contracts.GROUPS) + 1).cast("int")))
    return named.select("p_partkey", contracts.class_of_group(F.expr(_GROUP_OF)).alias("of_group"), contracts.class_of_address(F.expr(_ADDRESS_OF)).alias("of_address"))


@R.add("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, map {'tick_value': p_brand} AS extras, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Head' ELSE 'Brent Crude' END AS name FROM part")
def contract_fields(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.create_map(F.lit("contractSize"), F.lit(""), F.lit("size"), F.col("p_size").cast("string"), F.lit("Tick Value"), F.col("p_brand"), F.lit("none"), F.lit(""))
    k = F.col("p_partkey") % 3
    name = contracts.product_name(F.when(k == 0, F.concat("p_brand", F.lit(" | Exchange"))).otherwise(""), F.when(k == 1, " Head ").otherwise(""), F.lit("https://x.example/products/brent-crude/?a=1"))
    return table(spark, sf, "part").select("p_partkey", contracts.first_of(raw, ("contractSize", "size")).alias("size"), contracts.without(raw, ("contractSize", "size")).alias("extras"), name.alias("name"))


# A specification page by a row's key, in words that Spark and DuckDB share: known, unknown and repeated labels, a head, several cells, empty ones.
_SPEC = """concat('<h1>Spec</h1><table><tr><th>Specification</th><td>x</td></tr><tr><th>Contract Symbol</th><td>', p_brand, '</td></tr><tr><td>Contract <b>Size</b></td><td><i>', p_size, '</i> t</td><td></td><td>lots</td></tr>',
CASE p_partkey % 3 WHEN 0 THEN '<tr><td>Tick Value</td><td>5</td></tr><tr><td>Minimum Tick</td><td>0.01</td></tr>' WHEN 1 THEN '<tr><td></td><td>no label</td></tr><tr><td>alone</td></tr>' ELSE '' END, '</table><p>between</p><table><tr><td>Listing (venue)</td><td>', p_type, '</td></tr><tr><td>%%</td><td>y</td></tr></table>')"""
_PLAIN = r"array_to_string(list_filter(string_split_regex(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> ''), ' ')"


@R.add(rf"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all({_SPEC}, '<tr>.*?</tr>')) AS r FROM part), c AS (SELECT p_partkey, list_transform(regexp_extract_all(r, '<t[hd]>(.*?)</t[hd]>', 1), lambda x: {_PLAIN.format("x")}) AS cells, row_number() OVER () AS o FROM t),
f AS (SELECT p_partkey, o, lower(cells[1]) AS label, array_to_string(list_filter(cells[2:], lambda x: x <> ''), ' | ') AS value FROM c WHERE len(cells) > 1 AND cells[1] <> ''),
n AS (SELECT p_partkey, o, coalesce(map {{{", ".join(f"'{k}': '{v}'" for k, v in contracts.LABELS.items())}}}[label], trim(regexp_replace(label, '[^a-z0-9_]', '_', 'g'), '_')) AS field, value FROM f WHERE label NOT IN ('specification', 'details', 'description'))
SELECT p_partkey, field, arg_max(value, o) AS value FROM n WHERE field <> '' GROUP BY p_partkey, field""")
def contract_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of specification pages by the labels of their tables."""
    pages = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type"))
    return pages.select("p_partkey", F.explode(contracts.fields_of(F.expr(_SPEC))).alias("field", "value"))


@R.add()
def spec_tables(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", contracts.specs("html").alias("fields"))


@R.add("SELECT page_id, [url, 'http://b.example/x'] AS urls FROM pages")
def split_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls_in(F.concat("url", F.lit("; ftp://no, \n http://b.example/x,"))).alias("urls"))


_SKIP_SQL = "|".join("^" + g.replace(".", r"\.").replace("*", ".*") + "$" for g in graph.SKIP)


@R.add(f"SELECT page_id, regexp_matches(lower(url), '{_SKIP_SQL}') AS skipped, regexp_matches(lower(url), '\\.pdf([?#].*)?$') AS pdf FROM pages")
def skipped_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", graph.is_skipped(F.col("url")).alias("skipped"), graph.is_pdf(F.col("url"), F.lit(None).cast("string")).alias("pdf"))


@R.add("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE c_name || CASE c_custkey % 3 WHEN 1 THEN '' ELSE ' International Group' END END AS short, c_custkey % 2 = 0 AS same FROM customer")
def search_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 3 == 0, " Inc.").when(k % 3 == 2, " International Group Ltd").otherwise(""))
    guard = name_guard(F.concat(F.lit("Firm"), k.cast("string"), F.lit(" Steel plc")), F.when(k % 2 == 0, F.concat(F.lit("FIRM"), k.cast("string"), F.lit(" steel holdings"))).otherwise("Other steel"))
    return table(spark, sf, "customer").select("c_custkey", search_name(name).alias("short"), guard.alias("same"))


@R.add(r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(url), '[ ./\\:*?"<>|,;''()-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+\z', '', 'g'), 1, 40) || '_crawl_2024Q1.parquet' AS tag FROM pages""")
def source_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.source_tag(F.col("url"), F.lit(None).cast("date"), "crawl", "2024-02-03").alias("tag"))


QUERIES, ORACLE_SQL = R.queries, R.sql
