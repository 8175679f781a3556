"""Lookups with precedence over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names, resolve
from .common import Registry, table

R = Registry()


@R.add("""WITH l AS (SELECT l_orderkey AS isin, min_by('T' || l_partkey, (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber, l_partkey)) AS listed FROM lineitem GROUP BY 1),
r AS (SELECT 'T' || p_partkey AS t, min(p_partkey) AS cik FROM part WHERE p_partkey % 3 > 0 GROUP BY 1),
w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN listed ELSE 'T' || (o_custkey % 500) END AS want FROM orders LEFT JOIN l ON isin = o_orderkey AND o_orderkey % 2 = 0)
SELECT o_orderkey, t AS resolved, cik FROM w LEFT JOIN r ON t = want""")
def identifier_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A row with an identifier takes its preferred listing and nothing else; others their own ticker; both must be registered."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("t"), (F.col("o_custkey") % 500).cast("string")).alias("ticker"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("").alias("isin"))
    listings = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("isin"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("ticker"), (F.col("l_returnflag") == "R").alias("preferred"), F.struct("l_linenumber", "l_partkey").alias("seq"))
    registry = table(spark, sf, "part").filter("p_partkey % 3 > 0").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_partkey").alias("cik"))
    return resolve.by_identifier(rows, listings, registry).select("o_orderkey", "resolved", "cik")


@R.add("""WITH c AS (SELECT c_name AS company, CASE WHEN c_custkey % 2 = 0 THEN CAST(1000 + c_custkey % 9000 AS VARCHAR) ELSE 'none' END AS ticker FROM customer),
f AS (SELECT o_orderkey AS filing, CAST(1000 + o_custkey % 9000 AS VARCHAR) || '0' AS code, c_name AS filer FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT DISTINCT company, ticker, filing FROM c JOIN f ON ticker = code OR ticker = substr(code, 1, 4))
SELECT * FROM a UNION ALL SELECT company, ticker, filing FROM c JOIN f ON company = filer WHERE (company, ticker) NOT IN (SELECT company, ticker FROM a)""")
def filing_match(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda c: (F.col(c) % 9000 + 1000).cast("string")
    firms = table(spark, sf, "customer").select(F.col("c_name").alias("company"), F.when(F.col("c_custkey") % 2 == 0, number("c_custkey")).otherwise("none").alias("ticker"))
    firms_by_key = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("filer_name"))
    filings = table(spark, sf, "orders").join(firms_by_key, "o_custkey").select(F.col("o_orderkey").alias("filing"), F.concat(number("o_custkey"), F.lit("0")).alias("sec_code"), "filer_name")
    return resolve.by_code_or_name(firms, filings)


@R.add("SELECT l_orderkey, min_by(l_linenumber, (CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_linenumber)) AS hit FROM lineitem GROUP BY l_orderkey")
def title_else_first(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "lineitem").select("l_orderkey", F.lit("a").alias("wanted"), F.col("l_returnflag").alias("title"), "l_linenumber")
    return resolve.exact_else_first(hits, "l_orderkey", "wanted", "title", "l_linenumber").select("l_orderkey", F.col("l_linenumber").alias("hit"))


@R.add("""SELECT s_suppkey, (SELECT max(p_partkey) FROM part WHERE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) = 'brand ' || (10 + s_suppkey % 60)) AS doc_id FROM supplier""")
def cited_titles(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("BRAND: "), (F.col("s_suppkey") % 60 + 10).cast("string"), F.lit("!")).alias("title"))
    return resolve.by_title(cited, table(spark, sf, "part").select(F.col("p_brand").alias("title"), F.col("p_partkey").alias("doc_id"))).select("s_suppkey", "doc_id")


@R.add("SELECT k AS pdf, min_by(v, (part, seq)) AS name FROM (SELECT o_custkey AS k, o_orderstatus AS v, 0 AS part, o_orderkey AS seq FROM orders UNION ALL SELECT c_custkey, c_name, 1, c_custkey FROM customer) GROUP BY k")
def readable_name_map(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("pdf"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("seq"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("pdf"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return resolve.first_source([a, b], "pdf", "name", "seq")


@R.add("SELECT id, min(source) AS source FROM (SELECT l_partkey AS id, 0 AS source FROM lineitem UNION ALL SELECT p_partkey, 1 FROM part) GROUP BY id")
def id_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("seq"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"))
    spare = table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("seq"))
    return resolve.ids_of_sources([a, b], spare)


@R.add("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size, p_partkey % 3 <> 0 AS from_cache FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def recovered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A third fetched; of the rest what the cache (the even ones, without sizes) has."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    return resolve.recovered(parts, parts.filter("id % 3 = 0"), parts.filter("id % 2 = 0").select("id", "title"))


@R.add("SELECT o_orderkey, p_partkey, p_name FROM orders JOIN part ON p_partkey = o_orderkey % 3000 WHERE o_orderkey % 3000 > 0")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """By the digits of a US number, without leading zeros."""
    from ..functions.patents import us_number

    asked = table(spark, sf, "orders").select("o_orderkey", us_number(F.concat(F.lit("US00"), (F.col("o_orderkey") % 3000).cast("string"), F.lit("B2"))).cast("long").alias("p_partkey")).filter("p_partkey > 0")
    return asked.join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select("o_orderkey", "p_partkey", "p_name")


@R.add("SELECT c_custkey, min(CAST(o_orderdate AS DATE)) AS first_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def first_date(spark: SparkSession, sf: str) -> DataFrame:
    dates = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("first_date"))
    return table(spark, sf, "customer").select("c_custkey").join(dates, "c_custkey", "left")


@R.add()
def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a letter changed, against the list."""
    asked = table(spark, sf, "supplier").select(F.regexp_replace(F.lower("s_name"), "^s", "z").alias("name"))
    return names.similar_names(asked, table(spark, sf, "supplier").select(F.lower("s_name").alias("found"), F.col("s_suppkey").alias("seq")))


@R.add("SELECT event_id, start, n FROM (SELECT date_trunc('hour', ts) + INTERVAL 30 MINUTE * k AS start, count(*) AS n, min(event_id) AS event_id FROM (SELECT event_id, ts, k FROM events, (SELECT unnest([-1, 0, 1]) AS k)) WHERE ts >= date_trunc('hour', ts) + INTERVAL 30 MINUTE * k AND ts < date_trunc('hour', ts) + INTERVAL 30 MINUTE * k + INTERVAL 1 HOUR GROUP BY 1)")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"))
    return e.select("event_id", F.col("w.start").alias("start"), "n")


QUERIES, ORACLE_SQL = R.queries, R.sql
