"""Landed answers of search interfaces, built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import landed
from .common import Registry, table

R = Registry()

# Pages of five orders by customer: full ones, a short one at the end, some missing, some broken, one twice; words that Spark and DuckDB share.
_PAGES = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM {orders}),
g AS (SELECT o_custkey, CAST(floor(n / 5) AS BIGINT) AS p, {agg} AS x FROM o GROUP BY o_custkey, CAST(floor(n / 5) AS BIGINT)),
b AS (SELECT o_custkey, p * 5 AS start, CASE WHEN o_custkey % 11 = 0 AND p = 1 THEN '<html>' ELSE concat('{{"hits":{{"hits":[', x, ']}}}}') END AS body, p FROM g WHERE NOT (o_custkey % 4 = 0 AND p = 1) AND NOT (o_custkey % 9 = 0 AND p = 0))
SELECT o_custkey, start, body FROM b UNION ALL SELECT o_custkey, start, body FROM b WHERE p = 0 AND o_custkey % 3 = 0"""
_HIT = """concat('{{"_id":"o', o_orderkey, '","_source":{{"status":"', o_orderstatus, '"}}}}')"""
_SQL_PAGES = _PAGES.format(orders="orders", agg=f"string_agg({_HIT.format()}, ',' ORDER BY n)")
_READ = f"""WITH p AS (SELECT DISTINCT o_custkey, start, body, body NOT LIKE '<%' AS fine FROM ({_SQL_PAGES})),
h AS (SELECT o_custkey, start, CASE WHEN fine THEN list_transform(regexp_extract_all(body, '"_id":"([^"]*)"', 1), lambda x: x) END AS ids, CASE WHEN fine THEN regexp_extract_all(body, '"status":"([^"]*)"', 1) END AS sts FROM p),
c AS (SELECT *, (SELECT count(*) FROM h x WHERE x.o_custkey = h.o_custkey AND x.start < h.start AND len(x.ids) = 5) * 5 = start AS ok FROM h)"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    agg = f"listagg({_HIT.format()}, ',') WITHIN GROUP (ORDER BY n)"
    text = _PAGES.format(orders="__orders__", agg=agg).replace("{", "{{").replace("}", "}}").replace("__orders__", "{orders}")
    return spark.sql(text, orders=table(spark, sf, "orders"))


@R.add(_READ + " SELECT o_custkey, start + i AS n, ids[i + 1] AS id, sts[i + 1] AS status FROM (SELECT *, unnest(range(len(ids))) AS i FROM c WHERE ok AND ids IS NOT NULL) WHERE start + i < 12")
def offset_hits(spark: SparkSession, sf: str) -> DataFrame:
    """At most twelve hits of each customer's landed pages."""
    hits = landed.offset_hits(_pages(spark, sf), "o_custkey", 5, 12)
    return hits.selectExpr("o_custkey", "n", "id", "source['status'] AS status")


@R.add(_READ + """, l AS (SELECT o_custkey, max(start) AS start, arg_max(coalesce(len(ids), -1), start) AS n FROM c WHERE ok GROUP BY o_custkey)
SELECT o_custkey, CAST(CASE WHEN n < 0 THEN start ELSE start + 5 END AS BIGINT) AS next FROM l WHERE n >= 5 OR n < 0 UNION ALL SELECT DISTINCT o_custkey, 0 FROM c WHERE o_custkey NOT IN (SELECT o_custkey FROM l)""")
def page_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return landed.page_gaps(_pages(spark, sf), "o_custkey", 5)


# A work per part, with what is there or not by its key; some ids twice.
_WORK = """concat('{{"results":[{{"id":"https://openalex.org/W', p_partkey % 1500, '","', CASE WHEN p_partkey % 3 = 0 THEN 'display_name' ELSE 'title' END, '":"', p_brand, '","publication_year":', 2000 + p_size, ',"doi":', CASE WHEN p_partkey % 2 = 0 THEN concat('"https://doi.org/10.1/', p_partkey, '"') ELSE 'null' END,
',"cited_by_count":', CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE concat('', p_size) END, ',"abstract_inverted_index":', CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE concat('{{"', p_type, '":[2,0],"of":[1],"', p_brand, '":[3]}}') END,
',"authorships":[{{"author":{{"display_name":"A B"}}}},{{"author":null}},{{"author":{{"display_name":"', p_name, '"}}}}],"primary_location":', CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE concat('{{"landing_page_url":"https://l/', p_partkey, '","source":{{"display_name":"J"}}}}') END, '}},{{"id":null}}]}}')"""


@R.add("""WITH f AS (SELECT p_partkey % 1500 AS w, min(p_partkey) AS p_partkey FROM part GROUP BY 1) SELECT 'W' || w AS openalex_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS title, 'A B, , ' || p_name AS authors, CAST(2000 + p_size AS VARCHAR) AS year, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || ' of ' || p_type || ' ' || p_brand END AS abstract,
CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'J' END AS venue, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey ELSE '' END AS doi, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS BIGINT) AS citations,
CASE WHEN p_partkey % 4 > 0 THEN 'https://l/' || p_partkey ELSE 'https://openalex.org/W' || w END AS link FROM f JOIN part USING (p_partkey)""")
def landed_works(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of landed answers, one for each id."""
    found = landed.works(table(spark, sf, "part").selectExpr("p_partkey", f"{_WORK.format()} AS body"), "p_partkey")
    return found.select("openalex_id", "title", "authors", "year", "abstract", "venue", "doi", "citations", "link")


QUERIES, ORACLE_SQL = R.queries, R.sql
