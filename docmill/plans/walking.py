"""Walks over landed pages, admission over runs, and delay machines as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage, shared_folder
from ..operators import crawl
from .common import Registry, table
from .relational import DELAY_SQL, SYNC_SQL

R = Registry()


# -- sitemaps ----------------------------------------------------------------

_NS = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
#: One landed site per nation: a robots.txt or a usual place, an index, sitemaps that are indexes themselves, broken ones, and none at all.
_LANDED = f"""
WITH site AS (SELECT n_nationkey AS n, concat('https://d', n_nationkey, '.example') AS home FROM nation),
one AS (SELECT s_nationkey AS n, s_suppkey AS s, concat('https://d', s_nationkey, '.example') AS home FROM supplier),
goods AS (SELECT c_nationkey AS n, c_custkey AS c, concat('<url><loc>https://d', c_nationkey, '.example', CASE WHEN c_custkey % 6 = 0 THEN '/Jobs/' ELSE '/c/' END, c_custkey, '</loc></url>') AS x FROM customer),
leaf AS (SELECT one.n, s, home, string_agg(x, '' ORDER BY c) AS xs FROM one JOIN goods ON goods.n = one.n AND c % 7 = s % 7 GROUP BY one.n, s, home)
SELECT concat(home, '/robots.txt') AS url, concat('User-agent: *', chr(10), 'Sitemap: ', home, '/map.xml', chr(10), ' SITEMAP:', home, '/extra.xml ', chr(10)) AS body FROM site WHERE n % 2 = 0
UNION ALL SELECT concat(home, '/extra.xml'), concat('<urlset{_NS}><url><loc>', home, '/extra</loc></url><url><loc>', home, '/login/x</loc></url></urlset>') FROM site
UNION ALL SELECT concat(home, CASE WHEN n % 2 = 0 THEN '/map.xml' WHEN n % 4 = 1 THEN '/sitemap.xml' WHEN n % 8 = 3 THEN '/sitemap_index.xml' ELSE '/hidden.xml' END),
  concat('<sitemapindex{_NS}>', string_agg(concat('<sitemap><loc>', home, '/s', s, '.xml</loc></sitemap>'), '' ORDER BY s), '</sitemapindex>') FROM one GROUP BY n, home
UNION ALL SELECT concat(home, '/s', s, '.xml'), concat('<sitemapindex{_NS}><sitemap><loc>', home, '/t', s, '.xml</loc></sitemap><sitemap><loc>', home, '/s', s, '.xml</loc></sitemap></sitemapindex>') FROM one WHERE s % 5 = 0
UNION ALL SELECT concat(home, CASE WHEN s % 5 = 0 THEN '/t' ELSE '/s' END, s, '.xml'), concat('<urlset{_NS}>', xs, CASE WHEN s % 11 = 0 THEN '' ELSE '</urlset>' END) FROM leaf
"""
_LEAF = "concat(home, CASE WHEN s % 5 = 0 THEN '/t' ELSE '/s' END, s, '.xml')"


@R.add(f"""WITH RECURSIVE landed AS MATERIALIZED (SELECT url, body, contains(lower(substr(body, 1, 500)), '<sitemapindex') AS idx,
  CASE WHEN body LIKE '%</urlset>' OR body LIKE '%</sitemapindex>' THEN regexp_extract_all(body, '<loc>([^<]*)</loc>', 1) ELSE [] END AS locs FROM ({_LANDED})),
homes AS (SELECT 'd' || n_nationkey || '.example' AS domain FROM nation),
listed AS (SELECT domain, unnest(urls) AS url, unnest(range(len(urls))) AS pos FROM (SELECT domain, regexp_extract_all(body, '(?i)sitemap:[ ]*([^ \\n]+)', 1) AS urls FROM homes JOIN landed ON url = 'https://' || domain || '/robots.txt')),
usual AS (SELECT domain, url, pos FROM homes, (SELECT unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap/']) AS place, unnest([0, 1, 2]) AS pos) JOIN landed ON url = 'https://' || domain || place
  WHERE domain NOT IN (SELECT domain FROM listed) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pos) = 1),
tree(domain, url, place) AS (SELECT domain, url, [pos]::BIGINT[] FROM (SELECT * FROM listed UNION ALL SELECT * FROM usual) UNION ALL
  SELECT domain, unnest(locs[:20]), list_concat(place, unnest(list_transform(range(len(locs[:20])), lambda x: [x]))) FROM tree JOIN landed USING (url) WHERE idx AND len(place) < 3),
visited AS (SELECT domain, url, min(place) AS place FROM tree GROUP BY domain, url),
found AS (SELECT domain, place, unnest(locs) AS url, unnest(range(len(locs))) AS pos FROM visited JOIN landed USING (url) WHERE NOT idx),
numbered AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY place, pos) AS n FROM found WHERE NOT regexp_matches(lower(regexp_replace(url, '^https?://[^/]*', '')), '/login|/jobs'))
SELECT domain, url, CAST(n AS INTEGER) AS n FROM numbered WHERE n <= 2000
UNION ALL SELECT domain, 'https://' || domain || '/', 1 FROM homes WHERE domain NOT IN (SELECT domain FROM numbered)""")
def sitemap_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of a site per nation, from its robots.txt, indexes of two levels and sitemaps; a site without any has its homepage."""
    given = {n: table(spark, sf, n) for n in ("nation", "supplier", "customer")}
    text = _LANDED.replace("chr(10)", "char(10)")
    for name in given:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    index = "concat('<sitemap><loc>', home, '/s', s, '.xml</loc></sitemap>')"
    text = text.replace(f"string_agg({index}, '' ORDER BY s)", f"listagg({index}, '') WITHIN GROUP (ORDER BY s)")
    # A sitemap's addresses depend on its site and number % 7 alone: joined once for these, and with those sitemaps only that a walk asks for.
    goods = text[text.index("goods AS (") + len("goods AS (") : text.index("),\nleaf AS")]
    shelf = cut_lineage(spark.sql(f"SELECT n, c % 7 AS k, listagg(x, '') WITHIN GROUP (ORDER BY c) AS xs FROM ({goods}) GROUP BY n, c % 7", customer=given["customer"]))
    leaf = text[text.index("leaf AS (") : text.index("\nSELECT concat(home, '/robots.txt')")]
    text = text.replace(leaf, f"leaf AS (SELECT one.n, s, home, xs FROM one LEFT SEMI JOIN {{asked}} a ON a.url = {_LEAF} JOIN {{shelf}} f ON f.n = one.n AND f.k = s % 7)")

    def landed(asked: DataFrame) -> DataFrame:
        return asked.join(spark.sql(text, **given, shelf=shelf, asked=asked.select("url").distinct()), "url")

    domains = table(spark, sf, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("domain"))
    return crawl.sitemap_seeds(domains, landed)


# -- best first --------------------------------------------------------------

_S = "concat('https://{host}', CASE WHEN {k} % 10 = 9 THEN '/login/s' WHEN {k} % 4 = 0 THEN '/annual-report-2021/s' ELSE '/supplier/s' END, {k})"
SUPPLIER_URL = f"CASE WHEN {{k}} % 10 = 8 THEN {_S.replace('{host}', 'other.example')} ELSE {_S.replace('{host}', 'WWW.shop.example:80')} END"
PART_URL = "concat('https://shop.example/', CASE {k} % 3 WHEN 0 THEN 'news/2024/' WHEN 1 THEN 'market/x/' ELSE '' END, 'p', {k})"


def _crawl_sql(pages: int, at_once: int, depth: int) -> str:
    """The heap's rounds one after the other, each over the frontier that the one before left.

    A round that pops fewer than ``at_once`` empties the frontier, so what follows is deeper:
    there are at most depth + 1 such rounds besides the full ones.
    """
    rounds = depth + 1 + -(-pages // at_once)
    hits = " + ".join(f"CAST(contains(lower(url), '{w}') AS INT)" for w in crawl.SIGNALS)
    path = "regexp_replace(regexp_replace(url, '[?#].*', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"
    year = f"nullif(regexp_extract({path}, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1), '')"
    depth_of = f"len(list_filter(string_split({path}, '/'), lambda x: x <> ''))"
    score = f"round(0.8 * (({hits}) / {len(crawl.SIGNALS)}) + 0.3 / (1 + abs({depth_of} - 1)) + 0.15 * CASE WHEN {year} IS NULL THEN 0.5 ELSE 1 / (1 + abs(2025 - CAST({year} AS INT))) END, 9)"
    out = f"""WITH pairs AS (SELECT {SUPPLIER_URL.format(k="l_suppkey")} AS s, {PART_URL.format(k="l_partkey")} AS p, l_orderkey * 8 + l_linenumber AS pos FROM lineitem),
    links AS MATERIALIZED (SELECT url, target, min(pos) AS pos FROM (SELECT s AS url, p AS target, pos FROM pairs UNION ALL SELECT p, s, pos FROM pairs) WHERE NOT contains(lower(target), '/login') GROUP BY ALL),
    open0 AS (SELECT {SUPPLIER_URL.format(k="s_suppkey")} AS seed, s_name AS query, {SUPPLIER_URL.format(k="s_suppkey")} AS url, 0 AS depth, 0.0::DOUBLE AS score, 0::BIGINT AS came FROM supplier), seen0 AS (SELECT seed, url FROM open0), done0 AS (SELECT seed, 0::BIGINT AS done FROM open0)"""
    for r in range(rounds):
        out += f""",
    now{r} AS MATERIALIZED (SELECT * EXCLUDE (rank, done), CAST(rank + done AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, came, url) AS rank FROM open{r}) JOIN done{r} USING (seed) WHERE rank <= {at_once} AND rank + done <= {pages}),
    done{r + 1} AS MATERIALIZED (SELECT seed, done + (SELECT count(*) FROM now{r} n WHERE n.seed = d.seed) AS done FROM done{r} d),
    fresh{r} AS MATERIALIZED (SELECT seed, query, url, depth, {score} AS score, came FROM (
      SELECT seed, query, target AS url, arg_min(depth + 1, (nth, pos)) AS depth, min(CAST(nth AS BIGINT) * 4294967296 + pos) AS came FROM now{r} JOIN links USING (url)
      WHERE depth < {depth} AND contains(lower(target), 'shop.example') = contains(lower(seed), 'shop.example') GROUP BY seed, query, target) f WHERE (seed, url) NOT IN (SELECT (seed, url) FROM seen{r})),
    seen{r + 1} AS MATERIALIZED (SELECT * FROM seen{r} UNION ALL SELECT seed, url FROM fresh{r}),
    open{r + 1} AS MATERIALIZED (SELECT * FROM open{r} WHERE (seed, url) NOT IN (SELECT (seed, url) FROM now{r}) UNION ALL SELECT * FROM fresh{r})"""
    return out + "\n" + " UNION ALL ".join(f"SELECT seed, query, url, depth, score, nth FROM now{r}" for r in range(rounds))


@R.add(_crawl_sql(30, 10, 2))
def best_first_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """From every supplier's page over the links of what was ordered, 30 pages each, with scores by signal words, depth and year."""
    pairs = table(spark, sf, "lineitem").select(F.expr(SUPPLIER_URL.format(k="l_suppkey")).alias("s"), F.expr(PART_URL.format(k="l_partkey")).alias("p"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    links = pairs.select(F.col("s").alias("url"), F.col("p").alias("target"), "at").unionByName(pairs.select(F.col("p").alias("url"), F.col("s").alias("target"), "at"))
    seeds = table(spark, sf, "supplier").select(F.expr(SUPPLIER_URL.format(k="s_suppkey")).alias("seed"), F.col("s_name").alias("query"))
    return crawl.best_first_crawl(links, seeds, lambda url: crawl.url_score(url, 2025), pages=30)


# -- runs and streams --------------------------------------------------------


@R.add()
def near_admission(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, run, kept): all documents in two runs over one index, those of even ids first; each run opens the index anew."""
    from ..streaming.index import NearIndex

    docs = table(spark, sf, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    out = None
    for run in (0, 1):
        rows = docs.filter(F.col("doc_id") % 2 == run)
        kept = NearIndex(spark, folder).admit(rows, "text", "doc_id").withColumn("kept", F.lit(True))
        part = rows.select("doc_id", F.lit(run).alias("run")).join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
        out = part if out is None else out.unionByName(part)
    return out


def _streamed(spark: SparkSession, folder: str, stream: DataFrame, mode: str) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/part={n}")) if mode == "update" else writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream.  A pattern stands for a table of one file as well as for a folder of files."""
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def _delays(spark: SparkSession, sf: str, machine: str) -> DataFrame:
    from ..streaming import machines

    machines.state_store(spark)
    status = F.element_at(F.array(*[F.lit(x) for x in (429, 403, 500, 200, 404)]), (F.col("event_id") % 5 + 1).cast("int"))
    log = _events(spark, sf).select(F.concat(F.lit("u"), "user_id").alias("domain"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("double").alias("retry_after"))
    folder = f"{shared_folder(spark)}/delays-{uuid.uuid4().hex}"
    _streamed(spark, folder, machines.stream_delays(log, machine), "update")
    last = spark.read.parquet(f"{folder}/out").groupBy("domain").agg(F.max_by(F.struct("delay", "n"), "batch").alias("x"))
    return last.select("domain", F.round("x.delay", 9).alias("delay"), F.col("x.n").cast("int").alias("n"))


@R.add(DELAY_SQL)
def throttle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The delay of each domain after a stream of fetches, by keyed state."""
    return _delays(spark, sf, "async")


@R.add(SYNC_SQL)
def throttle_sync_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _delays(spark, sf, "sync")


@R.add("""WITH s AS (SELECT event_id, user_id, event_id % 3 = 0 AS limited, event_id % 4 AS results FROM events),
c AS (SELECT *, coalesce(max(CASE WHEN NOT limited AND results > 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS came FROM s)
SELECT c.event_id, CAST(least(120, 15 * count(x.event_id)) AS BIGINT) AS cooldown FROM c LEFT JOIN s x ON x.user_id = c.user_id AND x.limited AND x.event_id > c.came AND x.event_id < c.event_id GROUP BY c.event_id""")
def cooldown_stream(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import machines

    machines.state_store(spark)
    searches = _events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("limited"), (F.col("event_id") % 4).alias("results"))
    folder = f"{shared_folder(spark)}/cooldowns-{uuid.uuid4().hex}"
    _streamed(spark, folder, machines.stream_cooldowns(searches), "append")
    return spark.read.parquet(f"{folder}/out").select(F.col("seq").alias("event_id"), "cooldown")


QUERIES, ORACLE_SQL = R.queries, R.sql
