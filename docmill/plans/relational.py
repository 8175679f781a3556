"""Join chains, lookups, top-k, set operations and event streams, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import entities as E
from ..operators import filters, graph
from ..operators.names import inside
from ..operators.select import distinct_in_order, keep_first, spread_numbers, top_per_key
from .common import Registry, table

R = Registry()


@R.add("""SELECT o.o_orderkey, c.c_name, a.l_partkey AS first_part, string_agg_codes.codes FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1) a ON a.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag, '; ' ORDER BY f, l_returnflag) AS codes FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS f FROM lineitem GROUP BY ALL) GROUP BY l_orderkey) string_agg_codes ON string_agg_codes.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= TIMESTAMP '1995-01-01' AND o.o_orderdate < TIMESTAMP '1996-01-01'""")
def patent_join_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Date filter first, then first detail, ordered distinct codes and the holder, each a left join."""
    orders = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    first = lines.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part")).withColumnRenamed("l_orderkey", "k1")
    codes = distinct_in_order(lines, "l_orderkey", "l_returnflag", "l_linenumber").select(F.col("l_orderkey").alias("k2"), F.col("l_returnflag").alias("codes"))
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = orders.join(first, F.col("o_orderkey") == F.col("k1"), "left").join(codes, F.col("o_orderkey") == F.col("k2"), "left").join(names, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("o_orderkey", "c_name", "first_part", "codes")


@R.add("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    return keep_first(lines, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop("l_suppkey")


@R.add("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'ECONOMY%' OR p_type LIKE 'PROMO%'")
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(filters.starts_with_any(F.array("p_type"), ["ECONOMY", "PROMO"])).select("p_partkey", "p_type")


@R.add("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def newest_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50)


@R.add("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) <= 3")
def limit_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return top_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 3).drop("o_orderdate")


@R.add("SELECT conv_id, role, max_by(turn, (length(text), -turn)) AS turn FROM (SELECT conv_id, role, turn, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id, role")
def keep_longest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return rows.groupBy("conv_id", "role").agg(F.max_by("turn", F.struct("n", -F.col("turn"))).alias("turn"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@R.add("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def permissive_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@R.add("SELECT DISTINCT link, source FROM (SELECT url AS link, 'pages' AS source FROM pages UNION ALL SELECT 'doc:' || doc_id, 'documents' FROM documents)")
def provenance_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "pages").select(F.col("url").alias("link"), F.lit("pages").alias("source"))
    return a.unionByName(table(spark, sf, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("link"), F.lit("documents").alias("source"))).distinct()


@R.add("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events ORDER BY value DESC, event_id LIMIT 500")
def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 of a queue by priority, ties in order of arrival; only those are numbered."""
    top = table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(500)
    return top.select("event_id", F.row_number().over(W.orderBy(F.desc("value"), "event_id")).alias("place"))


@R.add("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 500")
def lru_keep(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "user_id").limit(500)


@R.add(r"""SELECT doc_id, url_no FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS url_no FROM documents)""")
def running_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return spread_numbers(table(spark, sf, "documents").select("doc_id", "source"), [F.col("source")], [F.col("doc_id")], "url_no").drop("source")


FORMS = E.FORMS.replace("'", "''")
_ONCE = r"regexp_replace(trim(regexp_replace({0}, '(?i),?\s*\b(" + FORMS + r")\s*\z', '')), '\s*,+\s*\z', '')"
_NAME = "(c_name || CASE c_custkey % 4 WHEN 0 THEN ' Corp. Ltd.' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' GmbH' ELSE '' END)"


@R.add(f"SELECT c_custkey, lower({_ONCE.format(_ONCE.format(_ONCE.format(_NAME)))}) AS name FROM customer")
def entity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, " Corp. Ltd.").when(k == 1, ", Inc.").when(k == 2, " GmbH").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", E.normal_assignee(name).alias("name"))


@R.add("""WITH s AS (SELECT s_suppkey, 'x ' || lower(s_name) || ' unit' AS holder, lower(s_name) AS exact FROM supplier), c AS (SELECT s_suppkey AS ord, lower(s_name) AS n FROM supplier)
SELECT s_suppkey, coalesce((SELECT max(n) FROM c WHERE n = exact AND s_suppkey % 2 = 0), (SELECT min_by(n, ord) FROM c WHERE contains(holder, n))) AS company FROM s""")
def company_match(spark: SparkSession, sf: str) -> DataFrame:
    """Exact name, else the first company of the list whose name lies in the holder's."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("x "), F.lower("s_name"), F.lit(" unit")).alias("holder"), F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).alias("exact"))
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.lower("s_name").alias("n"))
    equal = s.join(c.groupBy("n").agg(F.max("ord").alias("ord")), F.col("exact") == F.col("n"), "left").select("s_suppkey", "holder", F.col("n").alias("hit"))
    part = inside(equal.filter("hit IS NULL").select("s_suppkey", "holder"), "holder", c, "n").groupBy("s_suppkey").agg(F.min_by("n", "ord").alias("part"))
    return equal.join(part, "s_suppkey", "left").select("s_suppkey", F.coalesce("hit", "part").alias("company"))


@R.add("""SELECT o_custkey, min_by(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey)) AS pick FROM orders GROUP BY o_custkey""")
def priority_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A preferred kind if there is one, else the first."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderkey"))).alias("pick"))


@R.add("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_quantity > 45)")
def nested_semi(spark: SparkSession, sf: str) -> DataFrame:
    hit = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45")
    return table(spark, sf, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@R.add(r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''), ' ') AS text FROM benchmark")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    """Word to positions, and back to text."""
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.array_remove(F.split("text", r"[ \t\n\r\f\x0B]+"), "")).alias("at", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("at").alias("places"))
    back = index.select("item_id", "word", F.explode("places").alias("at")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("p"))
    return back.select("item_id", F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("text"))


@R.add("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT -l_suppkey, l_partkey FROM lineitem),
b AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def bfs_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and their suppliers (negative), from part 1, to depth 3."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.bfs(edges, spark.range(1, 2).select(F.col("id").alias("node"), F.lit(0).alias("seed")), 3).select("node", "depth")


@R.add("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@R.add("SELECT e.event_id, max(p.ts) AS before FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts WHERE e.event_type <> 'purchase' GROUP BY e.event_id")
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase of the same user before each other event: one sort by user and time, no pairs."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    out = e.withColumn("before", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w))
    return out.filter("event_type <> 'purchase'").select("event_id", "before")


_LOG = "SELECT 'u' || user_id AS domain, event_id AS seq, [429, 403, 500, 200, 404][CAST(event_id % 5 AS INTEGER) + 1] AS status FROM events"
_FOLD = """WITH RECURSIVE l AS ({log}), n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS i FROM l),
f AS (SELECT domain, CAST(0 AS BIGINT) AS i, CAST({start} AS DOUBLE) AS d FROM (SELECT DISTINCT domain FROM l) UNION ALL
SELECT f.domain, n.i, {step} FROM f JOIN n ON n.domain = f.domain AND n.i = f.i + 1)
SELECT domain, round(arg_max(d, i), 9) AS delay, CAST(max(i) AS INTEGER) AS n FROM f GROUP BY domain"""

DELAY_SQL = _FOLD.format(log=_LOG, start="0", step="CASE WHEN status < 400 THEN d / 2 WHEN status = 429 THEN least(30, (CASE d WHEN 0 THEN 1 ELSE d END) * 2) WHEN status = 403 THEN least(30, (CASE d WHEN 0 THEN 1 ELSE d END) * 1.5) WHEN status >= 500 THEN least(30, (CASE d WHEN 0 THEN 1 ELSE d END) * 1.25) ELSE d END")
SYNC_SQL = _FOLD.format(log=_LOG, start="1", step="CASE WHEN status < 400 THEN greatest(1, d * 0.75) WHEN status = 429 THEN least(60, d * 3) WHEN status IN (401, 403) THEN least(60, d * 2) WHEN status >= 500 THEN least(60, d * 1.5) ELSE d END")


def _fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (429, 403, 500, 200, 404)]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("domain"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("double").alias("retry_after"))


@R.add(DELAY_SQL)
def throttle_states(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.throttle import fold_delays

    return fold_delays(_fetch_log(spark, sf)).withColumn("delay", F.round("delay", 9))


@R.add(SYNC_SQL)
def throttle_sync(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.throttle import fold_sync_delays

    return fold_sync_delays(_fetch_log(spark, sf)).withColumn("delay", F.round("delay", 9))


@R.add("""WITH s AS (SELECT event_id, user_id, event_id % 3 = 0 AS limited, event_id % 4 AS results FROM events),
c AS (SELECT *, coalesce(max(CASE WHEN NOT limited AND results > 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS came FROM s)
SELECT c.event_id, CAST(least(120, 15 * count(x.event_id)) AS BIGINT) AS cooldown FROM c LEFT JOIN s x ON x.user_id = c.user_id AND x.limited AND x.event_id > c.came AND x.event_id < c.event_id GROUP BY c.event_id""")
def search_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.throttle import cooldowns

    searches = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 3 == 0).alias("limited"), (F.col("event_id") % 4).alias("results"))
    return cooldowns(searches, "user_id", "event_id").select("event_id", F.col("cooldown").cast("long").alias("cooldown"))


QUERIES, ORACLE_SQL = R.queries, R.sql
