"""Summaries, predicates, text functions and de-duplication over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import base_domain, content_hash, host, url_hash, url_key
from ..operators import dedup, filters, mining, taxonomy
from ..operators.select import keep_first, top_per_key
from .common import Registry, table

R = Registry()
WORDS = "array_to_string(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), ' ')"
SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
KEY = r"regexp_replace(lower(regexp_replace(url, '#(?s:.*)', '')), '/+\z', '')"


@R.add("SELECT count(*) AS n, count(DISTINCT source) AS sources, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents")
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@R.add("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@R.add("SELECT source, CAST(avg(n_chars) AS DOUBLE) AS mean_chars FROM documents GROUP BY source")
def mean_length_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_chars"))


@R.add(f"SELECT CAST(sum(w) AS BIGINT) AS total, min(w) AS least, max(w) AS most, CAST(median(w) AS DOUBLE) AS middle, CAST(coalesce(sum(w) // count(*), 0) AS BIGINT) AS average FROM (SELECT CAST(len({SPLIT}) AS INTEGER) AS w FROM documents)")
def word_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.size(T.ascii_words(F.col("text"))).alias("w"))
    return w.agg(F.sum("w").alias("total"), F.min("w").alias("least"), F.max("w").alias("most"), F.percentile("w", 0.5).alias("middle"), F.coalesce(F.expr("sum(w) div count(*)"), F.lit(0)).alias("average"))


@R.add("SELECT date_trunc('month', ts) AS month, count(*) AS n FROM events GROUP BY 1")
def monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT toxic, quality, count(*) AS n, count(*) * 100 // sum(count(*)) OVER () AS percent FROM labels GROUP BY toxic, quality")
def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "labels").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("toxic", "quality", "n", F.expr("n * 100 div all").alias("percent"))


@R.add(f"SELECT page_id, {HOST} AS host, CASE WHEN len(string_split({HOST}, '.')) > 2 THEN array_to_string(string_split({HOST}, '.')[-2:], '.') ELSE {HOST} END AS domain, {KEY} AS url_key, sha256({KEY}) AS url_hash FROM pages")
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", host(u).alias("host"), base_domain(host(u)).alias("domain"), url_key(u).alias("url_key"), url_hash(u).alias("url_hash"))


@R.add(f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY page_id) = 1")
def url_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.url_dedup(table(spark, sf, "pages").select("page_id", "url"))


@R.add("SELECT doc_id, sha256(substr(text, 1, 2000)) AS content_hash FROM documents QUALIFY coalesce(text, '') = '' OR row_number() OVER (PARTITION BY substr(text, 1, 2000) ORDER BY doc_id) = 1")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"), (F.coalesce("text", F.lit("")) == "").alias("blank"))
    return keep_first(docs.filter("not blank"), ["content_hash"], [F.col("doc_id")]).unionByName(docs.filter("blank")).drop("blank")


def _first_sentence(c: str) -> F.Column:
    return F.regexp_extract(F.col(c), r"^([^.]{10,})\.", 1)


@R.add(r"SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE regexp_extract(b.text, '^([^.]{10,})\.', 1) = regexp_extract(d.text, '^([^.]{10,})\.', 1) AND regexp_extract(d.text, '^([^.]{10,})\.', 1) <> '')")
def cross_corpus_new(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", _first_sentence("text").alias("k"))
    seen = table(spark, sf, "benchmark").select(_first_sentence("text").alias("k")).filter("k <> ''").distinct()
    return docs.join(seen, "k", "left_anti").select("doc_id", "source")


@R.add("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def labelled_semi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi")


SHINGLES = f"""w AS (SELECT doc_id, {SPLIT} AS w FROM documents WHERE trim(text) <> ''),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w))"""
PAIRS = f"""{SHINGLES}, n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(31) ORDER BY s)) AS h FROM s GROUP BY doc_id),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS rep FROM n), r AS (SELECT s.doc_id, s.s FROM s JOIN c USING (doc_id) WHERE c.rep = c.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM r x JOIN r y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, k / (na.n + nb.n - k) AS jaccard FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k / (na.n + nb.n - k) >= 0.85 UNION ALL SELECT rep, doc_id, 1.0 FROM c WHERE rep <> doc_id)"""


@R.add(f"WITH {SHINGLES} SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id")
def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("trim(text) <> ''").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@R.add(f"WITH {PAIRS} SELECT a, b, CAST(round(jaccard, 6) AS DOUBLE) AS jaccard FROM e")
def near_dup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.similar_pairs(table(spark, sf, "documents")).withColumn("jaccard", F.round("jaccard", 6))


@R.add()
def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.greedy_near(docs)


@R.add()
def paper_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Two keys, either kills: the source id embedded in the text's first words, and the normalised title."""
    docs = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.concat_ws("/", "source", "n_chars").alias("doi"))
    return dedup.greedy_by_keys(docs, [F.lower("doi"), T.normal_title(F.col("title"))], "doc_id")


@R.add()
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("clean"))


@R.add(r"""SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')) AS title, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet,
substr(regexp_replace(regexp_replace(lower(substr(text, 1, 80)), '[^a-z0-9]+', '_', 'g'), '^_+|_+\z', '', 'g'), 1, 60) AS slug FROM documents""")
def titles_and_slugs(spark: SparkSession, sf: str) -> DataFrame:
    head = F.substring("text", 1, 80)
    return table(spark, sf, "documents").select("doc_id", T.normal_title(head).alias("title"), T.snippet(F.col("text")).alias("snippet"), T.slug(head).alias("slug"))


#: Chunks as a recursion over (k, text) of a table t: from where the last one ended, to the last blank line or else sentence end of the second half.
CHUNK_SQL = r"""c(k, ix, start, stop, text) AS (SELECT k, -1, 0::BIGINT, 0::BIGINT, coalesce(text, '') FROM t UNION ALL
SELECT k, ix + 1, stop, CASE WHEN length(text) - stop <= 5000 THEN length(text) WHEN a > 0 AND 4999 - a >= 2500 THEN least(stop + 4999 - a + 2, stop + 5000) WHEN b > 0 AND 4999 - b >= 2500 THEN least(stop + 4999 - b + 2, stop + 5000) ELSE stop + 5000 END, text
FROM (SELECT *, strpos(reverse(substr(text, stop + 1, 5000)), chr(10) || chr(10)) AS a, strpos(reverse(substr(text, stop + 1, 5000)), ' .') AS b FROM c WHERE stop < length(text) OR ix = -1)),
chunked AS (SELECT k, ix AS chunk_ix, substr(text, start + 1, stop - start) AS chunk FROM c WHERE ix >= 0)"""


@R.add(f"WITH RECURSIVE t AS (SELECT doc_id AS k, text FROM documents), {CHUNK_SQL} SELECT k AS doc_id, chunk_ix, chunk, CASE WHEN length(chunk) > 200 THEN substr(chunk, 1, 200) || '...' ELSE chunk END AS snippet FROM chunked")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"))).alias("chunk_ix", "chunk"))
    return docs.withColumn("snippet", T.snippet(F.col("chunk"), 200))


@R.add(f"""SELECT CASE WHEN text IS NULL OR len({SPLIT}) < 100 THEN 'short' WHEN regexp_matches(text, '!!') THEN 'shouting' WHEN dup > 1 THEN 'duplicate' ELSE 'kept' END AS outcome, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 2000) ORDER BY doc_id) AS dup FROM documents) GROUP BY 1""")
def funnel_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return filters.funnel(docs, [("short", F.size(T.ascii_words(F.col("text"))) < 100), ("shouting", F.col("text").contains("!!"))], "text", "doc_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


FUNNEL_PAGES = r"""WITH t AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS source, regexp_replace(lower(regexp_replace(url, '#(?s:.*)', '')), '/+\z', '') AS k,
trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages),
w AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM t), u AS (SELECT * FROM w WHERE words >= 100 QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 2000) ORDER BY page_id) = 1)
SELECT source, count(*) AS n, CAST(round(avg(words), 6) AS DOUBLE) AS mean_words FROM c GROUP BY source"""


@R.add(FUNNEL_PAGES)
def funnel_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to documents: tags off, at least 100 words, first of each URL and of each content; counts by source."""
    raw = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    rows = table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("source"), url_hash(F.col("url")).alias("k"), F.trim(F.regexp_replace(raw, r"[ \t\n\r\f\x0B]+", " ")).alias("text"))
    rows = rows.select("page_id", "source", "k", F.size(T.ascii_words(F.col("text"))).alias("words"), content_hash(F.col("text")).alias("c")).filter("words >= 100")
    rows = keep_first(keep_first(rows, ["k"], [F.col("page_id")]), ["c"], [F.col("page_id")])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("words"), 6).alias("mean_words"))


@R.add(r"SELECT doc_id, (CAST(regexp_matches(text, '(?i)52\s+week\s+(range|high|low)') AS INT) + CAST(regexp_matches(text, '(?i)EPS\s*\(TTM\)') AS INT) + CAST(regexp_matches(text, '(?i)P/E\s*\(TTM\)') AS INT) + CAST(regexp_matches(text, '(?i)Prev(ious)?\s*Close') AS INT)) >= 3 AS ticker_page, regexp_matches(text, '(?i)Nature\s+Index') AND regexp_matches(text, '(?i)Collaboration\s+Score') AS profile_page FROM documents")
def page_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", filters.is_ticker_page(F.col("text")).alias("ticker_page"), filters.is_profile_page(F.col("text")).alias("profile_page"))


LENIENT = "coalesce(CAST(try_strptime(substr(d, 1, 19), '%Y-%m-%dT%H:%M:%S') AS DATE), CAST(try_strptime(substr(d, 1, 10), '%Y-%m-%d') AS DATE), CAST(try_strptime(substr(d, 1, 7), '%Y-%m') AS DATE), CAST(try_strptime(substr(d, 1, 4), '%Y') AS DATE))"


@R.add(f"""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m') WHEN 3 THEN 'not-a-date' END AS d, CAST(ts AS DATE) AS t FROM events)
SELECT CASE WHEN {LENIENT} IS NULL THEN 'unparseable' WHEN {LENIENT} BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'inside' ELSE 'outside' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def date_filter_lenient(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 5
    d = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd")).when(kind == 2, F.date_format("ts", "yyyy-MM")).when(kind == 3, "not-a-date")
    return table(spark, sf, "events").select(filters.date_outcome(d, "2024-01-10", "2024-01-20").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_RULES = {
    "relevance_and": "{a} AND {b}", "relevance_and_not": "{a} AND {b} AND NOT {off}", "relevance_strong_weak": "(({a} AND {c}) OR ({b} AND {d})) AND NOT {off}",
    "relevance_context": "({a} OR (({b} OR ({c} AND {d})) AND {e})) AND NOT {off}", "relevance_rescue": "{a} AND {b} AND (NOT {off} OR {title})", "relevance_core": "{a} AND {b} AND {c} AND NOT {off} AND NOT ({d} AND NOT {e})",
}
_TERMS = {"a": "(?i)tion", "b": "(?i)the", "c": "(?i)ing", "d": "(?i)able|ible", "e": "(?i)ness|ment", "off": "(?i)[*]{3}|!!", "title": "(?i)licen[sc]e"}
_BLOB = "lower(coalesce(text, '') || ' ' || coalesce(source, ''))"


def _relevance(name: str) -> None:
    terms = {k: f"regexp_matches({_BLOB if k != 'title' else 'substr(text, 1, 200)'}, '{v}')" for k, v in _TERMS.items()}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = table(spark, sf, "documents")
        blob = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("source", F.lit(""))))
        columns = {k: (F.substring("text", 1, 200) if k == "title" else blob).rlike(v) for k, v in _TERMS.items()}
        return docs.filter(filters.rule(name.removeprefix("relevance_"), columns)).select("doc_id")

    run.__name__ = name
    R.add(f"SELECT doc_id FROM documents WHERE {_RULES[name].format(**terms)}")(run)


for _name in _RULES:
    _relevance(_name)

_LABELS = {"caps": "[A-Z]{4,}", "marks": "[*#$%&]{3}", "tables": r"\|", "licence": "(?i)licen[sc]ed", "digits": "[0-9]{6,}"}
_FLAGS = ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {k}" for k, p in _LABELS.items())


@R.add(f"SELECT doc_id, {_FLAGS} FROM documents")
def taxonomy_labels(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.tag(table(spark, sf, "documents"), F.coalesce("text", F.lit("")), _LABELS).select("doc_id", *_LABELS)


@R.add(f"WITH f AS (SELECT {_FLAGS} FROM documents), u AS (UNPIVOT f ON {', '.join(_LABELS)} INTO NAME label VALUE v) SELECT label, CAST(sum(CAST(v AS INT)) AS BIGINT) AS n, CAST(sum(CAST(v AS INT)) * 100 // (SELECT count(*) FROM documents) AS BIGINT) AS percent FROM u GROUP BY label")
def taxonomy_counts(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.counts(taxonomy.tag(table(spark, sf, "documents"), F.coalesce("text", F.lit("")), _LABELS), list(_LABELS))


@R.add(f"WITH f AS (SELECT doc_id, n_chars, {_FLAGS} FROM documents), u AS (UNPIVOT f ON {', '.join(_LABELS)} INTO NAME label VALUE v) SELECT label, doc_id, n_chars FROM u WHERE v QUALIFY row_number() OVER (PARTITION BY label ORDER BY n_chars DESC, doc_id) <= 7")
def taxonomy_topk(spark: SparkSession, sf: str) -> DataFrame:
    tagged = taxonomy.tag(table(spark, sf, "documents"), F.coalesce("text", F.lit("")), _LABELS)
    long = tagged.unpivot(["doc_id", "n_chars"], list(_LABELS), "label", "v").filter("v")
    return top_per_key(long, ["label"], [F.desc("n_chars"), F.col("doc_id")], 7).select("label", "doc_id", "n_chars")


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
STOP, EDGE = _LIST(mining.STOP), _LIST(mining.EDGE)


@R.add(f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(n) WHERE len(w) >= n)),
k AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS gram FROM g WHERE len(list_filter(g, lambda x: length(x) > 2 AND NOT list_contains({STOP}, x))) > 0 AND NOT regexp_matches(array_to_string(g, ''), '^[0-9]+$') AND NOT list_contains({EDGE}, g[1]) AND NOT list_contains({EDGE}, g[-1]))
SELECT gram, count(*) AS df FROM k GROUP BY gram HAVING count(*) >= 3""")
def ngram_df(spark: SparkSession, sf: str) -> DataFrame:
    return mining.document_frequency(table(spark, sf, "documents"))


@R.add()
def jargon_terms(spark: SparkSession, sf: str) -> DataFrame:
    return mining.jargon(table(spark, sf, "documents"), "market")


def _expanded_sql() -> str:
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    named = " ".join(f"WHEN contains(lower(topic), '{c}') THEN {listed(p)}" for c, p in mining.JARGON.items())
    return f"""WITH t AS ({_TOPICS}), y AS (SELECT topic, unnest(range(first, last + 1)) AS y FROM t)
SELECT DISTINCT topic, query FROM (SELECT topic, replace(replace(unnest({listed(mining.ANGLES)}), '{{topic}}', topic), '{{year}}', CAST(y AS VARCHAR)) AS query FROM y
UNION ALL SELECT topic, 'site:' || unnest({listed(mining.SITES)}) || ' ' || topic FROM t UNION ALL SELECT topic, replace(unnest(CASE {named} ELSE [] END), '{{year}}', CAST(y AS VARCHAR)) FROM y)"""


# Topics by the names of parts, some of them with a commodity, each with years of its own; words that Spark and DuckDB share.
_TOPICS = "SELECT DISTINCT concat(CASE p_partkey % 6 WHEN 0 THEN 'Copper ' WHEN 1 THEN 'crude oil and gold ' WHEN 2 THEN 'wheat ' ELSE '' END, lower(p_brand)) AS topic, CAST(2010 + p_size % 3 AS INT) AS first, CAST(2012 + p_size % 2 AS INT) AS last FROM part"


@R.add(_expanded_sql())
def expand_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of each topic of the parts, over its years."""
    topics = spark.sql(_TOPICS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return mining.expand_topics(topics).select("topic", "query").distinct()


@R.add(f"""WITH h AS (SELECT regexp_replace({HOST}, '^www\\.', '') AS domain FROM pages), c AS (SELECT domain, count(*) AS n FROM h WHERE domain <> '' GROUP BY domain ORDER BY n DESC, domain LIMIT 20)
SELECT domain, n FROM c WHERE n >= 2 AND domain NOT IN ({", ".join(f"'{s}'" for s in mining.SITES)})""")
def productive_domains(spark: SparkSession, sf: str) -> DataFrame:
    return mining.productive_domains(table(spark, sf, "pages"), least=2)


@R.add(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')) AS a FROM pages),
l AS (SELECT DISTINCT page_id, replace(replace(replace(trim(trim(regexp_extract(a, '(?is)href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)\z', 1), '"''')), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS link FROM a)
SELECT page_id, link FROM l WHERE link <> '' AND NOT starts_with(link, '#') AND NOT regexp_matches(link, '^(javascript|mailto|tel):') AND NOT regexp_matches(regexp_replace(link, '[?#].*', ''), '(?i)\.(jpg|jpeg|png|gif|svg|ico|webp|bmp|css|js|woff|woff2|ttf|eot|mp3|mp4|avi|mov|wmv|flv|zip|gz|tar|rar|7z|exe|dmg|msi)$')""")
def raw_links(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import graph

    return graph.raw_links(table(spark, sf, "pages"))


@R.add()
def links(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import graph

    return graph.resolved_links(table(spark, sf, "pages"))


QUERIES, ORACLE_SQL = R.queries, R.sql
