"""Benchmark decontamination.  DataFrame operations only.

Benchmark items become normalised word n-grams ("windows").  Documents are split into
words once and each word is hashed once; a position is a candidate if the hash of the
first words of a window starting there is in a set that every task holds.  Only
candidates become rows: their full n-gram is looked up in the table of windows, so hits
are exact.  The set and the table are broadcast while they are below ``SET_BOUND``
windows; beyond that every position becomes a row and Spark joins them as it does any
two tables.

Nulls and edge cases: a null or wordless text has no words and no hits; null or wordless
items have no windows; an item shorter than the window is one window; equal rows each
appear with the same result; a null doc_id is kept; extra columns of either table are
ignored.  With an empty benchmark nothing is hit; empty documents give empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, row_key, split_words, table

#: What separates words after lower-casing: every ASCII character but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words whose joint hash admits a position.
LEAD = 3
#: Windows up to which the set of leads is a literal of the plan and the table is broadcast (some 10 MB).
SET_BOUND = 50_000


def normalised(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, length, items): each distinct window once, with the ids of all items that hold it, as strings."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normalised(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    words = words.filter(n > 0).withColumn("length", F.least(n, F.lit(window))).withColumn("at", F.explode(starts))
    words = words.withColumn("slice", F.expr("slice(w, at, length)"))
    hashed = F.transform(F.slice("slice", 1, LEAD), lambda x: F.xxhash64(x))
    words = words.select("item_id", "length", F.array_join("slice", " ").alias("gram"), _lead(hashed).alias("lead"))
    return words.groupBy("gram", "length", "lead").agg(F.collect_set("item_id").alias("items"))


def _lead(hashed: Column) -> Column:
    """The joint hash of the first word hashes of a window, LEAD of them or all."""
    one = [F.try_element_at(hashed, F.lit(k + 1)) for k in range(LEAD)]
    out = F.xxhash64(*one)
    for k in range(LEAD - 1, 0, -1):
        out = F.when(F.size(hashed) == k, F.xxhash64(*one[:k])).otherwise(out)
    return out


def _candidates(length: int, members: list[int] | None) -> Column:
    """Positions (from 0) in ``w`` at which a window of ``length`` words may start, given the leads of such windows."""
    starts = f"CASE WHEN size(w) >= {length} THEN sequence(0, size(w) - {length}) ELSE CAST(array() AS array<int>) END"
    if members is not None:
        lead = ", ".join(f"h[at + {j}]" for j in range(min(length, LEAD)))
        # Literals: with more than ten of them Spark evaluates IN as a hash set, which travels with the plan.
        starts = f"filter({starts}, at -> xxhash64({lead}) IN ({', '.join(map(str, members))}))"
    return F.expr(f"transform({starts}, at -> named_struct('at', at, 'length', {length}))")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, the columns of ``carry``, n_words, hits (array of (at, length), word positions from 0), n_hit, items."""
    windows = benchmark_windows(benchmark, window).persist()
    by_length = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(by_length.values()) <= SET_BOUND
    leads: dict[int, list[int]] = {}
    if small:
        for r in windows.select(F.least("length", F.lit(LEAD)).alias("k"), "lead").distinct().collect():
            leads.setdefault(r["k"], []).append(r["lead"])
    keep = [c for c in carry if c != "doc_id"]
    words = docs.select("doc_id", *keep, row_key(F.col("doc_id"), F.col("text")).alias("row_key"), normalised(F.col("text")).alias("w"))
    words = words.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("w")
    found = F.array().cast("array<struct<at:int,length:int>>")
    for length in sorted(by_length):
        found = F.concat(found, _candidates(length, leads[min(length, LEAD)] if small else None))
    rows = words.select("doc_id", *keep, "row_key", n.alias("n_words"), "w", F.posexplode_outer(found).alias("nth", "c"))
    gram = F.expr("array_join(slice(w, c.at + 1, c.length), ' ')")
    rows = rows.select("doc_id", *keep, "row_key", "n_words", F.coalesce("nth", F.lit(0)).alias("nth"), "c", gram.alias("gram"))
    table_ = F.broadcast(windows) if small else windows
    met = rows.alias("r").join(table_.alias("b"), F.expr("r.gram = b.gram and r.c.length = b.length"), "left")
    firsts = [F.first(c).alias(c) for c in keep]
    hits = met.groupBy("doc_id", "row_key", "n_words").agg(
        F.collect_set(F.when(F.col("b.gram").isNotNull(), F.col("r.c"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("b.items"))).alias("items"),
        F.count_if(F.col("nth") == 0).alias("rows"),
        *firsts,
    )
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(a: Column, x: Column) -> Column:
        end = x["at"] + x["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["at"]))).alias("n"))

    hits = hits.withColumn("hits", F.array_sort("hits")).withColumn("n_hit", F.aggregate("hits", nothing, cover, lambda a: a["n"]))
    return hits.withColumn("copy", F.explode(F.expr("sequence(1L, rows)"))).select("doc_id", *keep, "row_key", "n_words", "hits", "n_hit", F.array_sort("items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which any window occurs; all columns stay."""
    bad = find_contamination(docs, benchmark, window).filter(F.col("n_hit") > 0).select("row_key").distinct()
    return docs.withColumn("_row_key", row_key(F.col("doc_id"), F.col("text"))).join(bad, F.col("_row_key") == bad["row_key"], "left_anti").drop("_row_key")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       coalesce(it.items_sha256, sha256('')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
