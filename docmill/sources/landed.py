"""Landed answers of search interfaces: pages by offset, and works with their abstracts as inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.select import keep_first

HITS = "hits struct<hits:array<struct<_id:string,_source:map<string,string>>>>"
WORKS = (
    "results array<struct<id:string,title:string,publication_year:int,publication_date:string,doi:string,cited_by_count:bigint,abstract_inverted_index:map<string,array<int>>,"
    "authorships:array<struct<author:struct<display_name:string>>>,concepts:array<struct<display_name:string>>,"
    "primary_location:struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>,best_oa_location:struct<pdf_url:string>>>"
)


def _read_pages(pages: DataFrame, key: str, size: int) -> DataFrame:
    """Pages (key, start, body) with their hits, which number they have, and whether reading page after page comes to them."""
    first = keep_first(pages.select(key, "start", "body"), [key, "start"], [F.col("body")])
    parsed = first.select(key, "start", F.from_json("body", HITS)["hits"]["hits"].alias("h"))
    order = W.partitionBy(key).orderBy("start")
    numbered = parsed.withColumn("_gap", F.col("start") != (F.row_number().over(order) - 1) * size)
    ends = F.coalesce(F.size("h") < size, F.lit(True)) | F.col("_gap")
    return numbered.withColumn("_before", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("read", (F.col("_before") == 0) & ~F.col("_gap"))


def offset_hits(pages: DataFrame, key: str, size: int, most: int | None = None) -> DataFrame:
    """(key, n, id, source) of landed search pages (key, start, body), as if they had been asked for one after the other.

    Reading stops after a page with fewer than ``size`` hits, before a page that is missing or
    can't be read, and at ``most`` hits.  A page that landed twice counts once.
    """
    read = _read_pages(pages, key, size).filter("read")
    hits = read.select(key, "start", F.posexplode("h").alias("at", "x"))
    out = hits.select(key, (F.col("start") + F.col("at")).cast("long").alias("n"), F.coalesce("x._id", F.lit("")).alias("id"), F.col("x._source").alias("source"))
    return out if most is None else out.filter(F.col("n") < most)


def page_gaps(pages: DataFrame, key: str, size: int) -> DataFrame:
    """(key, next): where the landed pages of a key break off after a full page, the place to ask for next; complete ones are not returned."""
    read = _read_pages(pages, key, size).filter("read")
    last = read.groupBy(key).agg(F.max_by(F.struct("start", F.coalesce(F.size("h"), F.lit(-1)).alias("n")), "start").alias("l"))
    none = pages.select(key).distinct().join(last.select(key), key, "left_anti").select(key, F.lit(0).cast("long").alias("next"))
    return last.filter((F.col("l.n") >= size) | (F.col("l.n") < 0)).select(key, F.when(F.col("l.n") < 0, F.col("l.start")).otherwise(F.col("l.start") + size).cast("long").alias("next")).unionByName(none)


def abstract_of(index: Column) -> Column:
    """The text of an inverted index, word to places: words by place, the last of the index where two claim one; empty without an index."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda at: F.struct(at.alias("at"), i.alias("i"), e["key"].alias("word")))))

    def told(p: Column) -> Column:
        last = F.filter(p, lambda x, i: ~x["at"].eqNullSafe(F.get(p, i + 1)["at"]))
        return F.array_join(F.transform(last, lambda x: x["word"]), " ")

    return F.coalesce(F.element_at(F.transform(F.array(F.array_sort(places)), told), 1), F.lit(""))


def works(pages: DataFrame, order: str, body: str = "body") -> DataFrame:
    """Papers of landed answers: one row per id, the first by ``order`` and place, with empty strings for what is not known."""
    each = pages.select(F.col(order).alias("_o"), F.posexplode(F.from_json(F.col(body), WORKS)["results"]).alias("_at", "w"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    w = F.col("w")
    rows = each.select(
        "_o", "_at", F.regexp_extract(text(w["id"]), r"([^/]*)\z", 1).alias("openalex_id"), text(w["title"]).alias("title"),
        F.coalesce(F.array_join(F.transform(w["authorships"], lambda a: text(a["author"]["display_name"])), ", "), F.lit("")).alias("authors"), text(w["publication_year"]).alias("year"), text(w["publication_date"]).alias("date"),
        abstract_of(w["abstract_inverted_index"]).alias("abstract"), text(w["primary_location"]["source"]["display_name"]).alias("venue"), F.lit("openalex").alias("source"),
        F.replace(text(w["doi"]), F.lit("https://doi.org/")).alias("doi"), F.coalesce(w["cited_by_count"], F.lit(0)).alias("citations"),
        F.coalesce(F.array_join(F.transform(F.slice(w["concepts"], 1, 5), lambda c: F.coalesce(c["display_name"], F.lit(""))), ", "), F.lit("")).alias("categories"),
        first(w["best_oa_location"]["pdf_url"], w["primary_location"]["pdf_url"]).alias("pdf_url"), first(w["primary_location"]["landing_page_url"], w["id"]).alias("link"), F.lit("").alias("arxiv_id"),
    )
    return keep_first(rows.filter("openalex_id <> ''"), ["openalex_id"], [F.col("_o"), F.col("_at")]).drop("_o", "_at")
