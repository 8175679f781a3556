"""Walks over landed pages: sitemap trees to seed lists, and a best-first crawl with a budget."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.keys import bare_host
from ..lineage import cut_lineage, drop_checkpoint
from .graph import is_skipped
from .select import keep_first

# Parts of paths that lead to no content, and places where a site's map may lie.
SKIPPED_PARTS = (
    "/career", "/jobs", "/vacancies", "/applicant", "/talent", "/login", "/signin", "/register", "/account", "/cookie", "/privacy", "/terms", "/legal", "/disclaimer", "/search", "/faq",
    "/media-library", "/image-gallery", "/video/",
)
USUAL_PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/")
# Words of addresses that promise content.
SIGNALS = (
    "earnings", "revenue", "quarterly", "annual", "report", "results", "financial", "sec", "filings", "filing", "news", "press", "article", "release",
    "commodity", "crude", "lng", "refinery", "terminal", "shipping", "grain", "crop", "copper", "nickel", "aluminium", "iron ore", "lithium", "cobalt",
    "production", "reserves", "throughput", "sustainability", "supply chain", "logistics", "market outlook", "trading",
)

#: Adds body to the rows of a table with url, as far as there is a file.
Reader = Callable[[DataFrame], DataFrame]


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


@F.pandas_udf(ArrayType(StringType()))
def locations(xml: pd.Series) -> pd.Series:
    """The locations of a sitemap or sitemap index in the namespace of its root; none where it is no XML."""

    def of(text: str | None) -> list[str]:
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return []
        space = re.match(r"\{.*\}", root.tag)
        return [x.text.strip() for x in root.iter(f"{space.group() if space else ''}loc") if x.text]

    return xml.map(of)


def _reader(landed: DataFrame | Reader) -> Reader:
    return landed if callable(landed) else lambda asked: asked.join(landed.select("url", "body"), "url")


def sitemap_roots(domains: DataFrame, landed: DataFrame | Reader) -> DataFrame:
    """(domain, url, at): the sitemaps that a domain's robots.txt lists, in order; without any, the first usual place that holds one."""
    read, homes = _reader(landed), domains.select("domain").distinct()
    robots = read(homes.withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/robots.txt"))))
    lines = robots.select("domain", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("at", "line"))
    listed = cut_lineage(lines.select("domain", F.regexp_extract("line", r"^(?i)\s*sitemap:\s*(.*?)\s*$", 1).alias("url"), "at").filter("url <> ''"))
    places = F.posexplode(F.array(*[F.lit(p) for p in USUAL_PLACES])).alias("at", "place")
    tried = homes.join(listed.select("domain"), "domain", "left_anti").select("domain", places).withColumn("url", F.concat(F.lit("https://"), "domain", "place"))
    head = F.lower(F.substring("body", 1, 500))
    maps = read(tried).filter(head.contains("<urlset") | head.contains("<sitemapindex"))
    return listed.unionByName(keep_first(maps.select("domain", "url", "at"), ["domain"], [F.col("at")]))


def sitemap_seeds(domains: DataFrame, landed: DataFrame | Reader, depth: int = 2, children: int = 20, most: int = 2000, skipped: tuple[str, ...] = SKIPPED_PARTS) -> DataFrame:
    """(domain, url, n): seed addresses of each domain in order, from landed files (url, body; one row per url).

    Sitemaps are read as one would depth first: an index leads to its first ``children``
    sitemaps, ``depth`` levels below a root, and a sitemap is read where it is met first.
    Addresses with a skipped part go, the first ``most`` of a domain stay, repeated ones
    included; a domain left without any has its homepage.  A file that is missing or no XML
    holds nothing.

    Each level is one join with the landed files, and no file is parsed that the walk does not
    reach; ``landed`` may also be a function that adds body to the rows of a table with url,
    where files are costly to make.  A place in the tree is the list of positions that lead
    there, so depth-first order is the order of these lists.
    """
    read, homes = _reader(landed), domains.select("domain").distinct()
    index = F.coalesce(F.lower(F.substring("body", 1, 500)).contains("<sitemapindex"), F.lit(False))
    level = cut_lineage(sitemap_roots(homes, read).select("domain", F.trim("url").alias("url"), F.array("at").alias("place")))
    tree = level
    for _ in range(depth):
        indexes = read(level.select("url").distinct()).filter(index).select("url", F.slice(locations("body"), 1, children).alias("kids"))
        kids = level.join(indexes, "url").select("domain", F.posexplode("kids").alias("at", "kid"), "place")
        level = cut_lineage(kids.select("domain", F.col("kid").alias("url"), F.concat("place", F.array("at")).alias("place")))
        tree = tree.unionByName(level)
    tree = cut_lineage(tree)
    visited = _first_visits(tree)

    def counts(loc: Column) -> Column:
        path = F.lower(url_path(loc))
        return (loc != "") & ~F.coalesce(F.greatest(*[F.contains(path, F.lit(p)) for p in skipped], F.lit(False)), F.lit(False))

    # Of one file no more than ``most`` can stay.
    leaves = read(visited).filter(~index & F.col("body").isNotNull())
    kept = leaves.select("domain", "place", F.slice(F.filter(locations("body"), counts), 1, most).alias("locs"))
    plain = kept.select("domain", "place", F.posexplode("locs").alias("at", "loc"))
    order = W.partitionBy("domain").orderBy("place", "at")
    first = cut_lineage(plain.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("domain", F.col("loc").alias("url"), "n"))
    bare = homes.join(first.select("domain"), "domain", "left_anti")
    return first.unionByName(bare.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.lit(1).alias("n")))


def _first_visits(tree: DataFrame) -> DataFrame:
    """The places that a depth-first reading visits: of each address the first place whose parent place is visited itself.

    Starts from first places of all and takes away those below an unvisited place, until
    nothing changes: a round settles at least the next place in order, and one is enough
    where no sitemap is met twice.
    """
    above = F.slice("place", F.lit(1), F.size("place") - 1)
    there, before = tree, -1
    while True:
        first = cut_lineage(there.groupBy("domain", "url").agg(F.min("place").alias("place")))
        parents = first.select("domain", F.col("place").alias("_above"))
        there = cut_lineage(tree.filter(F.size("place") == 1).unionByName(tree.filter(F.size("place") > 1).withColumn("_above", above).join(parents, ["domain", "_above"], "left_semi").select(*tree.columns)))
        now = there.agg(F.sum(F.xxhash64("domain", "place").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return first
        before = now


def url_score(url: Column, year: int, words: tuple[str, ...] = SIGNALS, optimal: int = 1) -> Column:
    """0.8 for the share of signal words in an address, 0.3 for a path depth near ``optimal``, 0.15 for a year in it near ``year`` (half without one)."""
    held = lambda low: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    hits = F.element_at(F.transform(F.array(F.lower(url)), held), 1) / F.lit(len(words))
    depth = F.size(F.array_remove(F.split(url_path(url), "/"), ""))
    stated = F.regexp_extract(url_path(url), r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1)
    fresh = F.when(stated == "", F.lit(0.5)).otherwise(1 / (1 + F.abs(F.lit(year) - F.nullif(stated, F.lit("")).cast("int"))))
    return F.round(0.8 * hits + 0.3 / (1 + F.abs(depth - optimal)) + 0.15 * fresh, 9)


def best_first_crawl(
    links: DataFrame, seeds: DataFrame, score: Callable[[Column], Column], pages: int = 50, depth: int = 2, at_once: int = 10,
    globs: tuple[str, ...] | None = None, scoped: bool = True,
) -> DataFrame:
    """(seed, query, url, depth, score, nth): the pages that a best-first crawl from each seed visits, numbered in order of visit.

    ``links`` is (url, target, at), at being the place of a link on its page; ``seeds`` is
    (seed, query).  As with a heap: a round pops the ``at_once`` best addresses of the
    frontier, highest score first, equal ones in order of arrival (links of equal place in order of address), as far as the budget of
    ``pages`` goes; their links arrive in order of the visits and of their places, unless an
    address is skipped, on another host than the seed, deeper than ``depth`` or was seen.
    Every page carries its seed's query.

    All seeds walk at once.  As the order of addresses never changes, a seed can pop no more than
    the best of what its budget has left: only those stay in its frontier, and of a page's links
    on a host only the best ``pages`` are kept.  An address that left the frontier may come
    again, later and so no better than before.  A round is one join with the pages that were
    popped and one exchange by seed, whose rows the budget bounds.
    """
    plain = lambda u: F.regexp_replace(bare_host(F.col(u)), r":\d+$", "") if scoped else F.lit("")
    skipped = is_skipped(F.col("target"), globs) if globs is not None else is_skipped(F.col("target"))
    given = links.select("url", "target", "at").filter(F.col("url").isNotNull() & F.col("target").isNotNull())
    # Each address is looked at once, however many links lead there.
    targets = given.select("target").distinct().filter(~skipped).select("target", plain("target").alias("host"), score(F.col("target")).alias("score"))
    fit = given.repartition("target").groupBy("target", "url").agg(F.min("at").cast("long").alias("at")).join(targets, "target")
    place = F.row_number().over(W.partitionBy("url", "host").orderBy(F.desc("score"), "at", "target"))
    fit = fit.withColumn("place", place).filter(F.col("place") <= pages)
    fit = cut_lineage(fit.groupBy("url", "host").agg(F.collect_list(F.struct("target", "score", "at")).alias("out")))

    start = keep_first(seeds.filter(F.col("seed").isNotNull()).select("seed", "query"), ["seed"], [F.col("query")])
    # nth: of a visited address its number; place, done, waiting: of an open one its rank, and how many its seed has visited and not.
    first = start.select("seed", "query", F.col("seed").alias("url"), F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("came"), F.lit(None).cast("int").alias("nth"))
    state = cut_lineage(first.select("*", F.lit(1).alias("place"), F.lit(0).alias("done"), F.lit(1).cast("long").alias("waiting")).filter(F.lit(pages) > 0))
    while True:
        popped = F.col("nth").isNull() & (F.col("place") <= at_once)
        if state.filter(popped).isEmpty():
            break
        known = state.withColumn("nth", F.when(popped, F.col("done") + F.col("place")).otherwise(F.col("nth")))
        more = (F.col("depth") < depth) & (F.col("done") + F.least(F.lit(at_once), F.col("waiting")) < pages)
        now = state.filter(popped & more).select("seed", "query", "url", "depth", (F.col("done") + F.col("place")).cast("long").alias("from"), plain("seed").alias("host"))
        met = now.join(fit, ["url", "host"]).select("seed", "query", (F.col("depth") + 1).alias("depth"), "from", F.explode("out").alias("x"))
        met = met.select("seed", "query", F.col("x.target").alias("url"), "depth", F.col("x.score").alias("score"), (F.col("from") * (1 << 32) + F.col("x.at")).alias("came"), F.lit(None).cast("int").alias("nth"), F.struct(F.lit(1).alias("kind"), F.col("from").alias("nth"), F.col("x.at").alias("at")).alias("order"))
        old = known.select("seed", "query", "url", "depth", "score", "came", "nth", F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("at")).alias("order"))
        every = old.unionByName(met).repartition("seed")
        row = F.min_by(F.struct("query", "depth", "score", "came", "nth"), "order").alias("r")
        every = every.groupBy("seed", "url").agg(row).select("seed", "r.query", "url", "r.depth", "r.score", "r.came", "r.nth")
        own = W.partitionBy("seed")
        every = every.withColumn("done", F.coalesce(F.max("nth").over(own), F.lit(0))).withColumn("open", F.col("nth").isNull())
        every = every.withColumn("place", F.row_number().over(W.partitionBy("seed", "open").orderBy(F.desc("score"), "came", "url")))
        every = every.filter(~F.col("open") | (F.col("place") <= pages - F.col("done")))
        before, state = state, cut_lineage(every.withColumn("waiting", F.sum(F.col("open").cast("long")).over(own)).drop("open"))
        drop_checkpoint(before)
    drop_checkpoint(fit)
    return state.filter(F.col("nth").isNotNull()).select("seed", "query", "url", "depth", "score", "nth")
