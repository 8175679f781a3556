"""Links between pages and the frontier."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import urldefrag, urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.keys import bare_host, base_domain, host, url_key
from ..lineage import cut_lineage
from .select import keep_first, top_per_key

# Endings of files that are no pages.
ASSETS = r"(?i)\.(jpg|jpeg|png|gif|svg|ico|webp|bmp|css|js|woff|woff2|ttf|eot|mp3|mp4|avi|mov|wmv|flv|zip|gz|tar|rar|7z|exe|dmg|msi)$"
SCHEMES = r"^(javascript|mailto|tel):"
_HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# Parts of addresses that lead to no content.
SKIP = (
    "*/login*", "*/signin*", "*/register*", "*/account*", "*/contact*", "*/career*", "*/jobs*", "*privacy*", "*cookie*", "*/terms*", "*/legal*", "*disclaimer*", "*/search", "*/search/*", "*faq*",
    "*/video/*", "*javascript:*", "*mailto:*", "*/vacancies*", "*/applicant*", "*/talent*", "*/media-library*", "*/image-gallery*", "*/governance*", "*/leadership*", "*/secretary-general*",
    "*/our-people*", "*/committee*", "*/visit*", "*/history*", "*/awards*", "*/events*", "*/who-we-are*", "*/organization-chart*",
)


def hrefs(html: Column) -> Column:
    """Targets of anchors as they are written, in any quotes and either case, character references decoded, each once."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda g: F.regexp_extract_all(html, F.lit(_HREF), g))
    joined = F.transform(F.arrays_zip(raw[0].alias("a"), raw[1].alias("b"), raw[2].alias("c")), lambda x: F.trim(F.concat(x["a"], x["b"], x["c"])))
    plain = F.transform(joined, lambda x: F.replace(F.replace(F.replace(x, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.filter(plain, lambda x: (x != "") & ~x.startswith("#") & ~x.rlike(SCHEMES)))


def raw_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): targets of anchors as they are written, without assets and pseudo-schemes."""
    return pages.select("page_id", F.explode(hrefs(F.col("html"))).alias("link")).filter(~F.regexp_replace("link", r"[?#].*", "").rlike(ASSETS))


def is_skipped(url: Column, globs: tuple[str, ...] = SKIP) -> Column:
    """Whether an address matches any glob, in lower case; a glob with stars at its ends alone is a search for what it holds."""
    inner = [g[1:-1] for g in globs if re.fullmatch(r"\*[^*]+\*", g)]
    forms = ["^" + re.escape(g).replace(r"\*", ".*") + "$" for g in globs if not re.fullmatch(r"\*[^*]+\*", g)]

    def found(low: Column) -> Column:
        out = reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in inner], F.lit(False))
        return out | low.rlike("(?s)" + "|".join(forms)) if forms else out

    # Bound once: a filter would make the address anew for each glob.
    return F.coalesce(F.exists(F.array(F.lower(url)), found), F.lit(False))


def is_pdf(url: Column, content_type: Column) -> Column:
    path = F.lower(F.regexp_replace(url, r"[?#].*", ""))
    return path.endswith(".pdf") | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def same_host(url: Column, seed: Column) -> Column:
    """Exact host, without port and www."""
    plain = lambda u: F.regexp_replace(bare_host(u), r":\d+$", "")
    return plain(url) == plain(seed)


@F.pandas_udf(StringType())
def _resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str, x: str) -> str | None:
        try:
            out = urldefrag(urljoin(b, x.strip()))[0]
            return out if urlsplit(out).scheme in ("http", "https") else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)])


def resolved_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): absolute http(s) targets, each once for a page."""
    found = pages.select("page_id", "url", F.explode(hrefs(F.col("html"))).alias("link"))
    found = found.select("page_id", "url", _resolve("url", "link").alias("target")).filter(F.col("target").isNotNull())
    return found.filter(~F.regexp_replace("target", r"\?.*", "").rlike(ASSETS)).distinct()


def internal_links(pages: DataFrame) -> DataFrame:
    """(page_id, target): links within the host, scheme, host and path alone, one slash off the end."""
    inside = resolved_links(pages).filter(same_host(F.col("target"), F.col("url")))
    path = F.regexp_replace(F.regexp_replace("target", r"[?#].*", ""), "/$", "")
    return inside.select("page_id", path.alias("target")).filter(~is_skipped(F.col("target"))).distinct()


def frontier(links: DataFrame, seen: DataFrame, excluded: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(target, host): links of the same base domain, not excluded, not seen, to hosts below ``most`` pages (``counts``: host, n).

    The cap is a crawl's own: what a host may still get, in order of address.
    """
    rows = same_domain(links).select("target", host(F.col("target")).alias("host")).distinct()
    rows = rows.join(excluded, rows["host"] == excluded["domain"], "left_anti").join(excluded, base_domain(rows["host"]) == excluded["domain"], "left_anti")
    rows = rows.join(seen.select(url_key(F.col("url")).alias("k")).distinct(), url_key(F.col("target")) == F.col("k"), "left_anti")
    left = rows.join(counts, "host", "left").withColumn("room", most - F.coalesce("n", F.lit(0)))
    at = F.row_number().over(W.partitionBy("host").orderBy("target"))
    return left.withColumn("at", at).filter("at <= room").select("target", "host")


def best_first(urls: DataFrame, words: tuple[str, ...], optimal: int = 1) -> DataFrame:
    """``urls`` (url, days) with score: 0.8 for the share of key words in the address, 0.3 for a depth near ``optimal``, 0.15 for freshness."""
    low = F.lower("url")
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0)) / F.lit(len(words))
    depth = F.size(F.array_remove(F.split(F.regexp_replace(F.regexp_replace("url", r"[?#].*", ""), r"^[a-z]+://[^/]*", ""), "/"), ""))
    return urls.withColumn("score", F.round(0.8 * hits + 0.3 / (1 + F.abs(depth - optimal)) + 0.15 / (1 + F.coalesce("days", F.lit(365))), 9))


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """``pages`` (url) with allowed, by the robots.txt of their host (``rules``: host, robots); hosts without one, or with one that cannot be read, allow all."""

    @F.pandas_udf(BooleanType())
    def check(url: pd.Series, robots: pd.Series) -> pd.Series:
        parsers: dict = {}
        out = []
        for u, text in zip(url, robots, strict=True):
            if not text:
                out.append(True)
                continue
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            out.append(parsers[text].can_fetch(agent, u))
        return pd.Series(out)

    return pages.withColumn("_h", host(F.col("url"))).join(rules.select(F.col("host").alias("_h"), "robots"), "_h", "left").withColumn("allowed", check("url", "robots")).drop("_h", "robots")


def same_domain(links: DataFrame) -> DataFrame:
    return links.filter(base_domain(bare_host(F.col("url"))) == base_domain(bare_host(F.col("target"))))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, depth, seed): breadth-first from ``seeds`` (node, seed) over ``edges`` (src, dst).

    Each round joins the frontier with the edges and drops what was seen; ``most`` caps the
    nodes queued in one round, where a crawl limit is wanted.
    """
    frontier = seen = cut_lineage(keep_first(seeds.select("node", "seed"), ["node"], [F.col("seed")]).withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node"), "seed")
        step = keep_first(step, ["node"], [F.col("seed")]).join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        if most is not None:
            step = top_per_key(step, ["depth"], [F.col("node")], most)
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def page_key(url: str) -> F.Column:
    return url_key(F.col(url))
