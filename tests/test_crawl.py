"""Sitemap trees and the best-first crawl against the plain loops; names, keys and dates that went wrong before."""

import heapq
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docmill.functions import contracts, dates, patents
from docmill.lineage import cut_lineage
from docmill.operators import crawl, mining, reshape, select
from docmill.sinks import files as sinks
from docmill.sources import files as sources


def urlset(locs, kind="urlset", inner="url", space=' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'):
    return f"<{kind}{space}>" + "".join(f"<{inner}><loc> {x} </loc></{inner}>" for x in locs) + f"</{kind}>"


def index_of(locs, **other):
    return urlset(locs, "sitemapindex", "sitemap", **other)


def depth_first(domain, landed, children=20, most=2000):
    """One file after the other."""
    base, found, visited = f"https://{domain}", [], set()
    locs = lambda x: [y.strip() for y in re.findall(r"<loc>([^<]*)</loc>", x)] if re.search(r"</\w+>\s*$", x) else []
    robots = landed.get(f"{base}/robots.txt")
    roots = [x for line in (robots or "").splitlines() if line.strip().lower().startswith("sitemap:") and (x := line.strip().split(":", 1)[1].strip())]
    if not roots:
        roots = [u for p in crawl.USUAL_PLACES if "<urlset" in (t := (landed.get(u := base + p) or "")[:500].lower()) or "<sitemapindex" in t][:1]

    def read(url, depth):
        if url in visited or depth > 2:
            return
        visited.add(url)
        body = landed.get(url)
        if not body:
            return
        if "<sitemapindex" in body[:500].lower():
            for kid in locs(body)[:children]:
                read(kid, depth + 1)
        else:
            found.extend(locs(body))

    for root in roots:
        read(root, 0)
    kept = [u for u in found if not any(p in re.sub(r"^https?://[^/]*", "", u.split("?")[0]).lower() for p in crawl.SKIPPED_PARTS)][:most]
    return kept or [f"{base}/"]


def made_sites(seed):
    rng, landed, domains = random.Random(seed), {}, [f"s{i}.example" for i in range(7)]
    for d in domains[:6]:
        maps = [f"https://{d}/m{i}.xml" for i in range(8)]
        page = lambda: f"https://{d}/{rng.choice(['a', 'b', 'Login', 'news', 'faq?x'])}/{rng.randrange(30)}"  # noqa: B023, E731
        for m in maps:
            landed[m] = index_of(rng.choices(maps, k=rng.randint(1, 6))) if rng.random() < 0.55 else urlset([page() for _ in range(rng.randint(0, 6))])
        if rng.random() < 0.3:
            landed[rng.choice(maps)] += "<broken"
        if rng.random() < 0.6:
            landed[f"https://{d}/robots.txt"] = "User-agent: *\nSITEMAP: " + "\nsitemap:".join(rng.sample(maps, 3)) + " \nSitemap:\n"
        else:
            landed[f"https://{d}{rng.choice(crawl.USUAL_PLACES)}"] = index_of(maps[:3])
    landed["https://s6.example/sitemap.xml"] = "<html>none</html>"
    return domains, landed


@pytest.mark.parametrize("seed", [1, 2])
def test_sitemap_seeds_equal_the_recursion(spark, seed):
    """Sitemaps that are met twice, at other depths, in circles, broken or missing; caps that bind."""
    domains, landed = made_sites(seed)
    found = crawl.sitemap_seeds(spark.createDataFrame([(d,) for d in domains], "domain string"), spark.createDataFrame(list(landed.items()), "url string, body string"), children=4, most=9)
    got = {d: [] for d in domains}
    for r in sorted(found.collect(), key=lambda r: r.n):
        got[r.domain].append(r.url)
    assert got == {d: depth_first(d, landed, 4, 9) for d in domains}


def test_locations_follow_the_namespace_of_the_root(spark):
    rows = [(urlset(["a"]),), (urlset(["b"], space=""),), ("<urlset>",), (None,), ("",), ('<urlset xmlns="x" xmlns:i="y"><url><loc>c</loc><i:loc>d</i:loc></url></urlset>',)]
    found = spark.createDataFrame(rows, "x string").select(crawl.locations("x").alias("l")).collect()
    assert [r.l for r in found] == [["a"], ["b"], [], [], [], ["c"]]


def heap_loop(links, seed, score, pages, depth, at_once, skipped):
    """A heap per seed: highest score first, then the order of arrival."""
    host = lambda u: re.sub(r"^www\.", "", u.split("/")[2].lower().split(":")[0])
    heap, seen, out, came = [(0.0, 0, seed, 0)], {seed}, [], 0
    while heap and len(out) < pages:
        batch = [heapq.heappop(heap) for _ in range(min(at_once, pages - len(out), len(heap)))]
        out += [(u, d) for _, _, u, d in batch]
        for _, _, u, d in batch:
            for v in links.get(u, ()):
                if d < depth and v not in seen and not skipped(v) and host(v) == host(seed):
                    seen.add(v)
                    came += 1
                    heapq.heappush(heap, (-score[v], came, v, d + 1))
    return out


@pytest.mark.parametrize("at_once", [1, 4])
def test_best_first_equals_the_heap(spark, at_once):
    rng = random.Random(4)
    urls = [f"https://{rng.choice(['a.example', 'WWW.a.example:443', 'b.example'])}/{rng.choice(['', 'news/', 'annual-report/2024/', 'login/', 'x/y/z/'])}{i}" for i in range(60)]
    links = {u: rng.sample(urls, rng.randint(0, 9)) for u in urls}
    rows = spark.createDataFrame([(u, v, i) for u, vs in links.items() for i, v in enumerate(vs)] + [(urls[0], urls[1], 99)], "url string, target string, at int")
    seeds = spark.createDataFrame([(u, f"q{i}") for i, u in enumerate(urls[:5])] + [(urls[0], "q9")], "seed string, query string")
    score = {r.u: r.s for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", crawl.url_score(F.col("u"), 2025).alias("s")).collect()}
    found = crawl.best_first_crawl(rows, seeds, lambda u: crawl.url_score(u, 2025), pages=9, depth=2, at_once=at_once).collect()
    for i, seed in enumerate(urls[:5]):
        mine = sorted((r for r in found if r.seed == seed), key=lambda r: r.nth)
        assert [(r.url, r.depth) for r in mine] == heap_loop(links, seed, score, 9, 2, at_once, lambda u: "/login" in u)
        assert [r.nth for r in mine] == list(range(1, len(mine) + 1)) and {r.query for r in mine} == {f"q{i}"}


def test_scores_follow_words_depth_and_year(spark):
    rows = [("https://a.example/annual-report",), ("https://a.example/x",), ("https://a.example/x/y/z",), ("https://a.example/2025",), ("https://a.example/2015",), ("https://a.example/12025",)]
    s = [r.s for r in spark.createDataFrame(rows, "u string").select(crawl.url_score(F.col("u"), 2025).alias("s")).collect()]
    assert s[0] > s[1] > s[2] and s[3] > s[1] > s[4] and s[5] == s[1]


def test_spread_numbers_of_a_hot_key(spark):
    """A key of most rows lies in several partitions."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), (F.col("id") * 7919 % 3001).alias("o")).withColumn("k", F.when(F.col("o") % 97 > 0, F.col("k")))
    got = select.spread_numbers(df.repartition(5), [F.col("k")], [F.col("o")]).collect()
    want, seen = [], Counter()
    for k, o in sorted(((r.k, r.o) for r in df.collect()), key=lambda x: (x[0] or "", x[1])):
        seen[k] += 1
        want.append((k, o, seen[k]))
    assert sorted(((r.k, r.o, r["rank"]) for r in got), key=str) == sorted(want, key=str)


def test_a_thousand_records_have_as_many_names(spark):
    df = spark.range(1001).select("id", F.lit("Crude Oil").alias("t"))
    names = [r.file for r in sinks.record_names(df, F.col("t"), "id").orderBy("id").collect()]
    assert len(set(names)) == 1001 and names[0] == "crude_oil_001.md" and names[999:] == ["crude_oil_1000.md", "crude_oil_1001.md"]


def test_citekeys_are_unique_however_many(spark):
    rows = [(i, "Ann Bell", 2020, "Oil") for i in range(60)] + [(100, "Ann Bell", 2020, "oilc"), (101, "", None, None), (102, None, 1999, "!")]
    df = spark.createDataFrame(rows, "id int, a string, y int, t string")
    keys = {r.id: r.citekey for r in sinks.citekeys(df, F.col("a"), "y", F.col("t"), "id").collect()}
    assert len(set(keys.values())) == len(rows)
    assert (keys[0], keys[1], keys[2], keys[24]) == ("bell2020oil", "bell2020oilb", "bell2020oild", "bell2020oilz")
    assert (keys[25], keys[51], keys[100], keys[101], keys[102]) == ("bell2020oil-a", "bell2020oil-aa", "bell2020oilc", "anonndx", "anon1999x")


def test_a_bibliography_entry(spark):
    one = spark.range(1).select(sinks.bibtex(F.lit("k"), F.lit("A B, C. D.,"), F.lit("T {x} &amp; y"), F.lit(2024), F.lit(""), F.lit(None), F.lit("2401.1"), F.lit("https://x"))).first()[0]
    assert one == "@misc{k,\n  author    = {A B and C. D.},\n  title     = {T x and y},\n  year      = {2024},\n  eprint    = {2401.1},\n  archivePrefix = {arXiv},\n  url       = {https://x}\n}"


@pytest.mark.parametrize(("group", "kind"), [("FX", "financials"), ("credit", "financials"), ("Bonds", "financials"), ("freight", "energy"), ("electricity", "energy"), ("Wood", "")])
def test_classes_of_groups(spark, group, kind):
    assert spark.range(1).select(contracts.class_of_group(F.lit(group))).first()[0] == kind


def test_formats_without_text(spark):
    bucket = lambda f: spark.range(1).select(reshape.source_bucket(F.lit(f), F.lit("free"), F.lit("imagery"))).first()[0]
    assert [bucket(f) for f in ("KML", "shapefile", "zarr", "GRIB2")] == ["skip_binary", "deep", "deep", "skip_binary"]


def test_patent_numbers_of_any_country(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(patents.numbers_in(F.lit("US9275645B2 US20150302858A1 IN20001A EP3012345 XUS12345B"))) == ["US9275645B2", "US20150302858A1", "IN20001A"]
    json = '{"results":{"cluster":[{"result":[{"id":"patent/USD0123456S1/en"},{"id":"patent/EP3012345/en"},{"id":"x/patent/US1A"}]}]}}'
    assert one(sources.cluster_ids(F.lit(json))) == ["USD0123456S1", "EP3012345"]


def test_month_first_where_the_day_is_none(spark):
    one = lambda t: str(spark.range(1).select(dates.date_in_text(F.lit(t))).first()[0])
    assert [one(t) for t in ("on 15/06/2025", "on 12/31/2024", "on 05/06/2024", "on 31/31/2024")] == ["2025-06-15", "2024-12-31", "2024-06-05", "None"]


def test_one_sampled_year():
    assert mining.sampled_years(2000, 2025, 1) == [2000] and mining.sampled_years(2000, 2025, 5)[-1] == 2025


def test_a_frontier_holds_no_more_than_the_budget(spark, monkeypatch):
    """A page with more links than a crawl can visit: what no budget reaches is not carried along."""
    sizes = []

    def cut(df):
        out = cut_lineage(df)
        if "seed" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(crawl, "cut_lineage", cut)
    urls = [f"https://a.example/{'news/' if i % 3 == 0 else ''}{i}" for i in range(200)]
    rows = spark.createDataFrame([(urls[0], v, i) for i, v in enumerate(urls)] + [(urls[9], v, i) for i, v in enumerate(urls[::-1])], "url string, target string, at int")
    found = crawl.best_first_crawl(rows, spark.createDataFrame([(urls[0], "q")], "seed string, query string"), lambda u: crawl.url_score(u, 2025), pages=7, at_once=3).collect()
    score = {r.u: r.s for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", crawl.url_score(F.col("u"), 2025).alias("s")).collect()}
    assert [(r.url, r.depth) for r in sorted(found, key=lambda r: r.nth)] == heap_loop({urls[0]: urls, urls[9]: urls[::-1]}, urls[0], score, 7, 2, 3, lambda u: False)
    assert sizes and max(sizes) <= 7


def test_sitemaps_that_no_walk_reaches_are_not_read(spark):
    """Files may come from a function: it is asked for those that the walk meets, and for nothing else."""
    domains, landed = made_sites(1)
    files, asked = spark.createDataFrame(list(landed.items()), "url string, body string"), set()

    def read(rows):
        asked.update(r.url for r in rows.select("url").collect())
        return rows.join(files, "url")

    found = crawl.sitemap_seeds(spark.createDataFrame([(d,) for d in domains], "domain string"), read, children=1, most=9).collect()
    got = {d: [r.url for r in sorted((r for r in found if r.domain == d), key=lambda r: r.n)] for d in domains}
    assert got == {d: depth_first(d, landed, 1, 9) for d in domains}
    assert set(landed) - asked
