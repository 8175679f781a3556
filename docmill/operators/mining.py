"""Query expansion and mining of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import search_name
from ..functions.keys import bare_host
from .select import keep_first

# Angles, sites and commodity patterns of the expansion.
ANGLES = (
    "{topic} {year}", "{topic} review {year}", "{topic} survey {year}", "{topic} analysis {year}", "{topic} research {year}", "{topic} applications {year}",
    "{topic} tutorial {year}", "{topic} benchmark {year}", "{topic} trends {year}", "{topic} market {year}", "{topic} forecast {year}",
)
SITES = (
    "pubs.usgs.gov", "worldbank.org", "imf.org", "reuters.com", "ft.com", "bloomberg.com", "mining.com", "kitco.com", "fastmarkets.com", "statista.com", "tradingeconomics.com",
    "investing.com", "spglobal.com", "iea.org", "arxiv.org", "paperswithcode.com", "distill.pub", "towardsdatascience.com", "neptune.ai", "huggingface.co", "mckinsey.com",
)
JARGON = {
    "copper": (
        "copper cathode price LME {year}", "copper mining output Chile Peru {year}", "copper demand china {year}", "LME copper {year}", "COMEX copper futures {year}",
        "copper concentrate TC RC {year}", "copper warehouse stocks LME {year}", "refined copper consumption {year}", "copper scrap recycling {year}", "copper deficit surplus {year}",
    ),
    "oil": ("crude oil WTI Brent price {year}", "OPEC oil production {year}", "oil demand IEA {year}", "oil inventory stocks {year}", "oil refinery capacity {year}"),
    "gold": ("gold price LBMA {year}", "gold ETF holdings {year}", "gold mining production {year}", "gold central bank reserves {year}", "COMEX gold futures {year}"),
    "wheat": ("wheat futures CBOT {year}", "wheat production USDA {year}", "wheat export import {year}", "wheat stocks to use ratio {year}"),
    "natural gas": ("natural gas Henry Hub price {year}", "LNG demand supply {year}", "natural gas storage {year}", "TTF natural gas Europe {year}"),
}
# Words that make no term.
STOP = frozenset(
    "the a an and or but in on at to for of is it by as with from that this was were be been are have has had do does did will would shall should can could may might must "
    "not no nor so if then than also more most very much its their our your his her he she we they them us me my all any each both few many some such only just about after "
    "before between through during above below up down out off over under again further once here there when where why how what which who whom whose new said year years one "
    "two three four five six seven eight nine ten first last per cent percent total well even still however according report data based including figure table page source www "
    "http https com org net pdf html million billion trillion".split()
) | frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec 2000 2001 2002 2003 2004 2005 2006 2007 2008 "
    "2009 2010 2011 2012 2013 2014 2015 2016 2017 2018 2019 2020 2021 2022 2023 2024 2025 2026".split()
)
EDGE = frozenset("the a an of in on at to for by as is it and or s".split())


def document_frequency(docs: DataFrame, stop=STOP, edge=EDGE, least: int = 3, longest: int = 3) -> DataFrame:
    """(gram, df): runs of up to ``longest`` words and the number of texts that hold them.

    A gram needs a word of three or more letters that is no stop word, must not be all
    digits, and must not begin or end with an edge word.
    """
    words = docs.select("doc_id", F.array_remove(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), "").alias("w"))
    # Words are judged once each, and only runs that count are built.
    of = lambda test: F.transform("w", lambda x: F.coalesce(test(x), F.lit(False)))
    strong = of(lambda x: (F.length(x) > 2) & ~x.isin(*stop) if stop else F.length(x) > 2)
    marked = words.select("doc_id", "w", strong.alias("strong"), of(lambda x: x.rlike("^[0-9]+$")).alias("digits"), of(lambda x: x.isin(*edge) if edge else F.lit(False)).alias("edges"))
    # As strings: distinct elements of an array of strings are hashed, those of nested arrays compared in pairs.
    grams = marked.select(F.explode(F.array_distinct(F.concat(*[_runs(n) for n in range(1, longest + 1)]))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)


def _runs(n: int) -> F.Column:
    """The runs of ``n`` words that count, from the marks of the words."""
    every = lambda mark, sign: f" {sign} ".join(f"{mark}[i + {k}]" for k in range(n))
    good = f"({every('strong', 'OR')}) AND NOT ({every('digits', 'AND')}) AND NOT edges[i] AND NOT edges[i + {n - 1}]"
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return F.expr(f"CASE WHEN size(w) >= {n} THEN transform(filter(sequence(0, size(w) - {n}), i -> {good}), i -> {joined}) ELSE CAST(array() AS array<string>) END")


def jargon(docs: DataFrame, topic: str, most: int = 20, least: int = 3, pool: int = 2000) -> DataFrame:
    """(rank, term): the best terms by 10 per word plus log frequency, none part of a better one.

    Spark ranks; the greedy pass reads the ranking from the top on the driver, ``pool`` rows
    at a time, until it has ``most`` terms, so it sees as many rows as it needs and the
    driver holds no more than one pool.
    """
    found = document_frequency(docs, stop=STOP | set(topic.lower().split()), least=least).filter(F.length("gram") >= 4)
    ranked = found.select("gram", (F.size(F.split("gram", " ")) * 10 + F.log("df")).alias("score")).persist()
    chosen: list[str] = []
    last = None
    while len(chosen) < most:
        rest = ranked if last is None else ranked.filter((F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (F.col("gram") > last["gram"])))
        rows = rest.orderBy(F.desc("score"), "gram").limit(pool).collect()
        for row in rows:
            if len(chosen) < most and not any(row["gram"] in s for s in chosen):
                chosen.append(row["gram"])
        if len(rows) < pool:
            break
        last = rows[-1]
    ranked.unpersist()
    return docs.sparkSession.createDataFrame([(i + 1, g) for i, g in enumerate(chosen)], "rank int, term string")


def expand_jargon(terms: DataFrame, topic: str, years: list[int], existing: DataFrame) -> DataFrame:
    """(query): each term (rank, term) with each year, the topic before terms that do not hold it, without ``existing`` (query)."""
    spark = terms.sparkSession
    each = terms.join(F.broadcast(spark.createDataFrame([(y,) for y in years], "year int")))
    query = F.trim(F.concat(F.when(F.col("term").contains(topic.lower()), "").otherwise(f"{topic} "), "term", F.lit(" "), F.col("year").cast("string")))
    out = keep_first(each.select("rank", "year", query.alias("query")), ["query"], [F.col("rank"), F.col("year")])
    return out.join(existing.select("query"), "query", "left_anti").select("query")


# Patterns of queries on a company.
BY_TICKER = ("{0} supply chain", "{0} suppliers", "{0} customers", "{0} 10-K")
BY_NAME = ("{0} supply chain", "{0} suppliers", "{0} customers revenue", "{0} annual report")


def company_queries(companies: DataFrame) -> DataFrame:
    """(company, ticker, query): four by ticker, where there is one, and four by the short name."""
    fill = lambda patterns, c: [F.replace(F.lit(p), F.lit("{0}"), c) for p in patterns]
    ticker = F.coalesce("ticker", F.lit(""))
    every = F.concat(F.when(ticker != "", F.array(*fill(BY_TICKER, ticker))).otherwise(F.array().cast("array<string>")), F.array(*fill(BY_NAME, search_name(F.col("company")))))
    return companies.select("company", ticker.alias("ticker"), F.explode(every).alias("query"))


def pairs_of_terms(methods: DataFrame, markets: tuple[str, ...]) -> DataFrame:
    """(query): every method (method) with every market of a short list, each once."""
    named = methods.select("method").filter(F.coalesce(F.col("method"), F.lit("")) != "").distinct()
    return named.select(F.explode(F.transform(F.array(*[F.lit(m) for m in markets]), lambda m: F.concat("method", F.lit(" "), m))).alias("query")).distinct()


def expand_topics(topics: DataFrame) -> DataFrame:
    """(topic, seq, query) from (topic, first, last): angles by year, sites, and the patterns of the first commodity in the topic; each query of a topic once, in order."""
    years = F.sequence("first", "last")
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])

    def by_year(patterns: Column, at: int) -> Column:
        filled = lambda p, y: F.trim(F.replace(F.replace(p, F.lit("{topic}"), F.col("topic")), F.lit("{year}"), y.cast("string")))
        return F.flatten(F.transform(years, lambda y: F.transform(patterns, lambda p, i: F.struct((F.lit(at) + y * 1000 + i).cast("long").alias("seq"), filled(p, y).alias("query")))))

    named = F.array().cast("array<string>")
    for commodity, patterns in reversed(JARGON.items()):
        named = F.when(F.contains(F.lower("topic"), F.lit(commodity)), literal(patterns)).otherwise(named)
    sites = F.transform(literal(SITES), lambda s, i: F.struct((F.lit(10_000_000) + i).cast("long").alias("seq"), F.trim(F.concat(F.lit("site:"), s, F.lit(" "), F.col("topic"))).alias("query")))
    every = F.concat(by_year(literal(ANGLES), 0), sites, by_year(named, 20_000_000))
    out = topics.filter("topic IS NOT NULL AND first <= last").select("topic", F.explode(every).alias("x")).select("topic", "x.*").filter("query <> ''")
    return keep_first(out, ["topic", "query"], [F.col("seq")])


def expand_queries(spark: SparkSession, topic: str, first: int, last: int) -> DataFrame:
    """(seq, query) of one topic."""
    return expand_topics(spark.createDataFrame([(topic, first, last)], "topic string, first int, last int")).select("seq", "query")


def sampled_years(first: int, last: int, most: int) -> list[int]:
    """At most ``most`` years, evenly spaced, with the first and the last."""
    years = list(range(first, last + 1))
    if len(years) <= most:
        return years
    if most <= 1:
        return years[:most]
    out = years[:: max(1, len(years) // most)][:most]
    return [years[0], *out[1:-1], years[-1]]


def years_between(first: Column, last: Column, most: int) -> Column:
    """The same as an array of each row's own years; null bounds give null."""
    n = last - first + 1
    spaced = F.slice(F.sequence(first, last, F.greatest(F.lit(1), F.floor(n / most)).cast("int")), 1, most)
    several = F.concat(F.array(first), F.slice(spaced, 2, max(0, most - 2)), F.array(last)) if most > 1 else F.slice(F.array(first), 1, most)
    return F.when(n <= most, F.sequence(first, last)).when(n > most, several)


def productive_domains(pages: DataFrame, least: int, most: int = 20, known: tuple[str, ...] = SITES) -> DataFrame:
    """The ``most`` commonest domains first, then those with ``least`` pages that are not known."""
    d = bare_host(F.col("url")).alias("domain")
    top = pages.select(d).filter("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(most)
    return top.filter((F.col("n") >= least) & ~F.col("domain").isin(*known))
