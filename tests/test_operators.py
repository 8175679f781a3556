"""Operators outside the llm subpackage, on small fixtures."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docmill.functions import entities, keys, text
from docmill.operators import dedup, filters, graph, mining, select
from docmill.plans import corpus
from docmill.streaming import incremental, throttle


def values(df, column):
    return [r[column] for r in df.collect()]


def test_url_keys(spark):
    df = spark.createDataFrame([("https://example.com/page#section",), ("https://EXAMPLE.com/Page",), ("https://example.com/page/",)], "url string")
    assert set(values(df.select(keys.url_key(F.col("url")).alias("k")), "k")) == {"https://example.com/page"}
    assert values(spark.createDataFrame([("a.b.reuters.com",)], "h string").select(keys.base_domain(F.col("h")).alias("d")), "d") == ["reuters.com"]


def test_content_dedup_sees_2000_characters_and_keeps_blanks(spark):
    rows = [(1, "X" * 2000 + "A"), (2, "X" * 2000 + "B"), (3, ""), (4, None), (5, "y")]
    assert sorted(values(dedup.content_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")) == [1, 3, 4, 5]


def test_clean(spark):
    raw = "Real line of text.\nAll rights reserved 2020 Corp\nhttps://example.com/x\nSubscribe to our newsletter now\n\n\n\nAn oﬃce   line."
    out = values(spark.createDataFrame([(raw,), (None,)], "t string").select(text.clean(F.col("t")).alias("c")), "c")
    assert out == ["Real line of text.\n\nAn office line.", ""]


def test_lenient_dates(spark):
    rows = [("2024-06-15T14:30:00",), ("2024-06-15",), ("2024-07",), ("2025",), ("not-a-date",), (None,), ("2023-12-31",)]
    df = spark.createDataFrame(rows, "d string").select(filters.date_outcome(F.col("d"), "2024-06-01", None).alias("o"))
    assert values(df, "o") == ["inside"] * 4 + ["unparseable"] * 2 + ["outside"]


def test_chunks_join_to_the_text(spark):
    rng = random.Random(3)
    texts = ["", "short", "".join(rng.choice(["word ", ". ", "\n\n", "x" * 50]) for _ in range(900)), "z" * 12000]
    for t, parts in zip(texts, values(spark.createDataFrame([(t,) for t in texts], "t string").select(text.chunk_text(F.col("t")).alias("c")), "c"), strict=True):
        assert "".join(parts) == t and all(len(p) <= 5000 for p in parts)


def test_greedy_equals_the_loop(spark):
    rng = random.Random(5)
    for n in (1, 6, 12):
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3}
        kept = []
        for v in range(n):
            if not any((u, v) in edges for u in kept):
                kept.append(v)
        ids = spark.range(n).withColumnRenamed("id", "doc_id")
        found = dedup.greedy_keep(ids, spark.createDataFrame(list(edges), "a long, b long"))
        assert sorted(values(found.filter("kept"), "doc_id")) == kept


def test_similar_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (4, " ".join(reversed(words))), (5, "  "), (6, None)]
    found = {(r.a, r.b) for r in dedup.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 2), (1, 3)}


def test_names(spark):
    df = spark.createDataFrame([("Droneshield LLC",), ("DroneShield Ltd.",), ("DRONESHIELD, Inc.",), ("Droneshield Corp. Ltd.",), (None,)], "n string")
    assert values(df.select(entities.normal_assignee(F.col("n")).alias("x")), "x") == ["droneshield"] * 4 + [""]
    pairs = spark.createDataFrame([("BP plc", "BP P.L.C."), ("BP plc", "Some ETF"), ("Rio Tinto Group", "Rio Tinto Limited"), ("", "x")], "a string, b string")
    assert values(pairs.select(entities.name_guard(F.col("a"), F.col("b")).alias("x")), "x") == [True, False, True, False]


def test_links_and_search(spark):
    page = '<a href="/page2">x</a><a href="#">y</a><a href="javascript:1">z</a><a href="mailto:a@b">m</a><a href="/image.jpg">i</a><a href="https://other.org/a#f">o</a>'
    found = graph.resolved_links(spark.createDataFrame([(1, "https://example.com/dir/", page)], "page_id long, url string, html string"))
    assert set(values(found, "target")) == {"https://example.com/page2", "https://other.org/a"}
    assert values(graph.same_domain(found), "target") == ["https://example.com/page2"]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 0)], "node long, seed long")
    assert {r.node: r.depth for r in graph.bfs(edges, seeds, 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_queries_and_years(spark):
    q = values(mining.expand_queries(spark, "gold price", 2023, 2024), "query")
    assert len(q) == len(set(q)) == 22 + 21 + 10
    assert mining.sampled_years(2000, 2025, 5)[0] == 2000 and mining.sampled_years(2000, 2025, 5)[-1] == 2025 and len(mining.sampled_years(2000, 2025, 5)) == 5


def test_throttle(spark):
    log = [("a", 1, 429, None), ("a", 2, 429, 15.0), ("b", 1, 403, None), ("c", 1, 500, None), ("d", 1, 429, None), ("d", 2, 200, None)]
    found = {r.domain: r.delay for r in throttle.fold_delays(spark.createDataFrame(log, "domain string, seq long, status int, retry_after double")).collect()}
    assert found == {"a": 15.0, "b": 1.5, "c": 1.25, "d": 1.0}


def test_selection(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 1, "c"), (None, 1, "d")], "k string, o int, v string")
    assert set(values(select.keep_first(df, ["k"], [F.col("o")]), "v")) == {"a", "c", "d"}
    assert {r.k: r.v for r in select.distinct_in_order(df, "k", "v", "o").collect()}["k"] == "a; b"


def test_incremental_ingest_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, rows in enumerate(([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        incremental.ingest(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(values(spark.read.parquet(str(tmp_path / "out")), "doc_id")) == [1, 2, 5]


def test_texts_without_partners_are_told_by_a_part_of_their_shingles(spark):
    """Pairs at and around the threshold, of texts from 1 to some 200 shingles, as by brute force; texts that share little are not taken further."""
    rng, rows = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(3 + i * 3)]
        rows.append(words)
        cut = rng.randrange(1, 3 + i * 3 // 5)
        rows += [words[cut:], words[: len(words) - cut // 3] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]]
    alone = [[f"y{rng.randrange(10**6)}" for _ in range(80)] + ["one", "tail", "of", "all", "these", "texts"] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows + alone) if w]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(frozenset(tuple(w[j : j + 3]) for j in range(max(len(w) - 2, 1))), i)
    one = list(sets.items())
    for threshold in (0.5, 0.85, 0.9):
        real = {(min(i, j), max(i, j)) for x, (s, i) in enumerate(one) for r, j in one[:x] if len(s & r) >= threshold * len(s | r)}
        assert len(real) > 20
        assert {(r.a, r.b) for r in dedup.similar_pairs(df, threshold).filter("jaccard < 1").collect()} == real
    shingles = F.array_sort(text.shingle_hashes(F.col("text"), 3))
    named = df.select(F.col("doc_id").alias("id"), shingles.alias("s")).withColumn("n", F.size("s")).withColumn("h", F.md5(F.col("s").cast("string")))
    named = named.withColumn("p", F.transform(F.slice("s", F.lit(1), dedup._part(F.col("n"), 0.85)), lambda x: F.hash(x)))
    left = set(values(dedup._with_partners(named, 0.85), "id"))
    assert {i for pair in {(min(i, j), max(i, j)) for x, (s, i) in enumerate(one) for r, j in one[:x] if len(s & r) >= 0.85 * len(s | r)} for i in pair} <= left
    assert not [i for i, t in rows if t.startswith("y") and i in left]


def test_near_copies_of_one_text_move_once_for_each_block(spark):
    """Pairs of near copies as by brute force; what is shuffled does not grow with their square."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]

    def copies(n):
        rows = []
        for i in range(n):
            w = list(words)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        return rows

    def moved(rows):
        driver = spark.sparkContext._jsc.sc().statusStore().executorSummary
        df = spark.createDataFrame(rows, "doc_id long, text string")
        before = driver("driver").totalShuffleWrite()
        found = dedup.similar_pairs(df).groupBy().agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return found, driver("driver").totalShuffleWrite() - before

    sizes = []
    for n in (150, 600):
        rows = copies(n)
        sets = [frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) for w in (t.split() for _, t in rows)]
        assert len(set(sets)) == n
        real = [(a, b) for b in range(n) for a in range(b) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
        found, size = moved(rows)
        assert tuple(found) == (len(real), sum(a for a, _ in real), sum(b for _, b in real)) and len(real) > n * n / 4
        sizes.append(size)
    assert sizes[1] < 4.5 * sizes[0]


def test_filter_of_ids_loses_none(spark):
    rows, ids = spark.range(-3000, 3000), spark.range(-3000, 3000, 7)
    found = set(values(dedup._likely(rows, ids), "id"))
    assert set(range(-3000, 3000, 7)) <= found and len(found) < 1000


def test_greedy_near_drops_the_copies_of_near_copies(spark):
    """Copies of near copies, and chains: equal to the sequential loop over the sets."""
    rng = random.Random(8)
    bases = [[f"b{k}w{i}" for i in range(80)] for k in range(3)]
    lists = [bases[0], [*bases[0][:-1], "other"], [*bases[0][:-1], "other"]]
    for _ in range(40):
        w = list(rng.choice([*bases, *lists]))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(3)}"
        lists.append(w)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in lists]
    kept: list[int] = []
    for v, s in enumerate(sets):
        if not any(len(s & sets[u]) >= 0.85 * len(s | sets[u]) for u in kept):
            kept.append(v)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)], "doc_id long, text string")
    found = dedup.greedy_near(df)
    assert found.count() == len(lists) and sorted(values(found.filter("kept"), "doc_id")) == kept
    assert 2 not in kept
    old = dedup.greedy_keep(df.select("doc_id"), dedup.similar_pairs(df).filter("a < 3 AND b < 3"))
    assert 2 in values(old.filter("kept"), "doc_id")  # why links to copies alone are no conflicts


def test_two_keys_equal_the_loop(spark):
    """Only kept rows register their keys, as in the reference."""
    rng = random.Random(9)
    rows = [(1, "x", None), (2, "x", "B"), (3, None, "B"), (4, "", "B")]
    rows += [(i, rng.choice([None, "", *"abcdefgh"]), rng.choice([None, "", *"pqrstuvw"])) for i in range(5, 60)]
    seen: tuple[set, set] = (set(), set())
    kept = []
    for i, *keys in rows:
        if not any(k and k in s for k, s in zip(keys, seen, strict=True)):
            kept.append(i)
            for k, s in zip(keys, seen, strict=True):
                s.add(k)
    found = dedup.greedy_by_keys(spark.createDataFrame(rows, "doc_id long, doi string, title string"), [F.col("doi"), F.col("title")], "doc_id")
    assert found.count() == len(rows) and sorted(values(found.filter("kept"), "doc_id")) == kept and 3 in kept and 4 not in kept


def test_jargon_terms_equal_brute_force_from_three_texts_on(spark, tmp_path):
    """The registered query: terms of 3 to 19 texts take part, stop and edge words do not."""
    texts = ["the copper cathode premium of the market"] * 4 + ["LME warehouse stocks, the copper cathode"] * 3 + ["rare term pair"] * 2 + ["12345 67890 and the said year"] * 5
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stop, count = mining.STOP | {"market"}, Counter()
    for t in texts:
        w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        runs = {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        count.update(g for g in runs if any(len(x) > 2 and x not in stop for x in g) and not "".join(g).isdigit() and g[0] not in mining.EDGE and g[-1] not in mining.EDGE)
    grams = {" ".join(g): len(g) * 10 + math.log(n) for g, n in count.items() if n >= 3 and len(" ".join(g)) >= 4}
    expected: list[str] = []
    for g in sorted(grams, key=lambda g: (-grams[g], g)):
        if not any(g in s for s in expected):
            expected.append(g)
    found = {r["rank"]: r.term for r in corpus.jargon_terms(spark, str(tmp_path)).collect()}
    assert [found[i] for i in sorted(found)] == expected[:20] and "copper cathode premium" in expected and "rare term pair" not in expected


def test_words_of_grams_are_judged_once(spark):
    """Without lists all runs count but numbers and short words; no run is split again to be judged."""
    docs = spark.createDataFrame([(1, "The oil 12 34 of it"), (2, "oil 12 a a")], "doc_id int, text string")
    found = mining.document_frequency(docs, stop=(), edge=(), least=1)
    assert {r.gram: r.df for r in found.collect()} == {"the": 1, "oil": 2, "the oil": 1, "oil 12": 2, "the oil 12": 1, "oil 12 34": 1, "oil 12 a": 1}
    plan = mining.document_frequency(docs, least=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_contains" not in plan
