"""Joins of names against all pairs, and how few pairs they look at."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import names, resolve


def table(spark, xs, column):
    return spark.createDataFrame([(x,) for x in xs], f"{column} string")


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


WORDS = ["acme", "north", "oil", "gas", "drone", "shield", "a", "xy", "ltd", "group", "ünïted", "steel"]


def made(rng, n):
    out = {" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)}
    for x in list(out):
        at = rng.randrange(len(x))
        out |= {x[:at] + rng.choice("qwz") + x[at + 1 :], x[:at] + x[at + 1 :], x[at:], x + "s"}
    return sorted(out | {"", "a", "ab", "abc"})


def test_inside_equals_all_pairs(spark):
    rng = random.Random(1)
    texts, held = made(rng, 60), made(rng, 40)
    found = names.inside(table(spark, texts, "t"), "t", table(spark, held, "n"), "n")
    assert sorted((r.t, r.n) for r in found.collect()) == sorted((t, n) for t in texts for n in held if n and n in t)


def test_inside_keeps_columns_and_repeats(spark):
    texts = spark.createDataFrame([(1, "x ab y"), (2, "x ab y"), (3, None), (4, "")], "id long, t string")
    held = spark.createDataFrame([("ab", 7), ("ab", 8), ("", 9), (None, 10)], "n string, ord long")
    assert sorted((r.id, r.ord) for r in names.inside(texts, "t", held, "n").collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    assert names.inside(texts, "t", held.limit(0), "n").collect() == []


def test_a_common_prefix_is_no_key(spark):
    """20,000 names with one prefix: no piece stands for more than a few of them."""
    held = spark.range(20_000).select(F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(" Ltd")).alias("n"))
    keys = names.rarest_pieces(held, "n")
    assert keys.groupBy("piece").count().agg(F.max("count")).first()[0] <= 12 and keys.count() == 20_000


@pytest.mark.parametrize("threshold", [0.75, 0.85, 0.95])
def test_candidates_hold_every_similar_pair_once(spark, threshold):
    rng = random.Random(2)
    left, right = [x for x in made(rng, 50) if x], [x for x in made(rng, 50) if x]
    met = [(r["name"], r["found"]) for r in names.candidates(table(spark, left, "name"), table(spark, right, "found"), threshold).collect()]
    assert len(met) == len(set(met))
    want = {(a, b) for a in left for b in right if ratio(a, b) >= threshold}
    assert want <= set(met) and len(met) < {0.75: 0.25, 0.85: 0.1, 0.95: 0.03}[threshold] * len(left) * len(right)


def test_similar_names_equal_the_loop(spark):
    rng = random.Random(3)
    asked, listed = made(rng, 40), made(rng, 30)
    rng.shuffle(listed)
    right = spark.createDataFrame([(x, i) for i, x in enumerate(listed)], "found string, seq long")

    def first(a):
        near = [b for b in listed if b and ratio(a, b) >= 0.85]
        return near[0] if near else next((b for b in listed if b and b in a), None)

    found = {r["name"]: r["found"] for r in names.similar_names(table(spark, asked, "name"), right).collect()}
    assert found == {a: first(a) for a in asked if a and first(a)}
    assert found["abc"] == first("abc")


def test_one_letter_entry_inside_a_longer_name(spark):
    right = spark.createDataFrame([("z", 1), ("other", 2)], "found string, seq long")
    assert [tuple(r) for r in names.similar_names(table(spark, ["wizard works"], "name"), right).collect()] == [("wizard works", "z")]


def test_a_low_threshold_is_refused(spark):
    with pytest.raises(ValueError, match="threshold"):
        names.candidates(table(spark, ["a"], "name"), table(spark, ["a"], "found"), 0.5)


def test_names_of_one_template_meet_few_others(spark, monkeypatch):
    """Names that differ by their digits: the first similar one is right, and pairs of letters, alike in all of them, propose nothing."""
    listed = [f"supplier#{i:09d}" for i in range(0, 3000, 7)]
    right = spark.createDataFrame([(x, -i) for i, x in enumerate(listed)], "found string, seq long")
    asked = [f"zupplier#{i:09d}" for i in range(0, 3000, 50)]
    monkeypatch.setattr(names, "candidates", lambda *_: pytest.fail("all pairs"))
    found = {r["name"]: r["found"] for r in names.similar_names(table(spark, asked, "name"), right).collect()}
    assert found == {a: x for a in asked if (x := next((b for b in reversed(listed) if ratio(a, b) >= 0.85), None))}
    assert len(found) > 50


def test_pairs_by_code_are_not_moved_again(spark):
    """Repeated companies, filings and codes give each pair once, without an exchange of pairs."""
    firms = spark.createDataFrame([("a", "1000"), ("a", "1000"), ("b", "1000"), ("c", "none"), (None, "1000"), ("d", None)], "company string, ticker string")
    filings = spark.createDataFrame([(1, "1000", "z"), (1, "1000", "z"), (2, "10000", "c"), (3, "", "d"), (4, None, "c")], "filing int, sec_code string, filer_name string")
    out = resolve.by_code_or_name(firms, filings)
    want = [(c, "1000", f) for c in ("a", "b", None) for f in (1, 2)] + [("c", "none", 2), ("c", "none", 4), ("d", None, 3)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "company" in line and "filing" in line]
