"""Joins of names with names: one lies in the other, or the two are nearly the same.

Neither compares all pairs.  Containment meets on the rarest piece of the shorter name, so a
prefix or legal form that all names share is nobody's key.  Similarity meets on pairs of
letters, rarest first, as far as the threshold says that similar names must share one.
"""

from __future__ import annotations

import difflib
import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

#: Lengths of the pieces that names are found by: of each name the longest that fits.
PIECES = (1, 2, 4, 8, 16)


def _pieces(text: Column, length: Column | int) -> Column:
    """Distinct hashes of the pieces of a text; none if it is shorter."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.xxhash64(F.substring(text, i, F.lit(length) if isinstance(length, int) else length)))
    return F.when(F.length(text) >= length, F.array_distinct(cut)).otherwise(F.array().cast("array<long>"))


def rarest_pieces(names: DataFrame, name: str) -> DataFrame:
    """(name, piece, length), one row per distinct name that is not empty: of its pieces, the one in the fewest names.  Equal counts go by hash."""
    fits = F.lit(PIECES[0])
    for n in PIECES[1:]:
        fits = F.when(F.length(name) >= n, n).otherwise(fits)
    one = names.select(name).filter(F.length(name) > 0).distinct().withColumn("length", fits)
    each = one.select(name, "length", F.explode(_pieces(F.col(name), F.col("length"))).alias("piece"))
    counts = each.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    return each.join(counts, "piece").groupBy(name).agg(F.min_by(F.struct("piece", "length"), F.struct("df", "piece")).alias("k")).select(name, "k.piece", "k.length")


def inside(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """``texts`` joined with the ``names`` that lie in them; empty and null names lie in none.

    Each distinct name has one key, the hash of its rarest piece, so a pair is met once;
    distinct texts are cut into pieces of the lengths that occur.
    """
    keys = rarest_pieces(names, name)
    lengths = [r["length"] for r in keys.select("length").distinct().collect()]  # at most len(PIECES)
    if not lengths:
        return texts.crossJoin(names).limit(0)
    every = F.flatten(F.array(*[_pieces(F.col(text), n) for n in sorted(lengths)]))
    cut = texts.select(text).filter(F.length(text) > 0).distinct().select(text, F.explode(every).alias("piece"))
    found = cut.join(keys.select(name, "piece"), "piece").filter(F.contains(text, name)).select(text, name)
    return texts.join(found, text).join(names, name)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of characters in matching blocks, as difflib has it; 0 if one is missing."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def least_shared(total: Column | float, threshold: float):
    """Pairs of letters that two names of ``total`` letters together must share at this similarity.

    At least t/2 of all letters match, in blocks that (1 - t) of all letters, unmatched, can
    part; a block of k letters holds k - 1 pairs.
    """
    return total * (1.5 * threshold - 1) - 1


def _tokens(name: Column) -> Column:
    """The pairs of letters of a name, each with how often it came before: a multiset as a set."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2)))

    def numbered(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(p, F.lit(1), i), lambda y: y == x))))

    return F.element_at(F.transform(F.array(pairs), numbered), 1)


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(name, found) of all pairs that may be similar, each once, of two tables of distinct names (name), (found).

    Pairs of letters are ordered by how many names of ``right`` hold them, rarest first.  A
    name's prefix is so long that two similar names share a pair of letters in their
    prefixes; a pair is taken where the first of these meets, if lengths, what can still
    follow, and the exact count of shared pairs allow it.
    """
    if threshold <= 0.7:
        raise ValueError("the bound on shared pairs of letters needs a threshold above 0.7")
    shortest, longest = threshold / (2 - threshold), (2 - threshold) / threshold
    long_l, long_r = left.filter(F.length("name") > 1), right.filter(F.length("found") > 1)
    held = long_r.select("found", F.explode(_tokens(F.col("found"))).alias("t"))
    df = held.groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def ranked(rows: DataFrame, name: str, how: str) -> DataFrame:
        parts = rows.select(name, F.length(name).alias("n"), F.explode(_tokens(F.col(name))).alias("t")).join(df, "t", how)
        one = parts.groupBy(name, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("k"))
        least = F.ceil(least_shared(F.col("n") * (1 + shortest), threshold) - 1e-9)
        prefix = F.slice("k", F.lit(1), F.greatest(F.lit(1), F.least(F.size("k"), (F.size("k") - least + 1).cast("int"))))
        return one.select(name, "n", F.transform("k", lambda x: x["t"]).alias("all"), prefix.alias("p"))

    a = ranked(long_l, "name", "left")
    b = ranked(long_r, "found", "inner")
    a = a.select("name", F.col("n").alias("na"), F.col("all").alias("ta"), F.col("p").alias("pa"), F.posexplode("p").alias("ia", "x"))
    b = b.select("found", F.col("n").alias("nb"), F.col("all").alias("tb"), F.col("p").alias("pb"), F.posexplode("p").alias("ib", "x"))
    total = F.col("na") + F.col("nb")
    need = F.ceil(least_shared(total, threshold) - 1e-9)
    fits = (F.col("nb") >= F.col("na") * shortest - 1e-9) & (F.col("nb") <= F.col("na") * longest + 1e-9)
    fits &= need > 0
    follows = F.least(F.size("ta") - F.col("ia"), F.size("tb") - F.col("ib")) >= need
    first = F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("x")  # in the order of the first, so by rank
    enough = F.size(F.array_intersect("ta", "tb")) >= need
    met = a.join(b, "x").filter(fits & follows).filter(first & enough).select("name", "found")
    # Pairs so short that they may share no pair of letters share a letter at least.
    few = F.col("short") * (1 + shortest) * (1.5 * threshold - 1) <= 1
    letters = lambda rows, name: rows.select(name, F.length(name).alias("short")).filter(few).select(name, F.explode(F.array_distinct(F.split(name, ""))).alias("x"))
    total, fits = F.length("name") + F.length("found"), F.length("found").between(F.length("name") * shortest - 1e-9, F.length("name") * longest + 1e-9)
    brief = letters(left, "name").join(letters(right, "found"), "x").filter(fits & (least_shared(total, threshold) <= 1e-9)).select("name", "found").distinct()
    return met.unionByName(brief)


#: Pairs of lengths whose names have no more cut forms than this meet on them, others on pairs of letters.
FORMS = 400
#: Longer names are not cut.
LONGEST = 200


def losses(left: list[int], right: list[int], threshold: float) -> dict[tuple[int, int], tuple[int, int] | None]:
    """For lengths of two names that may be similar, how many letters each may lose; None where that makes too many forms."""
    out = {}
    for n in left:
        for m in right:
            match = math.ceil(threshold * (n + m) / 2 - 1e-9)
            if match <= min(n, m):
                few = max(n, m) <= LONGEST and max(math.comb(n, match), math.comb(m, match)) <= FORMS
                out[n, m] = (n - match, m - match) if few else None
    return out


def cut_forms(lost: dict[tuple[int, int], tuple[int, int]], side: int):
    """Hashes of a name without as many letters as it may lose, for each pair of lengths that it is of."""
    own: dict[int, list[tuple[str, int]]] = {}
    for pair, k in lost.items():
        own.setdefault(pair[side], []).append((f"{pair[0]},{pair[1]},", k[side]))

    @F.pandas_udf(ArrayType(LongType()))
    def run(names: pd.Series) -> pd.Series:
        def of(name: str) -> list[int]:
            wanted, forms, out = own.get(len(name), []), {name}, []
            for k in range(1 + max((k for _, k in wanted), default=-1)):
                if k:
                    forms = {x[:i] + x[i + 1 :] for x in forms for i in range(len(x))}
                for tag in (tag for tag, n in wanted if n == k):
                    out += [int.from_bytes(hashlib.blake2b((tag + x).encode(), digest_size=8).digest(), "little", signed=True) for x in forms]
            return out

        return names.map(of)

    return run


def first_similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(name, found): for each name (name) the first of ``right`` (found, seq; distinct names) by seq that is similar enough.

    Matching blocks are letters in the same order, so similar names are equal once each has
    lost as many letters as their lengths allow; names of a list that differ by a digit or two
    meet on few of these forms, where the pairs of letters are the same in all of them.  Longer
    names meet on pairs of letters.  The candidates of a name are looked at in order of seq, as
    far as the first similar one.
    """
    if threshold <= 0.7:
        raise ValueError("the bound on shared pairs of letters needs a threshold above 0.7")
    sizes = lambda rows, c: [r["n"] for r in rows.select(F.least(F.length(c), F.lit(LONGEST + 1)).alias("n")).distinct().collect()]
    every = losses(sizes(left, "name"), sizes(right, "found"), threshold)
    cheap = {pair: k for pair, k in every.items() if k is not None}
    a = left.select("name", F.explode(cut_forms(cheap, 0)("name")).alias("x"))
    b = right.select("found", "seq", F.explode(cut_forms(cheap, 1)("found")).alias("x"))
    met = a.join(b, "x").select("name", "found", "seq")
    if others := [pair for pair, k in every.items() if k is None]:
        long_l = left.filter(F.least(F.length("name"), F.lit(LONGEST + 1)).isin(*{n for n, _ in others}))
        long_r = right.filter(F.least(F.length("found"), F.lit(LONGEST + 1)).isin(*{n for _, n in others}))
        met = met.unionByName(candidates(long_l.select("name"), long_r.select("found"), threshold).join(long_r, "found").select("name", "found", "seq"))
    ordered = met.repartition("name").sortWithinPartitions("name", "seq")

    def firsts(parts):
        name, done, seen = None, False, None
        for part in parts:
            out = []
            for n, f in zip(part["name"], part["found"], strict=True):
                if n != name:
                    name, done, seen = n, False, None
                if not done and f != seen:
                    seen = f
                    if difflib.SequenceMatcher(None, n, f).ratio() >= threshold:
                        done = True
                        out.append((n, f))
            yield pd.DataFrame(out, columns=["name", "found"])

    return ordered.select("name", "found").mapInPandas(firsts, "name string, found string")


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(name, found): for each name of ``left`` the first of ``right`` (found, seq) that is similar enough, else the first that lies in it.

    Names with neither are not returned; empty and null names have neither.
    """
    asked = left.select("name").filter(F.length("name") > 0).distinct()
    firsts = right.filter(F.length("found") > 0).groupBy("found").agg(F.min("seq").alias("seq"))
    near = first_similar(asked, firsts, threshold).withColumn("rank", F.lit(0))
    within = inside(asked, "name", firsts.select("found"), "found").select("name", "found").withColumn("rank", F.lit(1))
    both = near.unionByName(within).join(firsts, "found")
    return both.groupBy("name").agg(F.min_by("found", F.struct("rank", "seq")).alias("found"))

