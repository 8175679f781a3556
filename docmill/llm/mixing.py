"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame operations only.

Each source gets a target number of words.  A document's expected number of copies is
target / source size; its whole part is taken as it is, and the fractional parts of a
source are rounded dependently: two documents exchange expected *words* (copy probability
times size) until the probability of one is 0 or 1, so the expected words of a source stay
exactly what they were.  Leaves of a few hundred documents do this in one pass each and
hand on one unresolved document; further levels pair those, until one per source is left,
which goes to the nearer of 0 and 1.  The words taken of a source are then off its target
by at most half of one document, however large the source is, and at most ``SETTLE``
documents of the source get a copy more or less to make up for that.

Nulls and edge cases: a null text has no words; a null source is a source of its own and
comes last; documents of no words take none; rows that agree in id, source and size are
one unit whose copies are dealt out to its rows as evenly as whole numbers allow.  Other
columns are ignored, whatever their names.  Empty input gives empty output.  All choices
hash ids and ``seed``, so reruns agree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, shared_checkpoint, split_words, table

#: A probability this near to 0 or 1 counts as that.
NEAR = 1e-9
#: Units that one leaf or inner node of the reduction tree takes, on average.
FAN = 256
#: Copies of each row of the source table, one per salt, so that a large source is joined by many tasks.
SALTS = 32
#: Rounds that settle what the last roundings miss, and words of a miss that are let be.
SETTLE, TOLERATED = 3, 1.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, units, source_size, target) from rows (source, size, m), m equal rows each.

    Targets share the total of all sizes by weight; what exceeds ``cap`` times a source's
    size is shared again among the others.  Sources are ranked by range partitions and the
    number of sources in each, and the level is found in rounds of one sum: no task sees all
    sources, and the driver sees one row per partition.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    first = F.col("source").asc_nulls_last()
    placed = shared_checkpoint(by.repartitionByRange(first).sortWithinPartitions(first).withColumn("at", F.monotonically_increasing_id()))
    part, offsets, rank = F.shiftright("at", 33), {}, 0
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets[r["part"]], rank = rank, rank + r["n"]
    if not offsets:
        return by.withColumn("target", F.lit(0.0))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]), part)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((offset + F.col("at").bitwiseAND((1 << 33) - 1)) % len(weights) + 1).cast("int"))
    weighed = placed.select("source", "units", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("limit"))
    total, all_w = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    held, open_w = 0, all_w
    while True:
        # Capped at the level of the last round; levels only rise, so a capped source stays capped.
        capped = F.col("w") * F.lit(total - held) > F.col("limit") * F.lit(open_w)
        least = weighed.agg(F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(capped, F.col("w"))), F.lit(0))).first()
        if (least[0], all_w - least[1]) == (held, open_w) or least[1] == all_w:
            break
        held, open_w = least[0], all_w - least[1]
    target = F.when(capped, F.col("limit").cast("double")).otherwise((F.col("w") * F.lit(total - held)).cast("double") / F.lit(open_w))
    return weighed.select("source", "units", "source_size", target.alias("target"))


def _uniform(seed: int, a: Column, b: Column) -> Column:
    """In [0, 1), from the two units that meet."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), a, b), 11) / F.lit(float(1 << 53))


def _pivot(units: Column, seed: int) -> Column:
    """One pass over an array of (s, u, p): the unresolved unit (u, p, s) and the units that became 1."""
    start = F.struct(
        F.lit(None).cast("struct<doc_id:bigint,size:bigint>").alias("u"), F.lit(0.0).alias("p"), F.lit(1.0).alias("s"),
        F.array().cast("array<struct<doc_id:bigint,size:bigint>>").alias("won"),
    )
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    open_ = lambda p: (p > NEAR) & (p < 1 - NEAR)

    def step(a: Column, x: Column) -> Column:
        up = F.least((1 - a["p"]) * a["s"], x["p"] * x["s"])
        down = F.least(a["p"] * a["s"], (1 - x["p"]) * x["s"])

        def settle(t: Column) -> Column:
            rise = t["r"] * (t["up"] + t["down"]) < t["down"]
            pair = F.struct(
                F.when(rise, a["p"] + t["up"] / a["s"]).otherwise(a["p"] - t["down"] / a["s"]).alias("a"),
                F.when(rise, x["p"] - t["up"] / x["s"]).otherwise(x["p"] + t["down"] / x["s"]).alias("x"),
            )
            return let(pair, lambda q: F.struct(
                F.when(open_(q["a"]), a["u"]).otherwise(x["u"]).alias("u"),
                F.when(open_(q["a"]), q["a"]).when(open_(q["x"]), q["x"]).otherwise(F.lit(0.0)).alias("p"),
                F.when(open_(q["a"]), a["s"]).otherwise(x["s"]).alias("s"),
                F.concat(a["won"], F.filter(F.array(F.when(q["a"] >= 1 - NEAR, a["u"]), F.when(q["x"] >= 1 - NEAR, x["u"])), lambda v: v.isNotNull())).alias("won"),
            ))

        met = let(F.struct(up.alias("up"), down.alias("down"), _uniform(seed, a["u"], x["u"]).alias("r")), settle)
        return F.when(a["p"] <= NEAR, F.struct(x["u"].alias("u"), x["p"].alias("p"), x["s"].alias("s"), a["won"].alias("won"))).otherwise(met)

    return F.aggregate(units, start, step)


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 20, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``size`` defaults to the number of words of ``text``.  Texts are read once; everything
    after works on a table of ids and sizes.  A hot source is spread over salts and leaves.
    """
    size = F.size(split_words(F.col("text"), WHITE)) if size is None else size
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"))
    units = shared_checkpoint(units.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = shared_checkpoint(source_targets(units, weights, cap))
    most = targets.agg(F.max("units")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, most), fan)))
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slot = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("units") / fan).cast("long"))
    spread = units.withColumn("salt", F.pmod(F.hash("doc_id", "size"), F.lit(SALTS)))
    joined = (
        spread.alias("u").join(salted.alias("t"), F.expr("u.source <=> t.source and u.salt = t.salt"))
        .select("u.source", "doc_id", "size", "m", "units", "source_size", "target")
        .withColumn("x", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m"))
        .withColumn("whole", F.floor(F.col("x") + NEAR))
        .withColumn("p", F.greatest(F.col("x") - F.col("whole"), F.lit(0.0)))
    )
    level = joined.filter((F.col("size") > 0) & (F.col("p") > NEAR)).select("source", slot.alias("slot"), F.col("size").cast("double").alias("s"), F.struct("doc_id", "size").alias("u"), "p")
    won = []
    for k in range(levels + 1):
        # Long documents meet first, so that what stays open in a node is most often a short one.
        node = shared_checkpoint(level.groupBy("source", "slot").agg(_pivot(F.reverse(F.array_sort(F.collect_list(F.struct("s", "u", "p")))), seed + k).alias("r")))
        won.append(node.select("source", F.explode("r.won").alias("u")))
        level = node.filter(F.col("r.p") > NEAR).select("source", F.expr(f"slot div {fan}").alias("slot"), "r.s", "r.u", "r.p")
    won.append(level.filter(F.col("p") >= 0.5).select("source", "u"))  # slot is 0 by now: one for each source
    chosen = reduce(DataFrame.unionByName, won)
    chosen = chosen.select("source", F.col("u.doc_id").alias("doc_id"), F.col("u.size").alias("size"), F.lit(1).alias("extra"))
    on = F.expr("j.doc_id <=> c.doc_id and j.size = c.size and j.source <=> c.source")
    out = joined.alias("j").join(chosen.alias("c"), on, "left").select("j.*", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("all_copies"))
    out = _settled(shared_checkpoint(out), cap)
    copies = F.expr("all_copies div m") + F.when(F.col("at") < F.expr("all_copies % m"), 1).otherwise(0)
    out = out.withColumn("at", F.explode(F.expr("sequence(0L, m - 1)"))).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _settled(units: DataFrame, cap: int) -> DataFrame:
    """``units`` with one copy more or less of a single unit per source and round, where that brings the source nearer its target.

    The last unit of a source is rounded to whole copies, which for a long document can miss
    a small target by much.  The unit whose size is next to the miss makes up for most of it.
    """
    for _ in range(SETTLE):
        miss = units.groupBy("source").agg((F.first("target") - F.sum(F.col("all_copies") * F.col("size"))).alias("miss"))
        miss = miss.filter(F.abs("miss") > TOLERATED)
        if miss.isEmpty():
            break
        salted = miss.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = units.withColumn("salt", F.pmod(F.hash("doc_id", "size"), F.lit(SALTS)))
        room = F.when(F.col("miss") > 0, F.col("u.all_copies") < F.col("u.m") * cap).otherwise(F.col("u.all_copies") > 0)
        left = F.abs(F.abs("miss") - F.col("u.size"))
        near = spread.alias("u").join(salted.alias("t"), F.expr("u.source <=> t.source and u.salt = t.salt")).filter(room & (F.col("u.size") > 0) & (left < F.abs("miss")))
        best = near.groupBy("u.source").agg(F.min_by(F.struct("u.doc_id", "u.size", F.signum("miss").cast("long").alias("step")), F.struct(left, F.col("u.size"), F.col("u.doc_id"))).alias("b"))
        best = shared_checkpoint(best.select("source", "b.doc_id", "b.size", "b.step"))
        if best.isEmpty():
            break
        on = F.expr("u.doc_id <=> b.doc_id and u.size = b.size and u.source <=> b.source")
        units = units.alias("u").join(best.alias("b"), on, "left").select(*[F.col(f"u.{c}") for c in units.columns if c != "all_copies"], (F.col("u.all_copies") + F.coalesce("b.step", F.lit(0))).alias("all_copies"))
    return units


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
