"""Operators that choose rows: first per key, best k, ordered distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut_lineage


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (which should be total).

    An aggregation rather than a window: partial results meet before the shuffle, so a key
    that holds most rows costs no more than any other.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = df.groupBy(*named).agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    return out.select("_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps no more than that of each before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def spread_numbers(df: DataFrame, keys: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the number of each row in its key, from 1, in order of ``order`` (which should be total).

    No task holds a key: rows are sorted by range of key and order, so a key that is hot lies
    in several partitions; a row's number is its place in its partition and key, and the rows
    that the partitions before it hold of that key.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"))
    placed = cut_lineage(rows.repartitionByRange("_k", "_o").sortWithinPartitions("_k", "_o").drop("_o").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_k", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_k").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("_k", "_part", (before - F.col("_first") + 1).alias("_start"))
    on = placed["_k"].eqNullSafe(starts["_k"]) & (placed["_part"] == starts["_part"])
    return placed.join(starts, on).select("_row.*", (F.col("_at") + F.col("_start")).alias(name))


def distinct_in_order(df: DataFrame, key: str, value: str, order: str, separator: str = "; ") -> DataFrame:
    """Distinct values of a key joined in order of first occurrence; nulls dropped."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]), separator).alias(value))
