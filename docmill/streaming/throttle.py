"""The adaptive delay of a domain as a fold over its fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONGEST = 30.0


def next_delay(delay: Column, status: Column, retry_after: Column) -> Column:
    """Success halves; 429 doubles or takes Retry-After, 403 adds half, 5xx a quarter; a delay of 0 starts from 1; none exceeds LONGEST; others, and no status, leave it."""
    base = F.when(delay == 0, F.lit(1.0)).otherwise(delay)
    up = F.when(status == 429, F.coalesce(retry_after, base * 2)).when(status == 403, base * 1.5).when(status >= 500, base * 1.25)
    return F.when(status < 400, delay / 2).when(up.isNotNull(), F.least(up, F.lit(LONGEST))).otherwise(delay)


def next_sync_delay(delay: Column, status: Column, base: float = 1.0, longest: float = 60.0) -> Column:
    """Success takes a quarter off, down to ``base``; 429 trebles, 401 and 403 double, 5xx add half, up to ``longest``."""
    now = F.when(delay == 0, F.lit(base)).otherwise(delay)
    up = F.when(status == 429, now * 3).when(status.isin(401, 403), now * 2).when(status >= 500, now * 1.5)
    return F.when(status < 400, F.greatest(F.lit(base), delay * 0.75)).when(up.isNotNull(), F.least(up, F.lit(longest))).otherwise(delay)


def cooldowns(searches: DataFrame, key: str, seq: str, step: int = 15, longest: int = 120) -> DataFrame:
    """``searches`` (limited, results) with cooldown, the wait before each: a step for each limit since results last came; empty results leave it."""
    before = W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    came = F.max(F.when(~F.col("limited") & (F.col("results") > 0), F.col(seq))).over(before)
    marked = searches.withColumn("_came", F.coalesce(came, F.lit(-1)))
    row = W.partitionBy(key, "_came").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    limits = F.coalesce(F.sum(F.col("limited").cast("int")).over(row), F.lit(0))
    return marked.withColumn("cooldown", F.least(limits * step, F.lit(longest))).drop("_came")


def fold_delays(log: DataFrame) -> DataFrame:
    """(domain, delay, n): rows (domain, seq, status, retry_after) in order of seq."""
    rows = log.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "retry_after"))).alias("xs"))
    return rows.select("domain", F.aggregate("xs", F.lit(0.0), lambda d, x: next_delay(d, x["status"], x["retry_after"])).alias("delay"), F.size("xs").alias("n"))


def fold_sync_delays(log: DataFrame) -> DataFrame:
    """(domain, delay, n) by the second machine, from its base."""
    rows = log.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("xs"))
    return rows.select("domain", F.aggregate("xs", F.lit(1.0), lambda d, x: next_sync_delay(d, x["status"])).alias("delay"), F.size("xs").alias("n"))
