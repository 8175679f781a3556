"""Multi-label tagging by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(df: DataFrame, text: Column, labels: dict[str, str]) -> DataFrame:
    """One boolean column per label, all in one projection."""
    return df.select("*", *[F.coalesce(text.rlike(p), F.lit(False)).alias(k) for k, p in labels.items()])


def counts(tagged: DataFrame, labels: list[str]) -> DataFrame:
    """(label, n, percent): rows of each label, and the floor of their share."""
    sums = tagged.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(k).alias(k) for k in labels])
    return sums.unpivot("_all", labels, "label", "n").select("label", "n", F.expr("n * 100 div greatest(_all, 1)").alias("percent"))
