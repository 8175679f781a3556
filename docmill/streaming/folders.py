"""Folders of versions: what earlier batches wrote, and one helper for files on any file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, folder: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, folder: str) -> bool:
    fs, p = _path(spark, folder)
    return fs.exists(p)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    fs, p = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, folder: str) -> None:
    fs, p = _path(spark, folder)
    fs.delete(p, True)


def epoch_of(batch: DataFrame) -> str:
    """The id of the streaming query that a batch belongs to: a checkpoint keeps it over restarts, a fresh one gets another.

    Outside of a stream there is none, and all batches share one epoch.
    """
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def versions(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(epoch, batch) of the versions written below ``folder``."""
    found = []
    for epoch in children(spark, folder):
        if epoch.startswith("epoch="):
            found += [(epoch[6:], int(b[6:])) for b in children(spark, f"{folder}/{epoch}") if b.startswith("batch=") and exists(spark, f"{folder}/{epoch}/{b}/_SUCCESS")]
    return found


def read_versions(spark: SparkSession, folder: str, schema: str, wanted: list[tuple[str, int]]) -> DataFrame:
    """The rows of these versions; an empty frame of ``schema`` if there are none."""
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/epoch={e}/batch={b}" for e, b in wanted])


def before(found: list[tuple[str, int]], epoch: str, batch: int) -> list[tuple[str, int]]:
    """Versions that a batch may see: all of other epochs, and the earlier ones of its own.  A repeated batch never sees itself."""
    return [(e, b) for e, b in found if e != epoch or b < batch]


