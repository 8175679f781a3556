"""Micro-batch ingestion with remembered keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import content_hash
from . import folders


def dedup_stream(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide or size)).agg(F.count(F.lit(1)).alias("n"))


def ingest(spark: SparkSession, stream: DataFrame, target: str, state: str, checkpoint: str, text: str = "text", seq: str = "doc_id") -> StreamingQuery:
    """Append what is new: each batch is de-duplicated by content, then against the state of the batches before it, and both are written.

    Runs over what is there and stops.  Output and state are kept by epoch (the query's id,
    which a checkpoint keeps) and batch: a batch that is repeated after a failure compares
    itself with earlier batches only and writes to its own folders again, and a fresh checkpoint
    sees all that older epochs wrote and overwrites none of it.  Null and empty texts are no
    content: all their rows are kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        epoch = folders.epoch_of(batch)
        blank = F.coalesce(F.col(text), F.lit("")) == ""
        keyed = batch.filter(~blank).withColumn("_key", content_hash(F.col(text)))
        fresh = keyed.groupBy("_key").agg(F.min_by(F.struct(*batch.columns), F.col(seq)).alias("r"))
        old = folders.read_versions(spark, state, "_key string", folders.before(folders.versions(spark, state), epoch, number))
        fresh = fresh.join(old, "_key", "left_anti").persist()
        fresh.select("r.*").unionByName(batch.filter(blank)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}/batch={number}")
        fresh.select("_key").write.mode("overwrite").parquet(f"{state}/epoch={epoch}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What all epochs appended."""
    return folders.read_versions(spark, target, schema, folders.versions(spark, target))


def forget(spark: SparkSession, checkpoint: str, state: str | None = None) -> None:
    """Start over: without ``state``, the input is read again and what was seen stays known; with it, everything is new again."""
    for path in (checkpoint, state):
        if path is not None:
            folders.delete(spark, path)
