"""The shared folder of a cluster, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="docmill-")


#: While this holds, an execution gives its exchanges back to the disks when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder; what the exchanges before it held on disk is given back at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_FREE, "false")
    try:
        spark.conf.set(_FREE, "true")
        own = df.select("*")  # the setting is read when a frame is made
    finally:
        spark.conf.set(_FREE, before)
    return own.checkpoint()


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut_lineage`` returned, once nothing will read it again."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
