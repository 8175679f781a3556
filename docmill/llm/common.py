"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definitions of the operators use it.
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: While this holds, an execution gives its exchanges back to the disks when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or a temporary one where it is unset and the master is local.

    A cluster has to name a folder that all its machines share; a machine's own would lose
    what other machines are to read, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="docmill-")


def freeing(df: DataFrame) -> DataFrame:
    """``df``, whose own executions give back what their exchanges held on disk when they end."""
    spark = df.sparkSession
    before = spark.conf.get(_FREE, "false")
    try:
        spark.conf.set(_FREE, "true")
        return df.select("*")  # the setting is read when a frame is made
    finally:
        spark.conf.set(_FREE, before)


def shared_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder; what its exchanges held on disk is given back at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return freeing(df).checkpoint(eager=eager)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame that ``shared_checkpoint`` returned, once nothing will read it again.

    Spark itself deletes them, if at all, when the driver's collector finds the frame gone.
    """
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` has a fast path for pure ASCII, where both agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs between ``separators`` (a regular expression for one or more); null gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def row_key(id_column: Column, text: Column) -> Column:
    """A key that only rows with equal id and equal text share; never null."""
    return F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("null")), F.hex(F.xxhash64(text)), F.coalesce(F.length(text), F.lit(-1)).cast("string"))


def empty_spans() -> Column:
    return F.array().cast("array<struct<s:int,e:int>>")


def find_spans(text: Column, pattern: str, keep: Column | None = None, group: int | None = None, least: int = 0, tail: bool = False) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of (s, e) in code points.

    ``split`` and ``regexp_extract_all`` scan alike, so the pieces between matches and
    the matches themselves interleave to the whole text; their lengths give positions.
    With ``group`` and ``least``, matches whose group has fewer code points are dropped
    after matching; with ``tail``, the spans are those of the group, which has to end its match.
    Texts without any match cost one scan.
    """
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    matches = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    inner = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)))
    gaps = lengths(F.split(text, pattern))
    zipped = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"), inner.alias("i"))
    start = F.struct(F.lit(0).alias("at"), empty_spans().alias("out"))

    def step(a: Column, x: Column) -> Column:
        s, e = a["at"] + x["g"], a["at"] + x["g"] + x["m"]
        one = F.array(F.struct((e - x["i"] if tail else s).alias("s"), e.alias("e")))
        grown = F.when(x["i"] >= least, F.concat(a["out"], one)).otherwise(a["out"]) if least else F.concat(a["out"], one)
        return F.struct(e.alias("at"), grown.alias("out"))

    found = F.aggregate(zipped, start, step, lambda a: a["out"])
    there = F.coalesce(text.rlike(pattern), F.lit(False))
    return F.when(there if keep is None else keep & there, found).otherwise(empty_spans())
