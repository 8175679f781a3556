"""From raw documents to a training mix: five stages, each written as Parquet before the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of documents.  ``run`` applies them to the
documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.calibration import held_out
from docmill.llm.common import shared_folder, table
from docmill.llm.decontamination import decontaminate
from docmill.llm.minhash import drop_near_duplicates
from docmill.llm.mixing import mix_sources
from docmill.llm.quality import keep_good
from docmill.llm.secrets import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; the classifier learns from the labelled documents among its input."""
    return keep_good(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))


#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words (op1 alone takes four)."""
    return drop_near_duplicates(docs, words=SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies and taken."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the random choices of the mix are not SQL; tests/llm has brute-force tests of the quality and near-duplicate stages and a run of all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows.  Stages are written below ``folder``, by default in the folder that spark.checkpoint.dir names."""
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
