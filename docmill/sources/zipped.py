"""Delimited tables inside ZIP archives, as a data source that streams members.

A member is a partition: its lines are inflated, split and cut to the wanted columns block by
block, so a task holds one block whatever the member's size.  Archives are opened where they
lie, on any file system that Arrow knows; nothing is unpacked to disk.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of an Arrow batch.
BLOCK = 8192


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def members(path: str, ending: str) -> Iterator[tuple[str, str]]:
    """(archive, member) of the members with an ending, of an archive or a folder of archives."""
    files, root = opened(path)
    found = files.get_file_info(root)
    archives = [root] if found.type == fs.FileType.File else sorted(f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.lower().endswith(".zip"))
    for archive in archives:
        with files.open_input_file(archive) as raw, zipfile.ZipFile(raw) as z:
            yield from ((archive, m.filename) for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith(ending))


@dataclass
class Member(InputPartition):
    archive: str
    member: str


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.path = schema.fieldNames(), options["path"]
        self.ending, self.separator, self.quoting = options.get("ending", ".tsv").lower(), options.get("sep", "\t"), options.get("quote", '"')

    def partitions(self) -> list[InputPartition]:
        return [Member(*m) for m in members(self.path, self.ending)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        csv.field_size_limit(1 << 30)
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        with files.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z, z.open(partition.member) as inflated:
            lines = csv.reader(io.TextIOWrapper(inflated, encoding="utf-8-sig", errors="replace", newline=""), delimiter=self.separator, quotechar=self.quoting)
            head = next(lines, [])
            if missing := [c for c in self.columns if c not in head]:
                raise ValueError(f"{partition.member} lacks {missing}")
            at, block = [head.index(c) for c in self.columns], []
            for row in lines:
                if row:
                    block.append([row[i] if i < len(row) and row[i] != "" else None for i in at])
                if len(block) == BLOCK:
                    yield self._batch(block, schema)
                    block = []
            if block:
                yield self._batch(block, schema)

    def _batch(self, rows: list[list[str | None]], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)


class ZippedTables(DataSource):
    """``spark.read.format("zipped_table")``: options path, ending, sep and quote; the schema names the columns to read, all strings."""

    @classmethod
    def name(cls) -> str:
        return "zipped_table"

    def schema(self) -> StructType:
        path, ending = self.options["path"], self.options.get("ending", ".tsv").lower()
        files, _ = opened(path)
        archive, member = next(members(path, ending), (None, None))
        if archive is None:
            raise ValueError(f"no member ends in {ending}")
        with files.open_input_file(archive) as raw, zipfile.ZipFile(raw) as z, z.open(member) as inflated:
            head = next(csv.reader(io.TextIOWrapper(inflated, encoding="utf-8-sig", newline=""), delimiter=self.options.get("sep", "\t")), [])
        return StructType([StructField(c, StringType()) for c in head])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(schema, self.options)


def read_zipped(spark: SparkSession, path: str, columns: list[str] | None = None, ending: str = ".tsv", sep: str = "\t") -> DataFrame:
    """The rows of all members with ``ending``; with ``columns``, only these are kept of each line.  Empty fields are null."""
    spark.dataSource.register(ZippedTables)
    reader = spark.read.format("zipped_table").option("ending", ending).option("sep", sep)
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.load(path)
