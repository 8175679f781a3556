"""One file per record, as a data source: a table's rows become files, all of them or none, and rows again.

Tasks write below a folder of their own attempt; when every task has ended, the commit moves
the files of the attempts that counted, and what other attempts left goes with the folder.
A task reads some thousand files, or as many as fill its share of bytes.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files of a task that reads, and the bytes from which it takes no more; the same for an Arrow batch.
TASK, BATCH = (20_000, 128 << 20), (2_000, 8 << 20)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _runs(sized: Iterable[tuple[str, int]], most: tuple[int, int]) -> Iterator[list[tuple[str, int]]]:
    """Runs of (name, size) in order: as many as ``most`` allows in number and bytes, one at least."""
    run, held = [], 0
    for name, size in sized:
        if run and (len(run) >= most[0] or held + size > most[1]):
            yield run
            run, held = [], 0
        run.append((name, size))
        held += size
    if run:
        yield run


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt and the names in it."""

    folder: str
    names: list[str]


class RecordWriter(DataSourceWriter):
    """Writes (file, content) rows below a path; the same name twice is an error, and so is one that leads elsewhere."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _opened(self.path)
        folder = f"{posixpath.basename(self.staging)}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        names: set[str] = set()
        for file, content in iterator:
            if not file or file in names or "/" in file or file in (".", ".."):
                raise ValueError(f"no name for a file, or one that is there already: {file!r}")
            names.add(file)
            with files.open_output_stream(f"{root}/{folder}/{file}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Written(folder, sorted(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.path)
        seen: set[str] = set()
        for message in filter(None, messages):
            if again := seen & set(message.names):
                self.abort(messages)
                raise ValueError(f"written by two tasks: {sorted(again)[:5]}")
            seen |= set(message.names)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File and old.base_name not in seen:
                    files.delete_file(old.path)
        for message in filter(None, messages):
            for name in message.names:
                files.move(f"{root}/{message.folder}/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.path)
        self._clear(files, root)

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        at = f"{root}/{posixpath.basename(self.staging)}"
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


@dataclass
class Some(InputPartition):
    """Files of a folder by name, with their sizes."""

    sized: list[tuple[str, int]]


class RecordReader(DataSourceReader):
    """(path, content) of the files of a folder; hidden ones (with _ or . before the name) and folders are left out."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        shown = ((f.base_name, f.size) for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "_.")
        return [Some(run) for run in _runs(shown, TASK)] or [Some([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.path)
        shown = self.path if "://" in self.path or self.path.startswith("file:") else f"file:{self.path}"
        for run in _runs(partition.sized, BATCH):
            contents = []
            for name, _ in run:
                with files.open_input_stream(f"{root}/{name}") as held:
                    contents.append(held.read())
            yield pa.record_batch([pa.array([f"{shown}/{name}" for name, _ in run], pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


class RecordFiles(DataSource):
    """``df.write.format("record_files").save(path)`` for rows (file string, content string or binary); ``load`` gives (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["file", "content"]:
            raise ValueError("record_files takes the columns file and content")
        return RecordWriter(self.options["path"], overwrite)


def write_records(df: DataFrame, path: str, file: Column, content: Column, overwrite: bool = False) -> None:
    """Each row as a file of its own; ``overwrite`` takes away other files of the folder.

    A file costs far more than the bytes of its row, by which adaptive execution would put all
    rows into few tasks: they are dealt over all cores by name, so one name meets in one task.
    """
    df.sparkSession.dataSource.register(RecordFiles)
    rows = df.select(file.alias("file"), content.alias("content")).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "file")
    rows.write.format("record_files").mode("overwrite" if overwrite else "append").save(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("record_files").load(path)
