"""Media columns by content-defined chunking.

A text becomes an image of 8-bit samples, 64 to a row (a binary PGM file, the samples
being its bytes, padded with zeros).  The file is cut where a rolling gear hash of the
last 32 bytes has 13 zero bits, within bounds; chunks are named by their SHA-256 digest.
Equal chunks, of whatever document, are stored once: Spark groups them by digest.  Each
distinct file is an ordered list of digests.  Reading joins the lists with the store,
brings the chunks of a file together in order (a file of one chunk needs no further
shuffle), verifies every digest and the file's, and decodes the samples.  Chunks travel compressed.  A digest that very many files share is
joined by several tasks.

Nulls and edge cases: a null text is empty, and empty text is one row of zero samples;
equal texts share one stored file and get equal values; repeated rows are repeated; a
null doc_id is kept; texts of any length are cut, and read back chunk by chunk; other
columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 64
LEAST, BITS, MOST = 2 << 10, 13, 64 << 10
#: Files that share a chunk, from which the chunk is joined by several tasks.
HOT, SALTS = 512, 32
_GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def to_media(data: bytes | None) -> tuple[bytes, bytes]:
    """(file, payload) of a text."""
    data = data or b""
    payload = data + bytes(-len(data) % WIDTH if data else WIDTH)
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload, payload


def cuts(file: bytes) -> list[int]:
    """Ends of the chunks.  The gear hash of all places is made in five doubling steps."""
    if len(file) <= LEAST:
        return [len(file)]
    h = _GEAR[np.frombuffer(file, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, at = [], 0
    while len(file) - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[i]) if i < len(marks) else len(file), at + MOST, len(file))
        out.append(end)
        at = end
    if at < len(file):
        out.append(len(file))
    return out


def chunks(file: bytes) -> list[bytes]:
    ends = cuts(file)
    return [file[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_bytes, file, digests)."""
    for batch in batches:
        rows = [(len(t or b""), to_media(t)[0]) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([hashlib.sha256(f).digest() for _, f in rows], pa.binary()), pa.array([[hashlib.sha256(c).digest() for c in chunks(f)] for _, f in rows], pa.list_(pa.binary()))],
            names=["doc_id", "n_bytes", "file", "digests"],
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (digest, packed), each digest once in a batch."""
    pack = zstandard.ZstdCompressor(level=6, write_checksum=False)
    for batch in batches:
        found: dict[bytes, bytes] = {}
        for text in batch.column(0).to_pylist():
            for c in chunks(to_media(text)[0]):
                digest = hashlib.sha256(c).digest()
                if digest not in found:
                    found[digest] = pack.compress(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "packed"])


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, file, digests): one row per row of ``docs``; file is the digest of the whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_lists, "doc_id long, n_bytes long, file binary, digests array<binary>")


def chunk_store(docs: DataFrame) -> DataFrame:
    """(digest, packed): every distinct chunk once, compressed."""
    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_pieces, "digest binary, packed binary").dropDuplicates(["digest"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, digest, packed), sorted, to the properties of each file, as read from its chunks."""
    unpack = zstandard.ZstdDecompressor()

    class File:
        def __init__(self, digest: bytes) -> None:
            self.digest, self.size, self.head, self.tail = digest, 0, b"", b""
            self.whole, self.payload = hashlib.sha256(), hashlib.sha256()
            self.counts, self.room = np.zeros(256, np.int64), -1

        def add(self, chunk: bytes) -> None:
            self.whole.update(chunk)
            self.size += len(chunk)
            if self.room < 0:  # the header lies within the first chunk, as the least chunk is longer
                head = b"\n".join(chunk.split(b"\n", 3)[:3]) + b"\n"
                width, height = map(int, head.split()[1:3])
                self.room, chunk = width * height, chunk[len(head) :]
            self.payload.update(chunk)
            self.counts += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
            self.tail = (self.tail + chunk)[-WIDTH:]

        def told(self) -> tuple:
            total = int(self.counts.sum())
            if self.whole.digest() != self.digest or total != self.room:
                raise ValueError("a stored file does not read back")
            share = self.counts[self.counts > 0] / total
            mean = float(self.counts @ np.arange(256)) / total
            feature = f"{mean:.4f}:{-float((share * np.log2(share)).sum()):.4f}:{len(share)}"
            return self.digest, total, self.payload.hexdigest(), zlib.crc32(self.tail), self.size, self.whole.hexdigest(), feature

    def told(done: list[File]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["file", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(f.told() for f in done), strict=True), kinds, strict=True)], names=names)

    now: File | None = None
    for batch in batches:
        done = []
        for file, digest, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if now is None or now.digest != file:
                if now is not None:
                    done.append(now)
                now = File(file)
            chunk = unpack.decompress(packed)
            if hashlib.sha256(chunk).digest() != digest:
                raise ValueError("a stored chunk does not match its digest")
            now.add(chunk)
        if done:
            yield told(done)
    if now is not None:
        yield told([now])


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """(file, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): each distinct file, reassembled from the store."""
    files = lists.select("file", "digests").dropDuplicates(["file"])
    # A file of one chunk is that chunk: the store already deals it whole to one task.
    single = files.filter(F.size("digests") == 1).select("file", F.col("digests")[0].alias("digest")).join(store, "digest").select("file", F.lit(0).alias("at"), "digest", "packed")
    parts = files.filter(F.size("digests") > 1).select("file", F.posexplode("digests").alias("at", "digest"))
    hot = parts.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT).select("digest")
    cold = parts.join(hot, "digest", "left_anti").join(store, "digest").select("file", "at", "digest", "packed")
    salt = F.pmod(F.hash("file"), F.lit(SALTS))
    copies = store.join(hot, "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    warm = parts.join(hot, "digest", "left_semi").withColumn("salt", salt).join(copies, ["digest", "salt"]).select("file", "at", "digest", "packed")
    rows = cold.unionByName(warm).repartition("file").sortWithinPartitions("file", "at")
    schema = "file binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_decode, schema).unionByName(single.mapInArrow(_decode, schema))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lists = chunk_lists(docs)
    return lists.select("doc_id", "n_bytes", "file").join(read_media(lists, chunk_store(docs)), "file").drop("file")
