"""Quality by compression: zstandard dictionaries of good and of bad text.

Whole labelled texts, a bounded sample of each class (``SAMPLE`` documents, the least by
a hash of their id), fill one raw-content dictionary for each class from one half of the
sample.  A text is compressed against both and without a dictionary; the difference of
the two sizes over their sum says which class it resembles, and the saving by each
dictionary, the plain ratio and the length say how far to trust that.  The other half of
the sample calibrates these figures to a probability by a logistic curve, whose intercept
allows for the share of good labels.

Nulls and edge cases: a null text counts as empty; an empty text compresses alike against
both, so its score is the curve's value there; equal texts score
alike; a null doc_id is not held out; rows of ``labels`` without a quality, and columns
other than the named ones, are ignored.  If a class has no labelled text, every score is
the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import fit_logistic, held_out, logistic
from .common import table

#: Labelled documents of each class that are used at most, and bytes of each dictionary.
SAMPLE, DICTIONARY = 1200, 1 << 20
LEVEL = 6
#: Bytes of a text that are compressed at once: well below the match window of LEVEL (2 MiB), beyond which a dictionary is out of sight.
PART = 512 << 10
THRESHOLD = 0.7

_READY: dict[bytes, tuple] = {}


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """(doc_id, text, y): up to ``limit`` labelled documents of each class, those present with the least hashes of the id."""
    known = labels.filter(usable & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    present = known.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    order = F.xxhash64(F.lit(7), "_id")
    ids = None
    for value in (0, 1):
        one = present.filter(F.col("_y") == value).orderBy(order, "_id").limit(limit)
        ids = one if ids is None else ids.unionByName(one)
    # At most 2 * limit ids: small enough to broadcast whatever the input.
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_y").alias("y"))


def _content(texts: list[bytes], size: int) -> bytes:
    """Whole texts in the given order, those that still fit into ``size`` bytes."""
    out, total = [], 0
    for t in texts:
        if total + len(t) + 1 <= size:
            out.append(t)
            total += len(t) + 1
    return b"\n".join(out)


def figures(data: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, plain: zstandard.ZstdCompressor) -> list[float]:
    """The first is positive if ``data`` compresses better with the good dictionary.

    Sizes are sums over parts, so that each byte of a long text is compared with both dictionaries.
    """
    parts = [data[i : i + PART] for i in range(0, len(data), PART)] or [data]
    g, b, n = (sum(len(c.compress(p)) for p in parts) for c in (good, bad, plain))
    return [(b - g) / (b + g), n / (len(data) + 1), math.log(len(data) + 1), (n - g) / n, (n - b) / n]


def _compressors(model: dict) -> tuple:
    key = model["id"]
    if key not in _READY:
        _READY.clear()
        made = []
        for content in (model["good"], model["bad"]):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False))
        made.append(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False))
        _READY[key] = tuple(made)
    return _READY[key]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = SAMPLE) -> dict:
    """The model: two dictionaries and the curve.  At most 2 * ``limit`` texts come to the driver."""
    rows = sample(docs, labels, "quality", usable, limit).collect()
    # Equal texts once, in an order that only depends on the text.
    distinct = sorted({(xxhash.xxh64_intdigest(bytes(r["text"])), bytes(r["text"]), r["y"]) for r in rows if r["text"]})
    texts = {y: [t for _, t, v in distinct if v == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        total = len(texts[0]) + len(texts[1])
        return {"id": b"constant", "constant": len(texts[1]) / total if total else 0.5}
    model = {"good": _content(texts[1][::2], DICTIONARY), "bad": _content(texts[0][::2], DICTIONARY)}
    model["id"] = hashlib.sha256(len(model["good"]).to_bytes(8, "big") + model["good"] + model["bad"]).digest()
    ready = _compressors(model)
    rest = [(t, y) for y in (0, 1) for t in (texts[y][1::2] or texts[y])]
    curve = fit_logistic(np.array([figures(t, *ready) for t, _ in rest]), np.array([y for _, y in rest]))
    known = labels.filter(usable & F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double")).alias("good")).first()["good"]
    curve[-1] += math.log(known / (1 - known))
    model["curve"] = curve.tolist()
    return model


def score(docs: DataFrame, model: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` and score, in [0, 1]; a carried column of that name gives way."""
    names = ["doc_id", *[c for c in carry if c not in ("doc_id", "score")]]
    found = _scored(docs.select(F.col("text").cast("binary").alias("_data"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]), model)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_score").alias("score"))


def _scored(rows: DataFrame, model: dict) -> DataFrame:
    """``rows``, of which the first column is the text, without it and with _score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if "constant" in m:
                values = np.full(batch.num_rows, m["constant"])
            else:
                ready = _compressors(m)
                values = logistic(np.array([figures(t or b"", *ready) for t in batch.column(0).to_pylist()]).reshape(-1, 5), np.array(m["curve"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values)], names=[*batch.schema.names[1:], "_score"])

    return rows.mapInArrow(run, rows.select(*rows.columns[1:]).schema.add("_score", "double"))


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score under ``threshold``; all columns stay, whatever their names.

    Null and empty texts have the score of an empty text; equal rows stay or go together.
    """
    model = fit(docs, labels, usable)
    found = _scored(docs.select(F.col("text").cast("binary").alias("_data"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), model)
    return found.filter(F.col("_score") >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
