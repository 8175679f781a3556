"""Embedding whitening by matrix-free block subspace iteration.

The covariance V of the vectors is never formed.  A Spark pass computes Xᵀ(XQ) for a block Q
of directions, X being the centred rows: each task adds up its own share and Spark sums the
shares.  QR keeps the directions orthonormal, Rayleigh-Ritz takes the best eigenvectors that
their span holds, and the residuals V u - e u say how good these are.  The next block is what
the residuals add to the span; the span keeps earlier blocks up to a bound, then restarts
from its Ritz vectors (plain powers of one block would need hundreds of passes where
eigenvalues are as close as those of embeddings are).  When the residuals of all k components
are below ``TOLERANCE`` of the largest eigenvalue, one more pass over the components
themselves has to certify them; otherwise the iteration goes on.

Vectors enter the fit once however often they occur.  The driver holds d x (a few blocks)
numbers, a task one Arrow batch.

Nulls and edge cases: rows whose vector is null, or holds a null or non-finite entry, are
left out, and so are vectors of another length than the most frequent one (of ties, the
longer).  A null id stays null; repeated rows are returned each.  Directions without variance
(eigenvalue at most ``FLAT`` of the trace) have no whitened form, so a table of r independent
distinct vectors has at most r - 1 components; one distinct vector or an empty table gives no
rows.  Where eigenvalues are equal, any orthonormal basis of their space is a right answer.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, shared_checkpoint, table
from .vectors import integers, matrix, whole

#: Directions of a block beyond the components asked for, and columns the Ritz span may have, in blocks.
MORE, SPAN = 16, 4
#: Residuals that certify a component, and eigenvalues that count as zero, as shares of the largest and of the trace.
TOLERANCE, FLAT = 1e-12, 1e-12
#: Passes after which the iteration gives up with an error.
PASSES = 200


class Centre:
    """The mean of the fitted integer vectors, kept as a whole part and a rest so that centring loses no digits."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, np.array(sums, np.int64)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n x - S)², exact; an error where a long can't hold it."""
        off = self.n * x - self.sums
        if (off.astype(np.float64) ** 2).sum(1).max(initial=0) >= 9.2e18:
            raise OverflowError("the deviation of a vector does not fit a long")
        return (off * off).sum(1)


def _totals(fit: DataFrame, share: Callable[[np.ndarray], np.ndarray], size: int, rows: int, kind: str) -> list[list]:
    """The sum over all vectors of the ``rows`` x m matrices that ``share`` gives for a batch; one matrix per task is moved."""
    schema = pa.schema([("at", pa.int32()), ("y", pa.list_(pa.int64() if kind == "long" else pa.float64()))])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = share(matrix(batch.column(0), size))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(rows, dtype=np.int32), "y": total.tolist()}, schema)

    parts = fit.mapInArrow(add, f"at int, y array<{kind}>")
    width = share(np.zeros((1, size), np.int64)).shape[1]
    summed = freeing(parts.groupBy("at").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(width)]).alias("y")))
    return [r["y"] for r in sorted(summed.collect())]


def _orthonormal(block: np.ndarray, beside: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal columns of ``beside``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # twice is enough
        block = block - beside @ (beside.T @ block)
        if not block.shape[1]:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
    return np.linalg.qr(block)[0]


def leading(apply: Callable[[np.ndarray], np.ndarray], size: int, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their eigenvectors of the symmetric operator ``apply``."""
    k = min(k, size)
    block = min(size, k + MORE)
    fresh = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, block)))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(PASSES):
        basis, image = np.hstack([basis, fresh]), np.hstack([image, apply(fresh)])
        inner = basis.T @ image
        e, w = np.linalg.eigh((inner + inner.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        ritz, turned = basis @ w, image @ w
        rest = turned - ritz * e
        fine = np.linalg.norm(rest[:, :k], axis=0) <= TOLERANCE * max(e[0], 0)
        if fine.all() and basis.shape[1] == k:
            return e[:k], ritz[:, :k]
        if fine.all():
            # The components alone, through one more pass: their own residuals have to certify them.
            basis, image, fresh = np.zeros((size, 0)), np.zeros((size, 0)), np.linalg.qr(ritz[:, :k])[0]
            continue
        fresh = _orthonormal(rest[:, :block], basis)
        if basis.shape[1] + fresh.shape[1] > max(size if size <= SPAN * block else 0, SPAN * block):
            basis, image = ritz[:, :block], turned[:, :block]
            fresh = _orthonormal(rest[:, :block], basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((size, block)), basis)
        if not fresh.shape[1]:  # the span is the whole space: what is left is rounding
            raise ArithmeticError("residuals stay above the tolerance in the whole space")
    raise ArithmeticError(f"no {k} components after {PASSES} passes")


def fit_whitening(x: DataFrame, size: int, k: int = 16) -> dict | None:
    """Centre, eigenvalues, components, trace and identity error from the distinct rows of ``x`` (x array<long>); None where nothing varies."""
    fit = shared_checkpoint(x.distinct())
    moments = _totals(fit, lambda rows: np.stack([np.full(size, len(rows)), rows.sum(0)], axis=1), size, size, "long")
    if not moments:
        return None
    centre = Centre(moments[0][0], [s for _, s in moments])
    trace = sum(y[0] for y in _totals(fit, lambda rows: (centre(rows) ** 2).sum(0)[:, None], size, size, "double")) / centre.n
    if trace <= 0:
        return None

    def apply(q: np.ndarray) -> np.ndarray:
        def share(rows: np.ndarray) -> np.ndarray:
            c = centre(rows)
            return c.T @ (c @ q)

        return np.array(_totals(fit, share, size, size, "double")) / centre.n

    values, components = leading(apply, size, k)
    there = values > FLAT * trace
    values, components = values[there], components[:, there]
    k = len(values)
    turn = components / np.sqrt(values)

    def products(rows: np.ndarray) -> np.ndarray:
        z = centre(rows) @ turn
        return np.hstack([z.T @ z, z.sum(0)[:, None]])

    z = np.array(_totals(fit, products, size, k, "double")) / centre.n
    error = float(np.abs(z[:, :k] - np.outer(z[:, k], z[:, k]) - np.eye(k)).max())
    return {"centre": centre, "values": values, "turn": turn, "trace": trace, "identity_error": error}


WHITE = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, k: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per kept row and component."""
    spark = vectors.sparkSession
    kept = vectors.filter(whole(F.col("embedding")))
    lengths = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale, shift).alias("x"))
    size = lengths["size"] if lengths else 0
    kept = kept.filter(F.size("x") == size)
    found = fit_whitening(kept.select("x"), size, k) if size else None
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    centre, turn, explained, error = found["centre"], found["turn"], found["values"] / found["trace"], found["identity_error"]
    k = len(explained)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), size)
            each = lambda v: np.repeat(v, k)
            columns = [
                batch.column(0).take(pa.array(each(np.arange(len(x))))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, centre.n, np.int64),
                each(centre.deviation(x)), (centre(x) @ turn).ravel(), np.tile(explained, len(x)), np.full(len(x) * k, error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=WHITE)

    return kept.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
