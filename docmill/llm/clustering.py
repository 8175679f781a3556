"""Centroid clustering by ball-tree filtering.

Vectors become integer vectors.  Each task builds metric trees over blocks of what it reads;
a node, or ball, stores how many vectors it holds, their componentwise integer sum, and a
radius around their mean.  The trees are written once.  A round sends the centroids to the
trees: where the triangle inequality says that one centroid is nearer to every vector of a
ball than any other, the whole ball goes there by its count and sum alone; centroids that
can't be nearest to any vector of a ball are dropped for all below it; what reaches a leaf
is compared exactly in integers.  Rounding only makes a ball descend that need not have.

The driver sees k centroids and their sums.  Trees are partition-local and of bounded size,
so a task's memory holds one block, however many vectors there are.

Nulls and edge cases: vectors that are null, of another length, or with a null or non-finite
entry are left out.  A null id hashes after all others and stays null; repeated rows count
each.  Fewer vectors than ``k`` give as many centroids; none give no rows.  Ties of distance
go to the smaller number, ties of the starting hash to the smaller vector.  Components
beyond 2**27 raise an error, as squared distances would not fit a long.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table
from .vectors import integers, matrix, whole

#: Vectors in a tree, and in a leaf of it.
BLOCK, LEAF = 4096, 32
#: Up to this size of a component products and sums of 64 or fewer of them are exact as doubles.
EXACT = 1 << 21
#: Bounds must differ by this share of the numbers compared, far above the rounding of a square root.
MARGIN = 1e-9


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        u, v = x.astype(np.float64), c.astype(np.float64)
        return ((u * u).sum(1)[:, None] - 2 * (u @ v.T) + (v * v).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def build_tree(x: np.ndarray) -> dict:
    """A metric tree over the rows of ``x``: their order, and per node its range, children, mean, radius and sum."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1)]
    while todo:
        start, end, parent = todo.pop()
        mine = x[order[start:end]]
        total = mine.sum(0)
        mean = total / (end - start)
        away = np.sqrt(((mine - mean) ** 2).sum(1))
        nodes.append({"start": start, "end": end, "left": -1, "right": -1, "mean": mean, "radius": away.max() * (1 + MARGIN), "sum": total})
        me = len(nodes) - 1
        if parent >= 0:
            nodes[parent]["left" if nodes[parent]["left"] < 0 else "right"] = me
        if end - start > LEAF and away.max() > 0:
            # Along the line from the vector farthest from the mean to the one farthest from that.
            a = mine[away.argmax()]
            b = mine[((mine - a) ** 2).sum(1).argmax()]
            along = np.argsort(mine @ (b - a).astype(np.float64), kind="stable")
            order[start:end] = order[start:end][along]
            middle = (start + end) // 2
            todo += [(start, middle, me), (middle, end, me)]
    return {"order": order, **{k: np.array([n[k] for n in nodes]) for k in nodes[0]}}


def walk(tree: dict, x: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
    """(start, end, cluster or clusters, node) of ranges of the tree's order; node is -1 where clusters are per vector."""
    far = np.sqrt(((tree["mean"][:, None, :] - centroids[None]) ** 2).sum(2))
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, among = todo.pop()
        away, radius, (start, end) = far[node, among], tree["radius"][node], (tree["start"][node], tree["end"][node])
        most = (away.min() + radius) * (1 + MARGIN)
        among = among[(away - radius) * (1 - MARGIN) <= most]
        if len(among) == 1:
            yield start, end, int(among[0]), node
        elif tree["left"][node] >= 0:
            todo += [(tree["left"][node], among), (tree["right"][node], among)]
        else:
            yield start, end, among[distances(x[start:end], centroids[among]).argmin(1)], -1


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            while sum(b.num_rows for b in held) >= BLOCK:
                block = pa.Table.from_batches(held)
                yield block.slice(0, BLOCK)
                held = block.slice(BLOCK).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _grow(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = matrix(block["x"].combine_chunks(), size)
            tree = build_tree(x)
            order = tree.pop("order")
            ids = block["vec_id"].combine_chunks().take(pa.array(order))
            small = np.int32 if np.abs(x).max(initial=0) < 2**31 else np.int64
            yield pa.RecordBatch.from_pydict({"ids": [ids.to_pylist()], "points": [x[order].astype(small).tobytes()], "wide": [small is np.int64], "tree": [pickle.dumps(tree)]}, TREES)

    return grow


TREES = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("wide", pa.bool_()), ("tree", pa.binary())])
SUMS = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
PLACED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _trees(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, dict]]:
    for batch in batches:
        for ids, points, wide, tree in zip(*batch.columns, strict=True):
            x = np.frombuffer(points.as_py(), np.int64 if wide.as_py() else np.int32).astype(np.int64).reshape(-1, size)
            yield ids.values, x, pickle.loads(tree.as_py())


def _summed(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and sums of each cluster over the trees of a task."""
    k, size = centroids.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x, tree in _trees(batches, size):
            for start, end, cluster, node in walk(tree, x, centroids):
                if node >= 0:
                    n[cluster] += end - start
                    total[cluster] += tree["sum"][node]
                else:
                    np.add.at(n, cluster, 1)
                    np.add.at(total, cluster, x[start:end])
        if n.any():
            yield pa.RecordBatch.from_pydict({"cluster": np.repeat(np.arange(k, dtype=np.int32), size), "at": np.tile(np.arange(size, dtype=np.int32), k), "n": np.repeat(n, size), "total": total.ravel()}, SUMS)

    return add


def _assigned(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _trees(batches, centroids.shape[1]):
            cluster = np.zeros(len(x), np.int32)
            for start, end, found, _ in walk(tree, x, centroids):
                cluster[start:end] = found
            away = ((x - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(away)], schema=PLACED)

    return assign


def starting_hash(vec_id: Column) -> Column:
    """Lowercase hex SHA-256 of ``1:<id>``; null for a null id."""
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")).cast("binary"), 256)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) per kept row of ``vectors`` (vec_id, embedding), and the final centroids."""
    spark = vectors.sparkSession
    kept = vectors.filter(whole(F.col("embedding")) & (F.size("embedding") == size)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("x"))
    first = kept.select("x", starting_hash(F.col("vec_id")).alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = np.array([r["x"] for r in first], np.int64)
    trees = shared_checkpoint(kept.mapInArrow(_grow(size), "ids array<long>, points binary, wide boolean, tree binary"))
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(centroids), "cluster int, at int, n long, total long")
        for r in sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            if r["n"]:
                centroids[r["cluster"], r["at"]] = r["total"] // r["n"]
    return trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), centroids.tolist()


def with_inertia(placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``placed`` with cluster_inertia, inertia and centroid_sha256; the joined table has one row per centroid."""
    spark = placed.sparkSession
    placed = shared_checkpoint(placed)
    found = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, found.get(i, 0), sum(found.values()), digest(c)) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))


def _round(n: int) -> str:
    """SQL of the assignment by centroids c{n} and, from it, centroids c{n+1}."""
    return f"""
    a{n} AS MATERIALIZED (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
           FROM (SELECT v.row, c.cluster, sum((v.v - c.v) * (v.v - c.v))::BIGINT AS distance FROM x v JOIN c{n} c USING (i) GROUP BY ALL) GROUP BY row),
    c{n + 1} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce(m.v, c.v) AS v FROM c{n} c
           LEFT JOIN (SELECT cluster, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM a{n} JOIN x USING (row) GROUP BY ALL) m USING (cluster, i)),"""


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS xs FROM embeddings
       WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    x AS MATERIALIZED (SELECT row, unnest(xs) AS v, unnest(range(64)) AS i FROM kept),
    c0 AS MATERIALIZED (SELECT cluster, unnest(xs) AS v, unnest(range(64)) AS i FROM (SELECT xs, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept) WHERE cluster < 16),
    {_round(0)}{_round(1)}{_round(2)}{_round(3)}
    per AS (SELECT cluster, sum(distance) AS s FROM a3 GROUP BY cluster),
    digests AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c3 GROUP BY cluster)
SELECT vec_id, a3.cluster::INT AS cluster, distance, s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM per)::BIGINT AS inertia, h AS centroid_sha256
FROM kept JOIN a3 USING (row) JOIN per USING (cluster) JOIN digests USING (cluster)
"""
