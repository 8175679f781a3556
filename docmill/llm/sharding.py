"""Sharding by longest processing time: shards of near equal bytes, equal texts together.

Groups of equal texts are ranked by bytes, largest first, and dealt in that order to the least
loaded shard, through a heap.  The heap is the only step that is not spread, so it may not
see every group: along the ranking, groups are bundled into stretches that each hold
1 / (FINE * shards) of the bytes from there to the end.  A group larger than that is a bundle
of its own, and bundles shrink to single groups towards the end, so the loads end up about as
even as if each group had been dealt singly.  A corpus of T bytes has at most
1 + FINE * shards * ln T bundles (some 8,000 for 16 shards and 100 TB), whatever its number of
groups: that many sums, and one sum per partition of the ranking, reach the driver.

Texts are read once for a digest; then rows of about a hundred bytes move.  The rows of hot
groups (more than 1 / HOT of all rows, so fewer than HOT groups) meet their shard by a broadcast.

Nulls and edge cases: a null text has no bytes and is together with empty texts; sizes are one
more than the bytes.  A null id comes first among the slots of its shard; repeated rows are
together and each have a slot.  A group larger than a shard's share stays whole, so its shard
is larger than the others.  No rows give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table

#: Bundles that a shard's share of what is left is cut into, and the largest number of hot groups.
FINE, HOT = 16, 2048


def group_key(text: Column) -> Column:
    """SHA-256 of the text's bytes; null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def deal(bundles: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each bundle: largest first, each to the least loaded shard, of equal ones the first."""
    heap, found = [(0, shard) for shard in range(shards)], {}
    for bundle, size in sorted(bundles.items(), key=lambda b: (-b[1], b[0])):
        load, shard = heap[0]
        found[bundle] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return found


def groups_to_shards(groups: DataFrame, shards: int) -> DataFrame:
    """(key, n, shard) from (key, n, bytes), one row per group; the join that adds the shard has a side of bounded size."""
    spark = groups.sparkSession
    ranked = groups.repartitionByRange(F.desc("bytes"), "key").sortWithinPartitions(F.desc("bytes"), "key").withColumn("part", F.spark_partition_id())
    ranked = shared_checkpoint(ranked)
    before, total = {}, 0
    for r in ranked.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect():
        before[r["part"]], total = total, total + r["bytes"]
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("bytes", pa.int64()), ("bundle", pa.int32())])

    def stretch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("bytes").to_numpy()
            # A task may read several partitions of the ranking one after the other.
            part, start = b.column("part").to_numpy(), np.zeros(len(size), np.int64)
            for p in np.unique(part):
                mine = part == p
                sums = done.get(p, before[p]) + np.cumsum(size[mine])
                start[mine], done[p] = sums - size[mine], sums[-1]
            bundle = np.floor(FINE * shards * np.log(total / (total - start))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), b.column("bytes"), pa.array(bundle)], schema=schema)

    bundled = ranked.mapInArrow(stretch, "key binary, n long, bytes long, bundle int")
    sums = {r["bundle"]: r["bytes"] for r in bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()}
    dealt = spark.createDataFrame(list(deal(sums, shards).items()), "bundle int, shard int")
    return bundled.join(F.broadcast(dealt), "bundle").select("key", "n", "shard")


def join_by_key(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the shard of their key; no task gets the rows of a hot group together."""
    groups = shared_checkpoint(groups)
    most = (groups.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(groups.filter(F.col("n") > most).select("key", "shard"))
    rest = groups.filter(F.col("n") <= most).select("key", "shard")
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(rest, "key"))


def balanced_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs`` (doc_id, text); slots number a shard's rows by id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), group_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("at"),
    )
    rows = shared_checkpoint(rows)
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    found = join_by_key(rows, groups_to_shards(groups, shards)).drop("key")
    order = ["shard", F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "at"]
    placed = shared_checkpoint(found).repartitionByRange(*order).sortWithinPartitions(*order).drop("at").withColumn("part", F.spark_partition_id())
    placed = shared_checkpoint(placed)
    before, seen = {}, Counter()
    for r in placed.groupBy("part", "shard").count().orderBy("part", "shard").collect():
        before[r["part"], r["shard"]] = seen[r["shard"]]
        seen[r["shard"]] += r["count"]
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, int], int] = defaultdict(int)
        for b in batches:
            part, shard = b.column("part").to_numpy(), b.column("shard").to_numpy()
            slot = np.zeros(len(part), np.int64)
            for p, s in {*zip(part.tolist(), shard.tolist(), strict=True)}:
                mine = (part == p) & (shard == s)
                slot[mine] = before[p, s] + done[p, s] + np.arange(mine.sum())
                done[p, s] += int(mine.sum())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "size", "text_crc32", "shard")], pa.array(slot)], schema=schema)

    return placed.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, slot long")


def write_shards(docs: DataFrame, folder: str, shards: int = 16, name: str = "shard") -> None:
    """Write whole documents as Parquet below ``folder``/``name``=N.  A column of the documents called ``name`` gives way to the number.

    Every column is written; texts move once at most, to meet the shard of their group.
    """
    others = [c for c in docs.columns if c != name]
    rows = docs.select(F.struct(*others).alias("row"), group_key(F.col("text")).alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))
    found = join_by_key(rows.select("row", "key"), groups_to_shards(groups, shards))
    found.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(folder)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balanced_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The heap as a recursion over bundles, each to the first of the least loaded shards; CRC-32 by its table of single bytes.
ORACLE_SQL = f"""
WITH RECURSIVE bits(b, v, k) AS (
        SELECT b, b::BIGINT, 0 FROM range(256) r(b) UNION ALL
        SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc_table AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
    docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents),
    grouped AS (SELECT text, sha256(text) AS h, sum(size)::BIGINT AS bytes FROM docs GROUP BY text),
    ranked AS (SELECT *, sum(bytes) OVER (ORDER BY bytes DESC, h ROWS UNBOUNDED PRECEDING)::BIGINT - bytes AS start, sum(bytes) OVER ()::BIGINT AS total FROM grouped),
    bundled AS MATERIALIZED (SELECT text, bytes, floor({FINE} * 16 * ln(total / (total - start)))::INT AS bundle FROM ranked),
    bundles AS MATERIALIZED (SELECT bundle, b, row_number() OVER (ORDER BY b DESC, bundle) AS i FROM (SELECT bundle, sum(bytes)::BIGINT AS b FROM bundled GROUP BY bundle)),
    heap(i, loads, shard, bundle) AS (
        SELECT 0::BIGINT, list_transform(range(16), lambda x: 0::BIGINT), -1::INT, -1::INT UNION ALL
        SELECT n.i, list_transform(range(16), lambda x: loads[x + 1] + CASE WHEN x + 1 = list_position(loads, list_min(loads)) THEN n.b ELSE 0 END),
               list_position(loads, list_min(loads))::INT - 1, n.bundle
        FROM heap JOIN bundles n ON n.i = heap.i + 1),
    crcs AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM grouped, crc_table)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, heap.shard, row_number() OVER (PARTITION BY heap.shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, NULL::INT AS grown_shard
FROM docs JOIN bundled USING (text) JOIN heap USING (bundle) JOIN crcs USING (text)
"""
