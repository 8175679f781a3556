"""A near-duplicate index that outlives a run.

Rows come in order; one is admitted unless an admitted row before it, of this run or an
earlier one, has the same content key or a shingle set of at least ``threshold`` Jaccard
similarity.  Only admitted rows enter the index.

On disk an index is two tables, each in versions named by epoch (the streaming query's id) and
batch.  ``keys`` holds band keys of MinHash sketches, ``members`` the content key and the text
of each admitted row, which compresses better than hashes of its shingles: these are made anew
for the few that a batch meets.  ``compact`` merges the versions of ended batches into one base,
whose keys are bucketed by key, so that later batches meet it without moving it.

A batch meets the index on its band keys, and full sets confirm what meets: a shared key alone
admits and rejects nothing.  A pair at 0.85 shares none of the 25 keys with a probability of 4e-7, and as
sketches depend on the text alone, the same pairs meet however rows are split into runs.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType

from ..functions.keys import content_hash
from ..functions.text import shingle_hashes
from ..lineage import cut_lineage, drop_checkpoint
from . import folders

#: Bands of a sketch, and minima in a band.
BANDS, DEPTH = 25, 5
#: Rounds by leaders before what is left of a batch is decided by pairs.
ROUNDS = 8
#: Files of a base's keys, unless the index is told otherwise.
BUCKETS = 64

MEMBERS, KEYS = "member string, content string, text string", "key long, n int, member string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit: multiply and shift twice."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)


@F.pandas_udf(ArrayType(LongType()))
def band_keys(hashes: pd.Series) -> pd.Series:
    """The band keys of each set of 64-bit hashes; none for an empty set."""
    seeds = _mixed(np.arange(1, BANDS * DEPTH + 1, dtype=np.uint64) << np.uint64(17)) | np.uint64(1)
    weights, bands = seeds[:DEPTH], np.arange(BANDS, dtype=np.uint64)

    def keys(h: np.ndarray) -> np.ndarray | None:
        if h is None or not len(h):
            return None
        x, least = np.asarray(h, np.int64).view(np.uint64), None
        for at in range(0, len(x), 4096):  # bounds memory for long texts
            part = _mixed(x[at : at + 4096, None] * seeds).min(0)
            least = part if least is None else np.minimum(least, part)
        return _mixed((least.reshape(BANDS, DEPTH) * weights).sum(1, dtype=np.uint64) + bands).view(np.int64)

    return hashes.map(keys)


def _set(text: Column, size: int) -> Column:
    """The shingle hashes of a text; none for a blank one."""
    blank = F.trim(F.regexp_replace(text, r"[\t\n\r\f\x0B]", " ")) == ""
    return F.when(blank, F.array().cast("array<long>")).otherwise(F.array_sort(shingle_hashes(text, size)))


def sketched(rows: DataFrame, text: str, seq: str, size: int = 3) -> DataFrame:
    """(id, content, member, n, keys) of rows with any text; member stands for the set, or for the content of a blank text, which has no keys."""
    named = rows.select(F.col(seq).alias("id"), F.col(text).alias("_t")).filter(F.coalesce(F.col("_t"), F.lit("")) != "")
    named = named.select("id", content_hash(F.col("_t")).alias("content"), _set(F.col("_t"), size).alias("s"))
    member = F.when(F.size("s") == 0, F.col("content")).otherwise(F.md5(F.array_join(F.transform("s", lambda x: x.cast("string")), ",")))
    return named.select("id", "content", member.alias("member"), F.size("s").alias("n"), band_keys("s").alias("keys"))


def _by_id(rows: DataFrame, text: str, seq: str) -> DataFrame:
    """(id, _t) of rows with any text, dealt and sorted by id on the executors' disks: what asks for texts of a batch comes to them, and they move once."""
    named = rows.select(F.col(seq).alias("id"), F.col(text).alias("_t")).filter(F.coalesce(F.col("_t"), F.lit("")) != "")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(parts, "id").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)


def keyed(sketches: DataFrame) -> DataFrame:
    """(key, n, member), one row per band of each distinct set."""
    one = sketches.filter("n > 0").groupBy("member").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    return one.select("member", "n", F.explode("keys").alias("key")).select("key", "n", "member")


def _alike(threshold: float) -> Column:
    k = F.size(F.array_intersect("x", "y"))
    return k >= threshold * (F.size("x") + F.size("y") - k) - 1e-9


class NearIndex:
    """The index below ``folder``; what is there already is known.

    A folder on a cluster has to be one that all machines share.  ``threshold``, ``size`` and ``buckets`` have to be the same each time.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.85, size: int = 3, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.threshold, self.size, self.buckets = spark, folder.rstrip("/"), threshold, size, buckets

    # -- what is there -------------------------------------------------------

    def _base(self) -> str | None:
        """The newest base that was written whole: its members, written last, and its list of versions."""
        whole = [b for b in folders.children(self.spark, f"{self.folder}/base") if folders.exists(self.spark, f"{self.folder}/base/{b}/members/_SUCCESS")]
        return max(whole, default=None)

    def _in_base(self, base: str | None) -> set[tuple[str, int]]:
        if base is None:
            return set()
        return {(r["epoch"], r["batch"]) for r in self.spark.read.parquet(f"{self.folder}/base/{base}/versions").collect()}

    def _parts(self, epoch: str | None, batch: int) -> tuple[str | None, list[tuple[str, int]]]:
        """The base and the versions beside it that a batch may see (``epoch`` None: all)."""
        base = self._base()
        beside = [v for v in folders.versions(self.spark, f"{self.folder}/members") if v not in self._in_base(base)]
        return base, beside if epoch is None else folders.before(beside, epoch, batch)

    def members(self, epoch: str | None = None, batch: int = 0) -> DataFrame:
        base, beside = self._parts(epoch, batch)
        rows = folders.read_versions(self.spark, f"{self.folder}/members", MEMBERS, beside)
        return rows if base is None else rows.unionByName(self.spark.read.schema(MEMBERS).parquet(f"{self.folder}/base/{base}/members"))

    def _base_keys(self, base: str) -> DataFrame:
        """The keys of the base as a bucketed table: named anew in each session, as its files outlive the catalog."""
        name = "near_keys_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{self.folder}/{base}").hex
        where = f"{self.folder}/base/{base}/keys".replace("'", "''")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({KEYS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    # -- a batch -------------------------------------------------------------

    def _sets(self, sketches: DataFrame, rows: DataFrame, text: str, seq: str, wanted: DataFrame) -> DataFrame:
        """(member, s) of the wanted members (member) of a batch, from the text of one row each."""
        one = sketches.join(wanted.distinct(), "member", "left_semi").groupBy("member").agg(F.min("id").alias("id"))
        return rows.select(F.col(seq).alias("id"), F.col(text).alias("_t")).join(one, "id").select("member", _set(F.col("_t"), self.size).alias("s"))

    def known(self, sketches: DataFrame, rows: DataFrame, text: str, seq: str, epoch: str | None = None, batch: int = 0) -> DataFrame:
        """(id) of those rows of a batch that the index rejects."""
        base, beside = self._parts(epoch, batch)
        if base is None and not beside:
            return sketches.select("id").limit(0)
        members = self.members(epoch, batch)
        probes = keyed(sketches).select("key", F.col("n").alias("m"), F.col("member").alias("mine"))
        room = F.least("n", "m") >= F.greatest("n", "m") * self.threshold - 1e-9
        tables = [folders.read_versions(self.spark, f"{self.folder}/keys", KEYS, beside)] + ([self._base_keys(base)] if base is not None else [])
        met = cut_lineage(reduce(DataFrame.unionByName, [probes.join(t, "key").filter(room).select("mine", "member") for t in tables]).distinct())
        held = members.join(met.select("member").distinct(), "member", "left_semi").select("member", _set(F.col("text"), self.size).alias("y"))
        mine = self._sets(sketches, rows, text, seq, met.select(F.col("mine").alias("member"))).withColumnRenamed("member", "mine").withColumnRenamed("s", "x")
        near = met.join(held, "member").join(mine, "mine").filter(_alike(self.threshold)).select(F.col("mine").alias("member")).distinct()
        same = sketches.join(members.select("content").distinct(), "content", "left_semi").select("id")
        found = cut_lineage(sketches.join(near, "member", "left_semi").select("id").unionByName(same).distinct())
        drop_checkpoint(met)
        return found

    def admit(self, rows: DataFrame, text: str, seq: str, epoch: str = "none", batch: int | None = None) -> DataFrame:
        """(seq) of the rows that are new, which then are in the index as version (epoch, batch).

        Null and empty texts are always new and never indexed.  Repeating a version replaces it.
        ``seq`` has to be unique among the rows.
        """
        if batch is None:
            known = self._in_base(self._base()) | set(folders.versions(self.spark, f"{self.folder}/members"))
            batch = 1 + max((b for e, b in known if e == epoch), default=-1)
        texts = _by_id(rows, text, seq)
        sketches = cut_lineage(sketched(texts, "_t", "id", self.size))
        fresh = sketches.join(self.known(sketches, texts, "_t", "id", epoch, batch), "id", "left_anti")
        kept = self._among(fresh, texts, "_t", "id")
        new = sketches.join(kept, "id", "left_semi")
        at = f"epoch={epoch}/batch={batch}"
        keyed(new).write.mode("overwrite").parquet(f"{self.folder}/keys/{at}")
        held = texts.withColumnRenamed("_t", "text").join(new.select("id", "member", "content"), "id").select("member", "content", "text")
        held.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/members/{at}")
        empty = rows.filter(F.coalesce(F.col(text), F.lit("")) == "").select(F.col(seq).alias("id"))
        drop_checkpoint(sketches)
        texts.unpersist()
        return kept.unionByName(empty).withColumnRenamed("id", seq)

    def _among(self, sketches: DataFrame, rows: DataFrame, text: str, seq: str) -> DataFrame:
        """(id) as if the rows of one batch came in order of id.

        A round looks at the first open row of each key (band keys, and the content): one that
        is first for all its keys conflicts with no open row before it, and is kept; what shares
        a key with it is compared with it, and goes if it is alike.  A key has one such row in a
        round, so a row is compared with few, however many copies there are.  Rows that share
        keys without being alike are decided one after the other that way; what is left of them
        after ``ROUNDS`` is decided by all its pairs.  A round meets rows that are open when it
        begins and no others, so it moves the texts of these alone.
        """
        texts, held = rows.select(F.col(seq).alias("id"), F.col(text).alias("_t")), None
        kept, open_ = [], cut_lineage(sketches)
        for _ in range(ROUNDS):
            named = F.concat(F.coalesce("keys", F.array().cast("array<long>")), F.array(F.xxhash64("content", F.lit(1))))
            each = open_.select("id", F.explode(named).alias("key"))
            led = each.join(each.groupBy("key").agg(F.min("id").alias("leader")), "key").select("id", "leader").distinct()
            led = cut_lineage(led)
            first = led.groupBy("id").agg(F.min("leader").alias("leader")).filter("id = leader").select("id")
            now = cut_lineage(open_.join(first, "id", "left_semi").select("id", "content", "member", "n"))
            kept.append(now.select("id"))
            told = now.select(F.col("id").alias("leader"), F.col("content").alias("c"), F.col("member").alias("o"), F.col("n").alias("m"))
            pairs = led.filter("id <> leader").join(told, "leader").join(open_.select("id", "content", "member", "n"), "id")
            room = (F.least("n", "m") > 0) & (F.least("n", "m") >= F.greatest("n", "m") * self.threshold - 1e-9)
            pairs = cut_lineage(pairs.withColumn("same", (F.col("content") == F.col("c")) | (F.col("member") == F.col("o"))).filter(F.col("same") | room).select("id", "leader", "same"))
            ask = pairs.filter("NOT same")
            wanted = ask.select(F.explode(F.array("id", "leader")).alias("id")).distinct()
            sets = cut_lineage(texts.join(wanted, "id").select("id", _set(F.col("_t"), self.size).alias("s")))
            met = ask.join(sets.withColumnRenamed("s", "x"), "id").join(sets.select(F.col("id").alias("leader"), F.col("s").alias("y")), "leader")
            gone = pairs.filter("same").select("id").unionByName(met.filter(_alike(self.threshold)).select("id"))
            left = cut_lineage(open_.join(now.select("id").unionByName(gone).distinct(), "id", "left_anti"))
            for done in (open_, led, pairs, sets):
                drop_checkpoint(done)
            open_ = left
            if not open_.isEmpty():
                texts = cut_lineage(texts.join(open_.select("id"), "id", "left_semi"))
            if held is not None:
                drop_checkpoint(held)
            if open_.isEmpty():
                return reduce(DataFrame.unionByName, kept)
            held = texts
        return reduce(DataFrame.unionByName, [*kept, self._by_pairs(open_, texts, "_t", "id")])

    def _by_pairs(self, sketches: DataFrame, rows: DataFrame, text: str, seq: str) -> DataFrame:
        """The same by all pairs that share a key.

        A row is kept once it is the first open one of its content and of its set and no open
        row before it has a similar set; what it shares a content or a similar set with, goes.
        """
        keys = keyed(sketches)
        right = keys.select("key", F.col("n").alias("m"), F.col("member").alias("other"))
        room = (F.col("member") < F.col("other")) & (F.least("n", "m") >= F.greatest("n", "m") * self.threshold - 1e-9)
        pairs = cut_lineage(keys.join(right, "key").filter(room).select("member", "other").distinct())
        both = F.explode(F.array("member", "other")).alias("member")
        sets = cut_lineage(self._sets(sketches, rows, text, seq, pairs.select(both)))
        met = pairs.join(sets.withColumnRenamed("s", "x"), "member").join(sets.select(F.col("member").alias("other"), F.col("s").alias("y")), "other")
        near = met.filter(_alike(self.threshold)).select("member", "other")
        edges = cut_lineage(near.unionByName(near.select(F.col("other").alias("member"), F.col("member").alias("other"))))
        drop_checkpoint(sets)
        open_ = sketches.select("id", "content", "member")
        kept = []
        while True:
            by_set = open_.groupBy("member").agg(F.min("id").alias("first"))
            by_content = open_.groupBy("content").agg(F.min("id").alias("led"))
            rivals = edges.join(by_set.withColumnRenamed("member", "other"), "other").groupBy("member").agg(F.min("first").alias("rival"))
            led = by_set.join(rivals, "member", "left").filter("rival IS NULL OR first < rival").select(F.col("first").alias("id"))
            now = cut_lineage(open_.join(led, "id", "left_semi").join(by_content, F.col("led") == F.col("id"), "left_semi").select("id", "content", "member"))
            kept.append(now.select("id"))
            near_now = edges.join(now.select("member"), "member", "left_semi").select(F.col("other").alias("member")).unionByName(now.select("member")).distinct()
            open_ = cut_lineage(open_.join(near_now, "member", "left_anti").join(now.select("content"), "content", "left_anti"))
            if open_.isEmpty():
                return reduce(DataFrame.unionByName, kept)

    # -- upkeep --------------------------------------------------------------

    def compact(self, epoch: str | None = None, batch: int = 0) -> None:
        """Merge the base and the versions beside it (with ``epoch``: those before that batch) into a new base, then drop what it replaces.

        A base counts once its last table is whole, so a failure leaves the old one in force.
        """
        base, beside = self._parts(epoch, batch)
        if not beside:
            return
        new = f"{1 + int(base.split('-')[0]) if base else 1:08d}-{uuid.uuid4().hex}"
        at = f"{self.folder}/base/{new}"
        keys = folders.read_versions(self.spark, f"{self.folder}/keys", KEYS, beside)
        keys = keys if base is None else keys.unionByName(self._base_keys(base))
        name = f"near_new_{uuid.uuid4().hex}"
        keys.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{at}/keys").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay: it is external
        self.spark.createDataFrame(sorted(self._in_base(base) | set(beside)), "epoch string, batch int").coalesce(1).write.parquet(f"{at}/versions")
        self.members(epoch, batch).write.parquet(f"{at}/members")
        for e, b in beside:
            for part in ("members", "keys"):
                folders.delete(self.spark, f"{self.folder}/{part}/epoch={e}/batch={b}")
        for old in folders.children(self.spark, f"{self.folder}/base"):
            if old < new:
                folders.delete(self.spark, f"{self.folder}/base/{old}")

    def reset(self) -> None:
        """Forget every row."""
        folders.delete(self.spark, self.folder)


def ingest_new(stream: DataFrame, target: str, index: NearIndex, checkpoint: str, text: str = "text", seq: str = "doc_id", every: int = 10) -> StreamingQuery:
    """Append the rows that the index admits, batch by batch; runs over what is there and stops.

    A batch that is repeated after a failure sees versions before it only, and replaces its
    own output and version.  Each ``every`` batches, those that have ended are compacted.
    """

    def write(batch: DataFrame, number: int) -> None:
        epoch = folders.epoch_of(batch)
        if number and number % every == 0:
            index.compact(epoch, number)
        rows = batch.persist()
        kept = index.admit(rows, text, seq, epoch, number)
        rows.join(kept, seq, "left_semi").write.mode("overwrite").parquet(f"{target}/epoch={epoch}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
