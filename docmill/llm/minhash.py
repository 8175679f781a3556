"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1.  Each text is read once, by an Arrow function, into the set of its shingles of ``words``
    words (as 64-bit hashes), a digest of that set, and band keys of a densified one-permutation
    sketch.  Texts with equal sets form a class at once; only one document of each class
    goes on.
2.  A bucket (band, key) links its members to its smallest document: a star, so a bucket
    of m members gives m - 1 candidate edges.
3.  Edges are confirmed on full sets, and confirmed edges give components.
4.  A star can miss a link between two members that both differ from the hub.  All members
    of stars with an unconfirmed edge between different components are compared once
    more, exactly: a prefix filter (rarest shingles first) proposes pairs of different
    components only, which are confirmed like the others.  So no link is lost for the
    shape of the candidates, and no bucket is expanded into pairs or capped.

With 30 bands of 5 a pair at the threshold of 0.8 shares no band with a probability of
7e-6.  Nulls and edge cases: a null or blank text has no shingles and links to nothing;
texts of fewer words than a shingle are one shingle; rows that share a doc_id are one document, similar to
what any of its texts is similar to; a
null doc_id is never linked and is kept, its component is null; other columns are
ignored; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table
from .tokens import WHITE_BYTES, distinct, hashed_words, mix, odd

WORDS = 4
BANDS, ROWS = 30, 5
#: Link if PERCENT[0] * intersection >= PERCENT[1] * union.
PERCENT = (100, 80)

_COMBINE, _BAND = odd(64), odd(256)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of UTF-8 ``data``: runs without ASCII white space, A-Z lower-cased."""
    return hashed_words(data.lower(), WHITE_BYTES)


def shingle_set(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words, or of the whole if there are fewer."""
    hashes = word_hashes(data or b"")
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, words)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _COMBINE[j]
    return distinct(mix(total))


_STARTS: dict[int, np.ndarray] = {}
_PROBES: dict[int, np.ndarray] = {}


def sketch(shingles: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation sketch: the least hash of each of ``bins`` equal ranges.

    Optimal densification: an empty bin takes the value of a bin drawn by a hash of its
    own number and the attempt, drawn again until that bin was not empty.
    """
    if bins not in _STARTS:
        _STARTS[bins] = np.array([(i << 64) // bins for i in range(bins)], np.uint64)
        _PROBES[bins] = (mix(np.arange(1, bins * 64 + 1, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64).reshape(64, bins)
    first = np.searchsorted(shingles, _STARTS[bins])
    full = np.diff(np.append(first, len(shingles))) > 0
    value = shingles[np.minimum(first, len(shingles) - 1)]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        drawn = _PROBES[bins][attempt, empty] if attempt < 64 else (mix(np.uint64(attempt) * np.uint64(bins) + empty.astype(np.uint64) + np.uint64(1)) % np.uint64(bins)).astype(np.int64)
        there = full[drawn]
        value[empty[there]] = value[drawn[there]]
        empty, attempt = empty[~there], attempt + 1
    return value


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    mixed = values.reshape(bands, rows) * _COMBINE[:rows]
    return mix(mixed.sum(axis=1, dtype=np.uint64) ^ _BAND[:bands]).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), pa.int64()))


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.int64)
    for batch in batches:
        sets = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                _lists([band_keys(sketch(s)) if len(s) else none for s in sets]),
            ],
            names=["doc_id", "n", "same", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists([shingle_set(x, words) for x in batch.column(1).to_pylist()])], names=["doc_id", "text_id", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each end of ``edges`` (a, b) the smallest vertex it can reach.

    Labels fall to the least label of a neighbour and then to the label of that label,
    until none changes; each round is cut off by a checkpoint.  Hubs are aggregated
    before they are shuffled.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).filter("v != w").distinct()
    both = shared_checkpoint(both)
    labels = shared_checkpoint(both.groupBy("v").agg(F.min("w").alias("c")).select("v", F.least("v", "c").alias("c")))
    while True:
        near = both.join(labels, "v").groupBy("w").agg(F.min("c").alias("c")).withColumnRenamed("w", "v")
        lower = labels.alias("l").join(near.alias("n"), "v").select("v", F.least("l.c", "n.c").alias("c"), F.col("l.c").alias("old"))
        tops = lower.select(F.col("v").alias("c"), F.col("c").alias("top"))
        new = shared_checkpoint(lower.join(tops, "c", "left").select("v", F.least("c", F.coalesce("top", "c")).alias("c"), "old"))
        if new.filter("c != old").isEmpty():
            return new.select("v", "c")
        labels = new.select("v", "c")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) with ok: whether their full sets are similar enough.

    The sets of b travel once for each pair; the set of a is copied to several salts, so
    that the pairs of a hub are met by many tasks.  A document of several texts has
    several sets; any two that are similar enough confirm a pair.
    """
    salts = 16
    b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").withColumn("salt", F.pmod(F.hash("b"), F.lit(salts)))
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    copies = F.when(F.col("m") > 100, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).join(hubs, "a").withColumn("salt", F.explode(copies)).drop("m")
    b = b.join(hubs, "a").withColumn("salt", F.when(F.col("m") > 100, F.col("salt")).otherwise(-1)).drop("m")
    both = F.size(F.array_intersect("x", "y"))
    judged = b.join(a, ["a", "salt"]).select("a", "b", (F.lit(percent[0]) * both >= F.lit(percent[1]) * (F.size("x") + F.size("y") - both)).alias("ok"))
    return judged.groupBy("a", "b").agg(F.max("ok").alias("ok"))


def _missed(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components, among the members of stars with a cross edge that failed, that may be similar enough."""
    label = lambda side: labels.select(F.col("v").alias(side), F.col("c").alias(f"c_{side}"))
    tagged = stars.join(label("a"), "a", "left").join(label("b"), "b", "left").withColumns({f"c_{x}": F.coalesce(f"c_{x}", x) for x in "ab"})
    hubs = tagged.filter(~F.col("ok") & (F.col("c_a") != F.col("c_b"))).select("a").distinct()
    among = tagged.join(hubs, "a", "left_semi")
    among = among.select(F.col("a").alias("doc_id"), F.col("c_a").alias("c")).union(among.select("b", "c_b")).distinct()
    rows = among.join(sets, "doc_id").select("doc_id", "text_id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    least = F.ceil(F.col("n") * percent[1] / percent[0]).cast("int")
    # Shingles of one document only come first in the order, take up the prefix, and match nothing.
    shared = rows.join(common, "s").groupBy("doc_id", "text_id", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("known"))
    room = F.col("n") - least + 1 - (F.col("n") - F.size("known"))
    prefix = shared.filter(room > 0).select("doc_id", "c", "n", (F.col("n") - F.size("known")).alias("before"), F.posexplode(F.slice("known", F.lit(1), room)).alias("i", "k"))
    # rest: shingles from this one on.  If it is the first that a pair shares, they share no more than that.
    prefix = shared_checkpoint(prefix.select("doc_id", "c", "n", (F.col("n") - F.col("before") - F.col("i")).alias("rest"), "k.s"))
    # In each group only documents outside its commonest component look for partners.
    main = prefix.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    groups = prefix.join(main, "s")
    minor = groups.filter("c != main").select("s", F.col("doc_id").alias("p"), F.col("c").alias("cp"), F.col("n").alias("np"), F.col("rest").alias("rp"))
    near = (F.lit(percent[0]) * F.least("n", "np") >= F.lit(percent[1]) * F.greatest("n", "np")) & (F.col("c") != F.col("cp"))
    near &= F.lit(sum(percent)) * F.least("rest", "rp") >= F.lit(percent[1]) * (F.col("n") + F.col("np"))
    pairs = minor.join(groups, "s").filter(near)
    return pairs.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: tuple[int, int] = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, same (digest of the shingle set), component_id, kept."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    sketched = shared_checkpoint(ids.mapInArrow(lambda batches: _sketches(batches, words), "doc_id long, n long, same string, bands array<long>"))
    usable = sketched.filter(F.col("doc_id").isNotNull() & F.col("same").isNotNull())
    classes = usable.groupBy("same").agg(F.min("doc_id").alias("rep"))
    class_edges = usable.join(classes, "same").filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = usable.groupBy("same").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("r.doc_id", "r.bands")
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a != z").select("key", "a")
    stars = shared_checkpoint(banded.join(hubs, "key").filter("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct())
    involved = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    sets = ids.join(involved, "doc_id", "left_semi").withColumn("text_id", F.xxhash64("data")).dropDuplicates(["doc_id", "text_id"]).mapInArrow(lambda batches: _sets(batches, words), "doc_id long, text_id long, shingles array<long>")
    sets = shared_checkpoint(sets)
    stars = shared_checkpoint(_confirmed(stars, sets, percent))
    links = stars.filter("ok").select("a", "b")
    first = components(links)
    more = shared_checkpoint(_missed(stars, first, sets, percent))
    if not more.isEmpty():
        links = links.union(_confirmed(more, sets, percent).filter("ok").select("a", "b"))
        first = components(shared_checkpoint(first.select(F.col("c").alias("a"), F.col("v").alias("b")).union(links)))
    # A class follows its representative; a document of several rows ties their classes together.
    linked = first.select(F.col("c").alias("a"), F.col("v").alias("b"))
    tied = usable.groupBy("doc_id").agg(F.countDistinct("same").alias("k")).filter("k > 1").select("doc_id")
    if not tied.isEmpty():
        linked = components(shared_checkpoint(linked.union(class_edges))).select(F.col("c").alias("a"), F.col("v").alias("b"))
    by_rep = classes.join(linked.select(F.col("b").alias("rep"), "a"), "rep", "left").select("same", F.coalesce("a", "rep").alias("c"))
    out = sketched.join(by_rep, "same", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "same", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: tuple[int, int] = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component; all columns stay."""
    gone = near_duplicates(docs, percent, words).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v WHERE r.c < u.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""
