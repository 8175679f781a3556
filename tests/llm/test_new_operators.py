"""Clustering, sharding and whitening against plain Python and numpy, and awkward rows."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import clustering, sharding, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x string, component string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "c", None, "y") for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, size):
    """Each vector against each centroid, in whole numbers of Python."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    cents = [v for *_, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(cents)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], cents


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("spread", [0.2, 3.0, 40.0])
def test_clusters_equal_lloyd(spark, spread, monkeypatch):
    """Far groups go down as whole balls, near ones as leaves; both give what comparing all pairs gives."""
    rng = random.Random(5)
    rows = [(n, [rng.gauss(spread * ((n + j) % 7 == 0), 0.3) for j in range(6)]) for n in range(900)]
    rows += [(n, rows[n % 5][1]) for n in range(900, 1000)]  # repeated vectors tie everywhere
    found, cents = clustering.cluster_vectors(vectors(spark, rows), k=9, rounds=4, size=6)
    want, want_cents = lloyd(rows, 9, 4, 6)
    assert sorted(map(tuple, found.collect())) == sorted(want) and cents == want_cents


def test_whole_balls_are_assigned():
    """Without a ball that goes to one centroid as a whole, the tree would be for nothing."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-5, 5, (500, 4)), rng.integers(-5, 5, (500, 4)) + 1000])
    tree = clustering.build_tree(x)
    x = x[tree.pop("order")]
    steps = list(clustering.walk(tree, x, np.array([[0] * 4, [1000] * 4, [1000, 1000, 1000, 1003]])))
    assert any(node >= 0 and end - start >= 400 for start, end, _, node in steps)
    assert sum(end - start for start, end, *_ in steps) == 1000


def test_clusters_of_awkward_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, good), (1, good), (None, [3.0, 3.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [NAN, 1.0]), (7, [1.0, INF]), (8, [-3.0, 0.0])]
    found, cents = clustering.cluster_vectors(vectors(spark, rows), k=3, rounds=2, size=2)
    want, want_cents = lloyd(rows, 3, 2, 2)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and cents == want_cents
    full = clustering.with_inertia(found, cents).collect()
    assert {r.inertia for r in full} == {sum(d for *_, d in want)} and len(full) == 4
    empty = clustering.with_inertia(*clustering.cluster_vectors(vectors(spark, rows).limit(0), k=3, size=2))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_vectors_too_large_for_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster_vectors(vectors(spark, [(1, [3e7, 0.0])]), k=1, size=2)[0].collect()


def test_empty_clusters_keep_their_centroid(spark):
    rows = [(n, [1.0, 1.0]) for n in range(5)]
    found, cents = clustering.cluster_vectors(vectors(spark, rows), k=4, rounds=2, size=2)
    assert cents == [[64, 64]] * 4 and {r.cluster for r in found.collect()} == {0}


def check_whitening(rows, x, k):
    """Against the eigenvectors of the covariance, up to their sign."""
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert len(rows) == len(x) * k
    for i, v in x:
        want = (v - sums / n) @ u / np.sqrt(e)
        mine = np.array([got[i][c].whitened for c in range(1, k + 1)])
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-7)
        assert got[i][1].deviation == sum(int(n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) and got[i][1].n == n
    assert np.allclose([got[x[0][0]][c].explained for c in range(1, k + 1)], e / (centred**2).sum() * n, rtol=1e-9)
    assert max(r.identity_error for r in rows) < 1e-9


def scaled(v):
    return np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000


def test_whitening_equals_eigenvectors(spark):
    """80 dimensions, so the span of 32 directions a block restarts or grows; a third of the rows are one vector."""
    rng = np.random.default_rng(2)
    rows = [(n, [float(x) for x in rng.normal(size=80) * np.linspace(0.2, 2, 80)]) for n in range(400)]
    rows += [(n, rows[0][1]) for n in range(400, 600)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    check_whitening(found, [(i, scaled(v)) for i, v in rows], 16)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = [(r.vec_id, scaled(r.embedding)) for r in table.collect()]
    check_whitening(whitening.op13_whitening(spark, SF).collect(), x, 16)


@pytest.mark.parametrize(("size", "k"), [(300, 5), (40, 40), (120, 16)])
def test_leading_eigenpairs(size, k):
    """The span restarts where the space is larger than it; close eigenvalues and all of them are found too."""
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.normal(size=(size, size)))[0]
    e = np.sort(rng.uniform(1, 1.5, size))[::-1] * np.r_[np.linspace(3, 2, k), np.ones(size - k)]
    e = np.sort(e)[::-1]
    v = (q * e) @ q.T
    widest = []

    def apply(block):
        widest.append(block.shape[1])
        return v @ block

    values, vectors_ = whitening.leading(apply, size, k)
    assert np.allclose(values, e[:k], rtol=1e-11) and max(widest) <= k + whitening.MORE
    assert np.linalg.norm(v @ vectors_ - vectors_ * values, axis=0).max() <= 1e-11 * e[0]


def test_whitening_of_awkward_rows(spark):
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (None, [1.5, -1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None, 0.0]), (6, [NAN] * 3), (7, [INF] * 3)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    # Two distinct vectors vary along one line: one component, at plus and minus one.
    assert sorted((r.vec_id is None, r.component, round(abs(r.whitened), 9), r.n) for r in found) == [(False, 1, 1.0, 2), (False, 1, 1.0, 2), (True, 1, 1.0, 2)]
    assert {round(r.explained, 9) for r in found} == {1.0}
    one = whitening.whiten(vectors(spark, rows[:2]))
    none = whitening.whiten(vectors(spark, rows).limit(0))
    assert one.collect() == [] and none.collect() == [] and one.columns == none.columns


DOCS = "doc_id long, text string, shard string, slot string, size string, key string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", None, "z", None, "n") for i, t in rows], DOCS)


def one_by_one(texts, shards):
    """Loads when each group is dealt on its own."""
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [(0, s) for s in range(shards)]
    for size in sorted(groups.values(), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def check_shards(rows, found, shards):
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in found)) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, loads = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sorted(loads[s] for s in range(shards))


def test_shards_are_about_as_even_as_one_by_one(spark):
    rng = random.Random(7)
    rows = [(n, "".join(rng.choices("abcdé ", k=int(rng.paretovariate(0.7)) % 3000))) for n in range(1500)]
    rows += [(n, "the hot text, which a third of all rows hold") for n in range(1500, 2200)]
    found = sharding.balanced_shards(documents(spark, rows), 8).collect()
    loads, want = check_shards(rows, found, 8), one_by_one([t for _, t in rows], 8)
    assert all(abs(a - b) <= 0.0005 * sum(loads) for a, b in zip(loads, want, strict=True))
    shards = defaultdict(set)
    texts = dict(rows)
    for r in found:
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_shards_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "x"), (3, "x"), (3, "other"), (4, "é" * 70000)]
    found = sharding.balanced_shards(documents(spark, rows), 3).collect()
    check_shards(rows, found, 3)
    at = defaultdict(set)
    for r in found:
        at[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in at.values())
    assert sharding.balanced_shards(documents(spark, rows).limit(0), 3).collect() == []


def test_bundles_are_few_and_hold_every_byte():
    """The number of bundles follows the logarithm of the bytes, not the number of groups."""
    total, start, bundles = 10**12, 0, set()
    while start < total:
        bundles.add(int(np.floor(sharding.FINE * 16 * np.log(total / (total - start)))))
        start += max(1, (total - start) // 5000)
    assert len(bundles) <= 1 + sharding.FINE * 16 * np.log(total)


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(n, f"text {n % 40} " * 20) for n in range(100)] + [(None, None)]
    docs = documents(spark, rows)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted(docs.columns)
    assert sorted(map(str, (tuple(r) for r in back.drop("shard").select(*sorted(docs.drop("shard").columns)).collect()))) == sorted(map(str, (tuple(r) for r in docs.drop("shard").select(*sorted(docs.drop("shard").columns)).collect())))
    assert back.groupBy("text").agg({"shard": "max"}).count() == 41 and back.select("text", "shard").distinct().count() == 41
