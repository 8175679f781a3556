"""The near-duplicate index over runs: halves, reload, reset, replay, compaction; delay machines as streams."""

import random
import time

import pytest

from docmill.streaming import folders, incremental, index, machines, throttle


def near_texts(seed, n):
    """Texts in families of near copies, exact copies, equal heads, and short and blank ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            out.append(" ".join(copy))
    head = "h" * 2000
    out += [head + " a b c", head + " d e f g", "one two", "one two", "  ", "  ", "", "", None, "one"]
    rng.shuffle(out)
    return out


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)}


def loop(texts, threshold=0.85):
    """Row by row, each against all that were kept."""
    kept, sets, contents = [], [], set()
    for i, t in enumerate(texts):
        if t:
            s = shingles(t) if t.split() else set()
            if t[:2000] in contents or any(len(s & o) >= threshold * len(s | o) for o in sets if s and o):
                continue
            contents.add(t[:2000])
            sets.append(s)
        kept.append(i)
    return kept


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t) for i, t in enumerate(texts)], "doc_id long, text string")


def opened(spark, folder):
    return index.NearIndex(spark, folder, buckets=3)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_halves_equal_the_whole(spark, tmp_path):
    texts = near_texts(1, 30)
    half = len(texts) // 2
    whole = opened(spark, f"{tmp_path}/whole").admit(frame(spark, texts), "text", "doc_id")
    first = opened(spark, f"{tmp_path}/parts").admit(frame(spark, texts[:half]), "text", "doc_id")
    again = opened(spark, f"{tmp_path}/parts")  # a new object knows what is on disk
    again.compact()
    second = again.admit(frame(spark, texts[half:], half), "text", "doc_id")
    assert ids(whole) == loop(texts) == sorted(ids(first) + ids(second))


def test_rounds_by_leaders_and_by_pairs_agree(spark, tmp_path, monkeypatch):
    """A group of many near copies, and texts that share keys without being alike."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = near_texts(6, 5)
    for k in range(40):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy[rng.randrange(80)] = f"y{rng.randrange(999)}"
        texts.append(" ".join(copy))
    leaders = opened(spark, f"{tmp_path}/a").admit(frame(spark, texts), "text", "doc_id")
    assert ids(leaders) == loop(texts)
    monkeypatch.setattr(index, "ROUNDS", 1)
    assert ids(opened(spark, f"{tmp_path}/b").admit(frame(spark, texts), "text", "doc_id")) == loop(texts)


def test_a_batch_reads_its_texts_once_however_many_rounds_it_takes(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    texts = [" ".join(words[i * 5 : i * 5 + 100]) for i in range(40)] + ["", None]  # each near the one before it, and not to those before that
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    rows = frame(spark, texts).mapInPandas(counted, "doc_id long, text string")
    kept = opened(spark, f"{tmp_path}/i").admit(rows, "text", "doc_id")
    assert read.value == len(texts)
    assert ids(kept) == loop(texts) and 10 < len(loop(texts)) < 40


def test_compaction_changes_nothing_and_can_be_repeated(spark, tmp_path):
    texts = near_texts(2, 9)
    one = opened(spark, f"{tmp_path}/i")
    kept = []
    for k in range(3):
        kept += ids(one.admit(frame(spark, texts[k * 8 : k * 8 + 8], k * 8), "text", "doc_id"))
        one.compact()
        one.compact()
    assert kept == [i for i in loop(texts[:24]) if i < 24]
    assert one.members().count() == len([i for i in kept if texts[i]]) and not folders.versions(spark, f"{tmp_path}/i/members")
    assert len(folders.children(spark, f"{tmp_path}/i/base")) == 1
    one.reset()
    assert ids(one.admit(frame(spark, texts[:8]), "text", "doc_id")) == loop(texts[:8])


def test_a_base_without_its_last_table_does_not_count(spark, tmp_path):
    texts = near_texts(3, 5)
    one = opened(spark, f"{tmp_path}/i")
    kept = ids(one.admit(frame(spark, texts), "text", "doc_id"))
    spark.createDataFrame([("none", 0)], "epoch string, batch int").write.parquet(f"{tmp_path}/i/base/00000001-half/versions")
    assert ids(one.admit(frame(spark, texts), "text", "doc_id")) == [i for i in kept if not texts[i]]


def test_a_version_that_is_repeated_does_not_see_itself(spark, tmp_path):
    texts = near_texts(4, 6)
    one = opened(spark, f"{tmp_path}/i")
    first = ids(one.admit(frame(spark, texts), "text", "doc_id", "q", 0))
    assert ids(one.admit(frame(spark, texts), "text", "doc_id", "q", 0)) == first
    one.compact("q", 0)  # batch 0 has not ended for itself
    assert ids(one.admit(frame(spark, texts), "text", "doc_id", "q", 0)) == first


def land(spark, folder, texts, start):
    frame(spark, texts, start).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_of_runs_equals_the_loop(spark, tmp_path):
    texts = near_texts(5, 12)
    cut = len(texts) // 3
    for k in range(3):
        part = texts[k * cut : (k + 1) * cut] if k < 2 else texts[2 * cut :]
        land(spark, f"{tmp_path}/in", part, k * cut)
        # Each run opens the index anew; the second one has a fresh checkpoint, so it reads all again and finds it known.
        checkpoint = f"{tmp_path}/c{0 if k < 2 else 1}"
        index.ingest_new(read(spark, f"{tmp_path}/in"), f"{tmp_path}/out", opened(spark, f"{tmp_path}/i"), checkpoint, every=1).awaitTermination()
    out = spark.read.schema("doc_id long, text string").parquet(f"{tmp_path}/out/epoch=*/batch=*")
    kept = loop(texts)
    assert ids(out.filter("text <> ''")) == [i for i in kept if texts[i]]
    assert out.select("doc_id").distinct().count() == len(kept)


def test_a_fresh_checkpoint_hides_and_overwrites_nothing(spark, tmp_path):
    docs = lambda *i: spark.createDataFrame([(x, f"text {x}") for x in i], "doc_id long, text string").coalesce(1)
    run = lambda where: incremental.ingest(spark, read(spark, f"{tmp_path}/{where}"), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/c").awaitTermination()
    docs(1, 2, 3).write.parquet(f"{tmp_path}/a")
    run("a")
    incremental.forget(spark, f"{tmp_path}/c")
    docs(3, 5).write.parquet(f"{tmp_path}/b")
    run("b")  # the old input is gone, what it gave is not
    assert ids(incremental.read_ingested(spark, f"{tmp_path}/out", "doc_id long, text string")) == [1, 2, 3, 5]
    incremental.forget(spark, f"{tmp_path}/c", f"{tmp_path}/state")
    run("b")
    assert ids(incremental.read_ingested(spark, f"{tmp_path}/out", "doc_id long, text string")) == [1, 2, 3, 3, 5, 5]


LOG = "domain string, seq long, status int, retry_after double"


def fetches(seed, n):
    rng = random.Random(seed)
    return [(f"d{rng.randrange(6)}", i, rng.choice([200, 301, 429, 403, 401, 404, 500, 503, None]), rng.choice([None, None, 15.0, 45.0])) for i in range(n)]


@pytest.mark.parametrize(("machine", "fold"), [("async", throttle.fold_delays), ("sync", throttle.fold_sync_delays)])
def test_delays_as_a_stream_equal_the_fold(spark, tmp_path, machine, fold):
    machines.state_store(spark)
    rows, state = fetches(7, 120), {}
    for k in range(3):  # each part is a run that starts from the checkpoint of the one before
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def write(batch, _):
            state.update({r.domain: (r.delay, r.n) for r in batch.collect()})

        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        machines.stream_delays(log, machine).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = {r.domain: (pytest.approx(r.delay), r.n) for r in fold(spark.createDataFrame(rows, LOG)).collect()}
    assert state == want


def test_cooldowns_as_a_stream_equal_the_windows(spark, tmp_path):
    machines.state_store(spark)
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(4)}", i, rng.random() < 0.5, rng.choice([0, 0, 3])) for i in range(90)]
    schema = "key string, seq long, limited boolean, results int"
    for k in range(2):
        spark.createDataFrame(rows[k * 45 : k * 45 + 45], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    machines.stream_cooldowns(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    want = {(r.seq, r.cooldown) for r in throttle.cooldowns(spark.createDataFrame(rows, schema), "key", "seq").collect()}
    assert {(r.seq, r.cooldown) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_an_idle_domain_is_forgotten(spark, tmp_path):
    machines.state_store(spark)
    seen = []
    spark.createDataFrame([("d", 1, 429, None)], LOG).coalesce(1).write.parquet(f"{tmp_path}/in")
    log = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")
    query = machines.stream_delays(log, idle=1).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend((r.delay, r.n) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert seen[:2] == [(2.0, 1), (0.0, 0)]
