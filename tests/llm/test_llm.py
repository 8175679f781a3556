"""The training-data operators: brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import chat, decontamination, html_text, media, minhash, mixing, quality, secrets, substrings, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, size long"
LONG = " ".join(f"word{i}" for i in range(30000))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, LONG), (7, LONG + " tail"), (8, "Ünï©ode 😀 " * 40)]
    return spark.createDataFrame([(i, t, None, None if i in (1, 8) else "s", None, "x", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_awkward_rows_keep_their_number(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "?!")], "item_id long, text string")
    for f in (minhash.near_duplicates, substrings.remove_repeats, secrets.find_secrets, secrets.redact, mixing.mix_sources, lambda d: decontamination.find_contamination(d, bench), lambda d: media.chunk_lists(d)):
        assert f(awkward).count() == 10
        assert f(nothing).count() == 0


def test_near_duplicates_of_awkward_rows(awkward):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(awkward).collect()), key=str)
    assert (1, 0, 1, True) in found and (3, 0, 3, True) in found and (None, 1, None, True) in found
    assert found.count((5, 1, 4, False)) == 2 and (7, 29998, 6, False) in found


def test_near_duplicates_lose_no_link_for_the_star(spark):
    """b links a and c; a and c are too far apart to link, whatever the hub."""
    base = [f"w{i}" for i in range(200)]
    edit = lambda ws, at: [*ws[:at], "changed", *ws[at + 1 :]]
    b = edit(edit(base, 20), 40)
    c = b
    for at in (60, 80, 100, 120, 140):
        c = edit(c, at)
    rows = [(1, base), (2, b), (3, c)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in rows}
    links = {(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {1} and (1, 3) not in links


def test_removed_bytes_equal_brute_force(spark):
    docs, seen = texts(spark), set()
    found = {r.doc_id: r for r in substrings.op4_substrings(spark, SF).collect()}
    for i in sorted(docs):
        t = docs[i].encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            key = hashlib.blake2b(t[p : p + 100], digest_size=12).digest()
            if key in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(key)
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_secrets_equal_brute_force_and_link(spark):
    rx = {"assign": re.compile(secrets.ASSIGN, re.A), "access": re.compile(secrets.ACCESS), "hex": re.compile(secrets.HEX)}
    for r, t in ((r, texts(spark)[r.doc_id]) for r in secrets.find_secrets(spark.read.parquet(f"{SF}/documents.parquet")).collect()):
        for kind, p in rx.items():
            assert [tuple(x) for x in r[kind]] == [m.span() for m in p.finditer(t) if kind != "assign" or len(m[2]) >= 6]
    weak = "0123456789abcdef0"
    rows = [(1, f"user=bob at https://h.example key {weak}"), (2, f"only {weak} here"), (3, f"AKIA{'A' * 16} {'. ' * 300} {weak}"), (4, "token=abc token=abcdef")]
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[1].linked) == 1 and not found[2].linked and not found[3].linked
    assert [tuple(x) for x in found[4].assign] == [(10, 22)]
    cleared = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert weak not in cleared[1] and cleared[2] == rows[1][1] and cleared[4] == "token=abc [SECRET]"


def test_contamination(spark):
    bench = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(12))), (2, "Hello"), (10, None)], "item_id long, text string")
    rows = [(1, "x " + ", ".join(f"T{i}" for i in range(11)) + " y"), (2, "say hello, HELLO"), (3, "t0 t1 t2"), (4, None)]
    found = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {1: (13, 11, ["1"]), 2: (3, 2, ["2"]), 3: (3, 0, []), 4: (0, 0, [])}
    assert [r.doc_id for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).orderBy("doc_id").collect()] == [3, 4]


def test_mix(spark):
    rows = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    again = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sizes: dict = {}
    for r in rows:
        assert r.taken <= 3 * r.size
        sizes.setdefault(r.source, []).append(r)
    names, total = sorted(sizes), sum(r.size for r in rows)
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    own, target, open_ = {s: sum(r.size for r in sizes[s]) for s in names}, {}, set(names)
    while True:
        level = (total - sum(3 * own[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * own[s]}
        if not over:
            break
        open_ -= over
    for s in names:
        target = weight[s] * level if s in open_ else 3.0 * own[s]
        assert abs(sizes[s][0].target - target) < 1e-6 * max(1, target)
        assert abs(sum(r.taken for r in sizes[s]) - target) <= max(r.size for r in sizes[s])


def test_chat_round_trip():
    for text in ("plain", "", chat.PLANTED, "<|end|>", "\\<|turn|>\\", "a\\", "<|te", *chat.CONTROL):
        out = chat.render("user", text)
        assert [t[:2] for t in chat.parse(out)] == [("user", text)]
    assert chat.render("user", "a\\b").startswith(chat.TURN) and chat.render("user", chat.PLANTED).startswith(chat.ESCAPED)


def test_html():
    page = '<nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two<aside>Ad</aside><p>x &lt; y<script>if (a < b) "</p>"</script></article><section class="comments"><p>First</p></section>'
    assert html_text.main_text(page) == "A & B\nOne two\nx < y"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article><p>cut of") == "cut of" and html_text.main_text("<article><p>cut<di") == "cut"


def test_html_of_other_layouts(spark):
    """Optional end tags, names of wrappers and topics, stray quotes; and rows that are null, empty or repeated."""
    body = "<p>The sea came up the wall on Monday.</p><p>Nobody had seen it so high.</p>"
    text = "The sea came up the wall on Monday.\nNobody had seen it so high."
    assert html_text.main_text(f"<html><head><title>T</title><body><article>{body}</article></body></html>") == text
    assert html_text.main_text(f'<html><body class="has-sidebar"><article>{body}</article></body></html>') == text
    assert html_text.main_text(f'<div class="layout-with-sidebar"><main>{body}</main></div>') == text
    assert html_text.main_text(f'<article class="post tags-news social">{body}</article>') == text
    assert html_text.main_text('<article><p>Alpha <a title="x>beta gamma</p></article>') in ("Alpha beta gamma", "Alpha")
    rows = [(1, "u", f"<article>{body}</article>", 1), (1, "u", f"<article>{body}</article>", 2), (None, None, None, 3), (2, "v", "", 4), (3, "w", "<p>" * 50_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=str)
    assert found == sorted([(1, text), (1, text), (None, ""), (2, ""), (3, "")], key=str)


def test_linked_spans_equal_brute_force(spark):
    """Every weak candidate with an identifier and an endpoint within the scope, and no other; passwords in addresses among them."""
    rng = random.Random(12)
    parts = ["user=bob", "login: anna", "https://h.example/x", "host=db1", "0123456789abcdef0", "pwd=hunter22", "postgres://bob:hunter22secret@db.example", "AKIA" + "B" * 16, "token=abcdefgh", "words and words " * 6]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(120)] + ["postgres://bob:hunter22secret@db.example", "", None, "pwd=hunter22 " * 300 + "user=bob"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = {r.doc_id: r for r in secrets.scan(df).collect()}
    hits = 0
    for r in secrets.find_secrets(df).collect():
        s, near = scanned[r.doc_id], lambda w, ps: any(p.s <= w.e + secrets.SCOPE and p.e >= w.s - secrets.SCOPE for p in ps)
        expected = sorted({(w.s, w.e) for w in s.weak if near(w, s.identifiers) and near(w, s.endpoints)})
        assert [tuple(x) for x in r.linked] == expected
        hits += len(expected)
    assert hits > 50 and [(w.s, w.e) for w in scanned[120].weak] == [(15, 29)]


def test_media(spark):
    told = texts(spark)
    for r in media.op8_media(spark, SF).collect():
        t = told[r.doc_id].encode()
        whole = t + bytes(-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.to_media(t)[0]), hashlib.sha256(media.to_media(t)[0]).hexdigest())
    raw = bytes(range(256)) * 2000
    assert b"".join(media.chunks(raw)) == raw and max(map(len, media.chunks(raw))) <= media.MOST
    df = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (4, LONG)], "doc_id long, text string")
    lists = media.chunk_lists(df)
    found = {r.doc_id: r for r in lists.join(media.read_media(lists, media.chunk_store(df)), "file").collect()}
    assert found[1].payload_sha256 == found[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    whole = LONG.encode() + bytes(-len(LONG) % 64)
    assert found[3].payload_sha256 == found[4].payload_sha256 == hashlib.sha256(whole).hexdigest() and found[3].tail_crc32 == zlib.crc32(whole[-64:])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_classifiers_without_labels(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(awkward, quality.fit(awkward, labels, F.lit(True))).filter("score = 0.5").count() == 10
    assert toxicity.score(awkward, toxicity.fit(awkward, labels, F.lit(True))).filter("score = 0").count() == 10


def counts_by_brute_force(texts, stem):
    """Of (text, y): texts of each class by bigram, words before each word, words of each stem."""
    pairs: dict = {}
    for t, y in dict.fromkeys(texts):
        w = t.split()
        for pair in set(zip(w, w[1:])):
            pairs.setdefault(pair, [0, 0])[y] += 1
    before = {w: [sum(n[y] > 0 for (_, x), n in pairs.items() if x == w) for y in (0, 1)] for w in {x for _, x in pairs}}
    stems: dict = {}
    for w, n in before.items():
        one = stems.setdefault(w[:stem], [0, 0, 0])
        one[0], one[1], one[2] = one[0] + n[0], one[1] + n[1], one[2] + 1
    return pairs, before, stems


def test_toxicity_equals_brute_force(spark):
    """One toxic text in ten, copies among them, all folds but the calibration's: counts and evidence equal plain Python, gram by gram."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"ctx{rng.randrange(9)}x{j} rare{i} pair{i % 7} common" for j in range(3)), int(i % 10 == 0)) for i in range(150)]
    rows += [(500 + i, *rows[i][1:]) for i in range(0, 100, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    counted = {r.doc_id for r in df.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(toxicity.CALIBRATE)) != 0).collect()}
    pairs, before, stems = counts_by_brute_force([(t, y) for i, t, y in rows if i in counted], toxicity.STEM)
    table = {r.gram: r for r in model["table"].collect()}
    key = lambda t, k: int(toxicity.grams(t.encode())[k].astype("int64")[0])
    assert len(table) == model["table"].count() and sum(n[0] >= 2 for n in pairs.values()) > 20
    for (p, w), n in pairs.items():
        got = table.get(key(f"{p} {w}", 2))
        assert (got is None and max(n) < 2) or (got.a0, got.a1) == tuple(n)
    for w, n in before.items():
        got = table.get(key(w, 0))
        assert (got is None and max(n) < 2) or (got.a0, got.a1) == tuple(n)
    # The evidence of new texts, by the formulas alone.
    D, total = toxicity.DISCOUNT, [sum(n[y] for n in before.values()) for y in (0, 1)]
    over = lambda n: max(n - D, 0.0)
    types = sum(n[2] for n in stems.values()) + 0.5 * (len(stems) + 1)
    back_stem = [1 - sum(over(n[y]) for n in stems.values()) / total[y] for y in (0, 1)]
    back_word = [1 - sum(over(n[y]) for n in before.values()) / total[y] for y in (0, 1)]

    def chances(w, y):
        s = stems.get(w[: toxicity.STEM], (0, 0, 0))
        shared, within = (s[2] + 0.5) / types, 1 / (s[2] + 1)
        by_stem = over(s[y]) / total[y] + back_stem[y] * shared
        word = over(before.get(w, (0, 0))[y]) / total[y] + back_word[y] * by_stem * within
        return word, word + shared * within

    def top(p, w, y):
        follow = [n[y] for (x, _), n in pairs.items() if x == p]
        n = sum(follow) if any(over(m) for q in (0, 1) for m in [n[q] for (x, _), n in pairs.items() if x == p]) else 0
        rest = 1 - sum(map(over, follow)) / max(n, 1) if sum(map(over, follow)) else 1.0
        return over(pairs.get((p, w), (0, 0))[y]) / max(n, 1) + rest * chances(w, y)[0]

    asked = ["common pair3 common", "rare20 pair6 common ctx1x0 rare20", "never seen words", "pair0"]
    found = {r.doc_id: r for r in toxicity.evidence_of(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, ("doc_id",)).collect()}
    for i, t in enumerate(asked):
        w = t.split()
        ratio = [math.log(chances(x, 1)[1] / chances(x, 0)[1]) for x in w]
        whole = [math.log(chances(w[0], 1)[0] / chances(w[0], 0)[0])] + [math.log(top(p, x, 1) / top(p, x, 0)) for p, x in zip(w, w[1:])]
        run = max(sum(ratio[k : k + toxicity.RUN]) for k in range(max(1, len(w) - toxicity.RUN + 1)))
        assert found[i].top == pytest.approx(max(ratio)) and found[i].run == pytest.approx(run) and found[i].mean == pytest.approx(sum(whole) / len(whole)), t


def test_classifiers_on_awkward_rows_and_clashing_names(spark, awkward, nothing):
    """Null, empty and wordless texts score alike, so do equal texts; columns called score, _data and _block change nothing."""
    rows = [(i, f"good word{i % 5} text of sense number{i}" if i % 2 else f"bad junk{i % 3} !!! noise{i}", i % 2, 1 - i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")
    named = awkward.withColumns({"score": F.lit("x"), "_data": F.lit("y"), "_block": F.lit(1), "y": F.lit(2), "_id": F.lit(3)})
    for op in (quality, toxicity):
        model = op.fit(docs, labels, F.lit(True))
        found = [(r.doc_id, r.score) for r in op.score(named, model, tuple(named.columns)).collect()]
        score = dict(found)
        assert len(found) == 10 and all(0 <= x <= 1 for x in score.values()) and score[1] == score[2]
        assert score[4] == score[5] == score[None] and op.score(nothing, model).count() == 0
    kept = quality.keep_good(named, labels, F.lit(True), 0.0)
    assert kept.columns == named.columns and kept.count() == 10


def test_near_duplicate_stage_takes_five_words(spark):
    """Similar by four words but not by five: both stay in the stage; brute force over the components of five."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k, edits in enumerate(([], [20, 60, 100, 140, 180], [30], [40, 80, 120, 150, 170, 190])):
        rows.append((k + 1, " ".join("changed" + str(k) if i in edits else w for i, w in enumerate(base))))
    rows += [(9, rows[0][1]), (10, None), (None, rows[0][1])]
    sets = {n: {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in rows if i and t for w in [t.split()]} for n in (4, 5)}
    similar = lambda n, x, y: 100 * len(sets[n][x] & sets[n][y]) >= 80 * len(sets[n][x] | sets[n][y])
    assert similar(4, 1, 2) and not similar(5, 1, 2)
    reached = {i: i for i in sets[5]}
    for _ in reached:
        for x in reached:
            for y in reached:
                if similar(5, x, y):
                    reached[x] = reached[y] = min(reached[x], reached[y])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()}
    assert kept == {i for i, c in reached.items() if i == c} | {10, None} and 2 in kept
    assert 2 not in {r.doc_id for r in minhash.drop_near_duplicates(df).collect()}


def test_quality_stage_keeps_what_scores_as_good(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.op2_quality(spark, SF).collect() if r.score >= quality.THRESHOLD}
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == good and 0 < len(good) < docs.count()


def test_pipeline_runs_its_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    found = corpus_pipeline.run(spark, SF, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str) and found.count()


def test_quality_sees_the_end_of_a_long_text():
    """A piece of the good dictionary saves as much behind 3 MiB of other text as at the front."""
    rng = random.Random(4)
    good, bad = rng.randbytes(1 << 19), rng.randbytes(1 << 19)
    ready = quality._compressors({"id": b"test of long texts", "good": good, "bad": bad})
    other, piece = rng.randbytes(3 << 20), good[:100_000]
    front, end = (quality.figures(t, *ready) for t in (piece + other, other + piece))
    assert front[0] > 0 and end[0] > 0.9 * front[0] and end[3] > 0.9 * front[3]


def removed(t: str, seen: set) -> int:
    """Bytes of ``t`` in strings of 100 bytes that were seen before, here or in ``seen``."""
    raw, gone = t.encode(), set()
    for p in range(len(raw) - 99):
        if raw[p : p + 100] in seen:
            gone.update(range(p, p + 100))
        seen.add(raw[p : p + 100])
    return len(gone)


def test_repeats_of_several_texts_without_or_with_one_id(spark):
    """Texts of one id, or of none, are documents of their own: brute force in any order of the texts of an id."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, own = word(150), [word(200) for _ in range(6)]
    for ids in ((None, None, None), (3, 3, 3), (3, None, 4)):
        rows = [(i, shared + own[k] if k < 2 else own[k] + shared) for k, i in enumerate(ids)]
        found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        lost = sorted(r.n_removed for r in found)
        assert len(found) == 3 and lost == [0, 150, 150], (ids, lost)
        seen: set = set()
        assert sorted(removed(t, seen) for _, t in rows) == lost


def test_near_duplicates_of_an_id_with_several_texts(spark):
    """Links of each of its texts tie a document, whichever row comes first."""
    x, y = [[f"{p}{i}" for i in range(100)] for p in "xy"]
    edit = lambda w: " ".join([*w[:-1], "other"])
    for texts_of_5 in ((x, y), (y, x)):
        rows = [(5, " ".join(w)) for w in texts_of_5] + [(6, edit(x)), (7, edit(y)), (8, "something else")]
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {5: 5, 6: 5, 7: 5, 8: 8}
