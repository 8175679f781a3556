"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary labelled text.  The top order
counts in how many distinct texts a word follows another, less an absolute discount; what
the discounts leave goes to the word's continuation count (an expression counts once for
each different word before it), from there to that of its stem (its first bytes), and
from there to the number of distinct words that the stem begins, which both classes
share: rare expressions say nearly the same in both models.  A text's evidence is its
length-normalised log-likelihood ratio by the bigram models and, by the lower order, where
a single copied passage cannot speak as loudly, the largest ratio of any one word and of
any run of ``RUN`` words: a short expression counts alike in a short and in a long text.
A logistic curve, fitted on labelled texts that were not counted and set to the share of
toxic labels, turns them into a score.

Counts cover all distinct labelled texts outside the calibration part; the classes are
balanced by each model's own total alone.  The model is a Spark table keyed by the full
64-bit hash of a word, stem or bigram, so it grows with the corpus and no gram shares
another's counts; only a few totals come to the driver.  Only texts that are counted are
dealt to meet their labels.  To score, texts are packed, dealt into blocks of some
``BLOCK`` bytes by a hash of id and text, the distinct grams of each block are joined to
the table, and each block meets the counts of its own grams.

The features, the discount and the kind of top count were chosen by a split inside the rows
that may be learned from.

Nulls and edge cases: a null, empty or wordless text has no evidence, and its score is
the curve's value at zero; equal texts score alike; a null doc_id is not held out; labels
without a value and other columns, whatever their names, are ignored; if a class has no
labelled text, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import fit_logistic, held_out
from .common import drop_checkpoint, freeing, shared_checkpoint, table
from .quality import sample
from .tokens import OUTSIDE_WORDS, distinct, give_back, hashed_texts, hashed_words, mix

STEM = 5
#: Kneser-Ney's absolute discount (a multiple of a half).  What one text alone says counts for nothing.
DISCOUNT = 1.5
RUN = 5
#: One labelled text in so many calibrates, at most so many of each class.
CALIBRATE, CALIBRATION = 5, 1500
THRESHOLD = 0.5
#: Bytes of text that meet the counts of their grams at once, and that a part of the counted bigrams stands for.
BLOCK, PART = 16 << 20, 16 << 20
#: Grams held before they are made distinct and passed on.
HELD = 1 << 20
#: First bits of a hash by which rows that cannot meet are left out before any are shuffled.
KNOWN = 26
#: Shards of the table that blocks ask, at most (beyond, a shard is copied for groups of blocks), and the bits that name them.
SHARDS, SHARD_BITS = 4096, 20

_STEMS = np.uint64(0x5851F42D4C957F2D)
_COUNTS = ("a0", "a1", "b0", "b1", "c0", "c1")


def grams(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words, stems and bigrams (one fewer than words) of a text."""
    words, stems = hashed_words((data or b"").lower(), OUTSIDE_WORDS, STEM)
    return words, mix(stems ^ _STEMS), pair_hashes(words[:-1], words[1:])


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(3) + second)


#: Lower case, and everything but letters, digits and other characters' bytes a blank: what a text's words are read from.
_PLAIN = bytes(0x20 if OUTSIDE_WORDS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Lower-cased texts, some MiB at a time: what the arrays of one step are made from."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append((t or b"").translate(_PLAIN))
        size += len(part[-1])
        if size > 1 << 20:
            yield part
            part, size = [], 0
    if part:
        yield part


def _all_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, stems and bigrams of lower-cased texts in a row, and where each text's words begin; bigrams across two texts are there and to be left out."""
    words, stems, first = hashed_texts(texts, OUTSIDE_WORDS, STEM)
    return words, mix(stems ^ _STEMS), pair_hashes(words[:-1], words[1:]), first


def known_bits(keys: DataFrame) -> np.ndarray:
    """For each value of the first KNOWN bits of a 64-bit key (the only column), whether there is such a key: 8 MiB, whatever the table."""
    at = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - KNOWN) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    known = np.zeros((1 << KNOWN) // 8, np.uint8)
    for r in parts:
        begin = (r["part"] - 1) * 4096
        known[begin : begin + 4096] = np.frombuffer(r["bits"], np.uint8)
    return known


def _has(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the table may have each key; never false for one that it has."""
    at = (keys >> np.uint64(64 - KNOWN)).astype(np.int64)
    return known[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _counted_pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(text, y) to (part, piece): bigrams dealt by their first word, with the number of texts of each class that hold them, as places in a list of words."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        vocabulary, where = np.unique(np.concatenate([w for w, *_ in held]), return_index=True)
        stems = np.concatenate([s for _, s, *_ in held])[where]
        prev, word, y = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        code = np.searchsorted(vocabulary, prev) * len(vocabulary) + np.searchsorted(vocabulary, word)
        code, at = np.unique(code, return_inverse=True)
        n1 = np.bincount(at, y).astype(np.int64)
        n0 = np.bincount(at, minlength=len(code)) - n1
        first, second = code // len(vocabulary), code % len(vocabulary)
        own = (vocabulary % np.uint64(parts)).astype(np.int64)
        part = own[first]
        for k in range(parts):
            mine = part == k
            used, places = np.unique(np.concatenate([first[mine], second[mine]]), return_inverse=True)
            n = int(mine.sum())
            named = own == k
            piece = _squeeze(_delta(vocabulary[used]), places[:n], places[n:], n0[mine], n1[mine], _delta(vocabulary[named]), stems[named])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), piece], names=["part", "piece"])

    for batch in batches:
        y = batch.column(1).to_numpy()
        done = 0
        for texts in _chunks(batch.column(0).to_pylist()):
            words, stems, _, first = _all_grams(texts)
            whose = np.repeat(np.arange(len(texts)), np.diff(first))
            inside = np.flatnonzero(whose[1:] == whose[:-1])
            # Each bigram once for a text.
            order = inside[np.lexsort((words[inside + 1], words[inside], whose[inside]))]
            key = np.column_stack([whose[order].astype(np.uint64), words[order], words[order + 1]])
            once = order[np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))] if len(order) else order
            held.append((words, stems, words[once], words[once + 1], y[done + whose[once]]))
            done, size = done + len(texts), size + len(words)
            if size > HELD:
                yield from flush()
                held, size = [], 0
                give_back()
    if size:
        yield from flush()


def _delta(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _squeeze(*columns: np.ndarray) -> pa.Array:
    """One piece: the columns as 64-bit planes of bytes, compressed (most planes are zeros)."""
    packed = b"".join(len(c).to_bytes(8, "little") + np.ascontiguousarray(c.astype(np.int64 if c.dtype.kind == "i" else c.dtype).view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns)
    return pa.array([zstandard.ZstdCompressor(level=1).compress(packed)], pa.binary())


def _spread(piece: bytes) -> list[np.ndarray]:
    """The columns of a piece, as unsigned integers."""
    raw, out = zstandard.ZstdDecompressor().decompress(piece), []
    while raw:
        n = int.from_bytes(raw[:8], "little")
        planes = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).reshape(n))
        raw = raw[8 + 8 * n :]
    return out


_SUMS = "kind int, part long, piece binary"
_WORDS = "gram long, stem long, " + ", ".join(f"{c} double" for c in _COUNTS)


def _summed_pairs(table_: pa.Table, parts: int) -> pa.Table:
    """The pieces of one part to pieces: the bigrams that pass the discount (kind 2), what its bigrams say of words (0) and its words' stems (1), dealt by word."""
    firsts, seconds, counts, named, stems = [], [], [], [], []
    for piece in table_["piece"]:
        delta, first, second, n0, n1, own, stem = _spread(piece.as_py())
        words = np.cumsum(delta)
        firsts.append(words[first.astype(np.int64)])
        seconds.append(words[second.astype(np.int64)])
        counts.append(np.column_stack([n0, n1]).astype(np.float64))
        named.append(np.cumsum(own))
        stems.append(stem)
    named, where = np.unique(np.concatenate(named), return_index=True)
    stems = np.concatenate(stems)[where]
    words = distinct(np.concatenate([*firsts, *seconds]))
    first, second = (np.searchsorted(words, np.concatenate(x)) for x in (firsts, seconds))
    code, at = np.unique(first * len(words) + second, return_inverse=True)
    n = np.column_stack([np.bincount(at, np.concatenate(counts)[:, y], len(code)) for y in (0, 1)])
    first, second = code // len(words), code % len(words)
    # As word: the number of words before it (a); as context: the counts it begins (b) and what the discounts leave of them (c).
    total = lambda k, v: np.bincount(k, v, len(words))
    a, b, c = (np.column_stack([total(k, v(n[:, y])) for y in (0, 1)]) for k, v in ((second, lambda x: x > 0), (first, lambda x: x), (first, lambda x: np.maximum(x - DISCOUNT, 0))))
    # A context none of whose bigrams passes the discount leaves all to the lower order, as one without counts does.
    b[c == 0] = 0
    passing = (n > DISCOUNT).any(axis=1)
    grams_ = pair_hashes(words[first[passing]], words[second[passing]])
    order = np.argsort(grams_)
    out = [(2, 0, _squeeze(_delta(grams_[order]), *n[passing][order].T.astype(np.int64)))]
    begun = (c > 0).any(axis=1)
    of_stem, of_word, of_begun = (x % np.uint64(parts) for x in (named, words, words[begun]))
    for k in range(parts):
        i, j, g = of_stem == k, of_word == k, of_begun == k
        out.append((0, k, _squeeze(_delta(named[i]), stems[i], _delta(words[j]), *a[j].T.astype(np.int64), _delta(words[begun][g]), *(x for y in (b, c) for x in y[begun][g].T))))
    give_back()
    return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.chunked_array([o[2] for o in out], pa.binary())], ["kind", "part", "piece"])


def _summed_words(table_: pa.Table) -> pa.Table:
    """The pieces of the words of one part to a row for each of them: its stem and its counts."""
    keys, stems, at_word, at_context = [], [], [], []
    for piece in table_["piece"]:
        named, stem, words, a0, a1, begun, *of = _spread(piece.as_py())
        keys.append(np.cumsum(named))
        stems.append(stem)
        at_word.append((np.cumsum(words), a0, a1))
        at_context.append((np.cumsum(begun), *(x.view(np.float64) for x in of)))
    words, where = np.unique(np.concatenate(keys), return_index=True)
    counts = np.zeros((len(words), 6))
    for found, column in ((at_word, 0), (at_context, 2)):
        at = np.searchsorted(words, np.concatenate([f[0] for f in found]))
        for i in range(1, len(found[0])):
            counts[:, column + i - 1] = np.bincount(at, np.concatenate([f[i] for f in found]).astype(np.float64), len(words))
    return pa.table([pa.array(words.view(np.int64)), pa.array(np.concatenate(stems)[where].view(np.int64)), *(pa.array(counts[:, i]) for i in range(6))], ["gram", "stem", *_COUNTS])


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of bigrams to (gram, a0, a1)."""
    for batch in batches:
        for piece in batch.column(0):
            delta, n0, n1 = _spread(piece.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(delta).view(np.int64)), pa.array(n0.astype(np.float64)), pa.array(n1.astype(np.float64))], names=["gram", "a0", "a1"])


_TABLE = "kind int, gram long, " + ", ".join(f"{c} float" for c in _COUNTS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as compressed pieces: a few bytes for each gram."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for batch in batches:
        if batch.num_rows:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=options) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["piece"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.column(0):
            yield from pa.ipc.open_stream(piece.as_buffer())


def _counted_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, y): each distinct text of each class of ``known`` (_id, y) once.  Only these are shuffled."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    first = rows.select("_id", "digest").join(known.hint("merge"), "_id").groupBy("digest", "y").agg(F.min("_id").alias("_id"))
    first = shared_checkpoint(first.select("_id", "digest", "y"))
    bits = docs.sparkSession.sparkContext.broadcast(known_bits(first.select(F.xxhash64("_id", "digest"))))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = _has(bits.value, batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mine)) for c in batch.columns[1:]], names=["_id", "digest", "text"])

    schema = rows.schema
    some = rows.select(F.xxhash64("_id", "digest").alias("_key"), "_id", "digest", "text").mapInArrow(possible, schema)
    return some.join(first.hint("merge"), ["_id", "digest"]).dropDuplicates(["digest", "y", "_id"]).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> dict:
    """The model: a table of counts by gram, a few totals, and the curve."""
    known = labels.filter(usable & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).distinct()
    fold = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(CALIBRATE))
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return {"constant": 1.0 if 1 in size else 0.0}
    texts = _counted_texts(docs, known.filter(fold != 0))
    # Most bigrams of a corpus occur in one text only: they are dealt packed, by their own hash, and only sums go on.
    parts = max(8, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART))
    dealt = texts.mapInArrow(lambda batches: _counted_pairs(batches, parts), "part long, piece binary")
    summed = shared_checkpoint(dealt.groupBy("part").applyInArrow(lambda t: _summed_pairs(t, parts), _SUMS))
    words = summed.filter("kind = 0").groupBy("part").applyInArrow(_summed_words, _WORDS)
    kept_words = shared_checkpoint(words.mapInArrow(_packed, "piece binary"))
    words = kept_words.mapInArrow(_unpacked, _WORDS)
    # Types: the distinct words that begin with the stem and follow another, which both classes share.
    zero = F.lit(0).cast("double")
    stems = words.filter("a0 + a1 > 0").groupBy(F.col("stem").alias("gram")).agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"), F.count(F.lit(1)).alias("b0"))
    pairs = summed.filter("kind = 2").select("piece").mapInArrow(_pairs_of, "gram long, a0 double, a1 double")
    counts = words.select(F.lit(0).alias("kind"), "gram", *_COUNTS)
    counts = counts.union(stems.select(F.lit(1), "gram", "a0", "a1", "b0", zero, zero, zero)).union(pairs.select(F.lit(2), "gram", "a0", "a1", zero, zero, zero, zero))
    counts = counts.select("kind", "gram", *[F.col(c).cast("float").alias(c) for c in _COUNTS])
    counts = shared_checkpoint(counts.mapInArrow(_packed, "piece binary")).mapInArrow(_unpacked, _TABLE)
    for done in (summed, kept_words):
        drop_checkpoint(done)
    over = lambda c: F.coalesce(F.sum(F.greatest(F.col(c) - DISCOUNT, zero)), zero)
    sums = {r["kind"]: r for r in counts.filter("kind < 2").groupBy("kind").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ("a0", "a1", "b0")], over("a0").alias("o0"), over("a1").alias("o1"), F.count(F.lit(1)).alias("n")).collect()}
    of_words, of_stems = (sums.get(k) or {"a0": 0.0, "a1": 0.0, "b0": 0.0, "o0": 0.0, "o1": 0.0, "n": 0} for k in (0, 1))
    total = [max(of_stems[f"a{y}"], 1.0) for y in (0, 1)]  # words and stems have the same total
    # A word of one text in a class, and no context, says nothing: it is left out, and so is met by zeros.
    grown = counts.filter(f"kind > 0 OR a0 > {DISCOUNT} OR a1 > {DISCOUNT} OR b0 + b1 > 0").select("gram", *_COUNTS)
    model: dict = {
        "table": grown, "known": known_bits(grown.select("gram")), "total": total, "types": of_stems["b0"] + 0.5 * (of_stems["n"] + 1),
        "back_stem": [1 - of_stems[f"o{y}"] / total[y] for y in (0, 1)], "back_word": [1 - of_words[f"o{y}"] / total[y] for y in (0, 1)],
    }
    part = sample(docs, labels, "toxic", usable & (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(CALIBRATE)) == 0), CALIBRATION)
    rows = freeing(evidence_of(part, model, ("y",))).collect()
    x = np.array([(r["mean"], r["run"], r["top"]) for r in rows]).reshape(-1, 3)
    y = np.array([r["y"] for r in rows])
    model["curve"] = fit_logistic(x, y) if len(set(y.tolist())) == 2 else np.array([0.0, 0.5, 0.5, -4.0])
    if len(set(y.tolist())) == 2:
        model["curve"][-1] += math.log(size[1] / size[0])
    return model


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of ``values`` for each wanted key, zeros for keys that are not there."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0.0)


def evidence(texts: list[bytes], keys: np.ndarray, values: np.ndarray, model: dict) -> np.ndarray:
    """For each lower-cased text: the log-likelihood ratio per word, and the largest of any run of RUN words and of any word by the lower order.

    ``keys`` (sorted) and ``values`` are the rows of the table for at least the texts' grams.
    """
    words, stems, pairs, first = _all_grams(texts)
    out = np.zeros((len(texts), 3))
    sizes = np.diff(first)
    if not len(words):
        return out
    word_rows, stem_rows, pair_rows = (_found(keys, values, g) for g in (words, stems, pairs))
    opens = np.zeros(len(words), bool)
    opens[first[:-1][sizes > 0]] = True
    chance, lower = [], []
    types = stem_rows[:, 2]
    shared = (types + 0.5) / model["types"]
    within = 1 / (types + 1)
    over = lambda rows, y: np.maximum(rows[:, y] - DISCOUNT, 0)
    for y in (0, 1):
        stem = over(stem_rows, y) / model["total"][y] + model["back_stem"][y] * shared
        word = over(word_rows, y) / model["total"][y] + model["back_word"][y] * stem * within
        lower.append(word + shared * within)
        total = np.maximum(word_rows[:-1, 2 + y], 1)
        follows = over(pair_rows, y) / total + (1 - word_rows[:-1, 4 + y] / total) * word[1:]
        chance.append(np.where(opens, word, np.concatenate((word[:1], follows))))
    some = np.flatnonzero(sizes)
    begins, n = first[some], sizes[some]
    whole, ratio = np.log(chance[1] / chance[0]), np.log(lower[1] / lower[0])
    out[some, 0] = np.add.reduceat(whole, begins) / n
    out[some, 2] = np.maximum.reduceat(ratio, begins)
    # Sums of the runs that end with each word, shorter at the beginning of a text; only full ones count, or the whole of a short text.
    sums = np.concatenate(([0.0], np.cumsum(ratio)))
    end = np.arange(1, len(words) + 1)
    start = np.repeat(begins, n)
    run = sums[end] - sums[np.maximum(start, end - RUN)]
    run[end - start < np.minimum(RUN, np.repeat(n, n))] = -np.inf
    out[some, 1] = np.maximum.reduceat(run, begins)
    return out


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, _data, ...) to (_block, piece): what a batch has of each block, compressed together."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(blocks[order])) + 1, len(blocks)) if len(blocks) else []
        plain = pa.array((b" ".join((t.as_py() or b"").translate(_PLAIN).split()) for t in batch.column(1)), pa.binary())
        rows = pa.table([plain, *batch.columns[2:]], batch.schema.names[1:])
        found, pieces, begin = [], [], 0
        for end in ends:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=options) as writer:
                writer.write_table(rows.take(pa.array(order[begin:end])).combine_chunks())
            found.append(blocks[order[begin]])
            pieces.append(out.getvalue().to_pybytes())
            begin = end
        del plain, rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(pieces, pa.binary())], names=["_block", "piece"])


def _texts_of(piece: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(piece.as_buffer()).read_all()


def _block_keys(pieces: pa.ChunkedArray, known: np.ndarray, shards: int) -> np.ndarray:
    """The grams of a block that the table may have, by shard and sorted: the same however its texts were packed."""
    out = np.empty(0, np.uint64)
    held: list[np.ndarray] = []
    for piece in pieces:
        for texts in _chunks(_texts_of(piece)["_data"].to_pylist()):
            words, stems, pairs, first = _all_grams(texts)
            inner = np.ones(len(pairs), bool)
            inner[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))] - 1] = False
            mine = np.concatenate([words, stems, pairs[inner]])
            held.append(distinct(mine[_has(known, mine)]))
            if sum(map(len, held)) > HELD:
                out, held = distinct(np.concatenate([out, *held])), []
    out = distinct(np.concatenate([out, *held]))
    return out[np.argsort(_shard(out, shards), kind="stable")]


def evidence_of(docs: DataFrame, model: dict, carry: tuple[str, ...]) -> DataFrame:
    """The columns of ``carry`` and mean, run and top: the evidence of each row."""
    data = F.col("text").cast("binary")
    n = docs.agg(F.sum(F.octet_length(data))).first()[0] or 0
    # The id belongs to the hash, so that many copies of a text are dealt over the blocks.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(n / BLOCK))))
    names = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(block.alias("_block"), data.alias("_data"), *[F.col(c).alias(name) for c, name in zip(carry, names, strict=True)])
    rows = rows.mapInArrow(_packed_texts, "_block long, piece binary").repartition("_block")
    filter_ = docs.sparkSession.sparkContext.broadcast(model["known"])
    blocks = max(1, math.ceil(n / BLOCK))
    shards, salts = min(max(16, blocks), SHARDS), math.ceil(blocks / SHARDS)

    def ask(packed: pa.Table) -> pa.Table:
        keys = _block_keys(packed["piece"], filter_.value, shards)
        block = packed["_block"][0].as_py()
        shard = _shard(keys, shards)
        begins = np.searchsorted(shard, np.arange(shards + 1))
        there = np.flatnonzero(np.diff(begins))
        pieces = [_squeeze(_delta(keys[begins[k] : begins[k + 1]])) for k in there]
        del keys, shard
        give_back()
        return pa.table([pa.array(there, pa.int64()), pa.array([block % salts] * len(there), pa.int64()), pa.array([block] * len(there), pa.int64()), pa.chunked_array(pieces, pa.binary())], ["shard", "salt", "_block", "piece"])

    def answer(wanted: pa.Table, counts: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(_spread(p.as_py()) for p in counts["counts"]), strict=True)] or [np.empty(0, np.uint64)] * 7
        keys, first = np.unique(columns[0], return_index=True)
        values = np.column_stack([c.view(np.int64)[first] / 2 for c in columns[1:]]).reshape(-1, 6)
        # All counts are multiples of a half (DISCOUNT is one): as small whole numbers they take a byte or two.
        pieces = [_squeeze(*np.rint(2 * _found(keys, values, np.cumsum(_spread(p.as_py())[0]))).astype(np.int64).T) for p in wanted["piece"]]
        return pa.table([wanted["_block"], wanted["shard"], pa.chunked_array(pieces, pa.binary())], ["_block", "shard", "values"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            values = [np.rint(2 * c.to_numpy().astype(np.float64)).astype(np.int64) for c in batch.columns[1:]]
            shard = _shard(keys, shards)
            for k in distinct(shard):
                mine = np.flatnonzero(shard == k)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), _squeeze(keys[mine], *(v[mine] for v in values))], names=["shard", "counts"])

    wanted = rows.groupBy("_block").applyInArrow(ask, "shard long, salt long, _block long, piece binary")
    given = model["table"].mapInArrow(dealt, "shard long, counts binary").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    held = wanted.groupBy("shard", "salt").cogroup(given.groupBy("shard", "salt")).applyInArrow(answer, "_block long, shard long, values binary")
    small = {k: v for k, v in model.items() if k not in ("table", "known")}
    schema = docs.select(*carry).schema.add("mean", "double").add("run", "double").add("top", "double")

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        keys = _block_keys(packed["piece"], filter_.value, shards)
        values = np.zeros((len(keys), 6))
        shard = _shard(keys, shards)
        for k, piece in zip(answers["shard"].to_pylist(), answers["values"], strict=True):
            values[np.searchsorted(shard, k) : np.searchsorted(shard, k + 1)] = np.column_stack([c.view(np.int64) / 2 for c in _spread(piece.as_py())])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        parts = []
        for piece in packed["piece"]:
            texts = _texts_of(piece)
            found = np.concatenate([evidence(t, keys, values, small) for t in _chunks(texts["_data"].to_pylist())])
            parts.append(pa.table([*texts.columns[1:], *(pa.array(found[:, i]) for i in range(3))], [*carry, "mean", "run", "top"]))
        give_back()
        return pa.concat_tables(parts)

    return rows.groupBy("_block").cogroup(held.groupBy("_block")).applyInArrow(run, schema)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(64 - SHARD_BITS)) % np.uint64(shards)).astype(np.int64)


def score(docs: DataFrame, model: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` and score, in [0, 1]; a carried column of that name gives way."""
    names = ["doc_id", *[c for c in carry if c not in ("doc_id", "score")]]
    if "constant" in model:
        return docs.select(*names, F.lit(float(model["constant"])).alias("score"))
    *weights, intercept = (float(w) for w in model["curve"])
    given = docs.select("text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id"))
    found = evidence_of(given, model, tuple(f"c{i}" for i in range(len(names))))
    line = F.lit(intercept)
    for w, c in zip(weights, ("mean", "run", "top"), strict=True):
        line = line + F.col(c) * w
    line = F.least(F.greatest(line, F.lit(-500.0)), F.lit(500.0))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (1 / (1 + F.exp(-line))).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0)))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
