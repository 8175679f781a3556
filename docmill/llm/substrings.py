"""Exact removal of repeated byte strings, across and within documents.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a smaller
doc_id, or earlier in the same document) is removed; strings are judged on the input.

1.  Each document selects anchors: the substrings of ``GRAM`` bytes whose hash is least in
    some window of LENGTH - GRAM + 1 neighbours.  Two equal strings of LENGTH bytes select
    the same anchor at the same place within them, so nothing repeated is missed.
2.  Anchors that occur once are dropped.  For the others, the bytes around each occurrence
    (its context, the LENGTH-byte strings whose first least gram it is) are brought together by
    anchor, in order of document and place.
3.  In each group every LENGTH-byte string of every context is compared with the earlier
    ones at the same distance from the anchor; those seen before are repeated.
4.  Repeated runs go back to their documents, which are cut.

Only repeated neighbourhoods are compared; groups are streamed in order and keep what is
distinct in them.  Nulls and edge cases: a null text is empty; a null doc_id counts as the
last one; different texts of one doc_id (or of none) are documents, in order of a digest; texts under LENGTH bytes lose nothing; repeated rows (same id and text) are one
document; a string that overlaps its own earlier occurrence counts; other columns are
ignored; empty input gives empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table
from .tokens import mix

LENGTH, GRAM = 100, 24
_REACH = LENGTH - GRAM
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = 2**63 - 1


def _rolled(raw: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` along the last axis, by doubling."""
    part, reach = raw.astype(np.uint64) + np.uint64(1), 1
    total, got = None, 0
    while True:
        if size & reach:
            n = raw.shape[-1] - got - reach + 1
            total = part[..., :n].copy() if total is None else total[..., : n] + part[..., got : got + n] * _power(got)
            got += reach
        if reach * 2 > size:
            return mix(total)
        n = part.shape[-1] - reach
        part = part[..., :n] + part[..., reach : reach + n] * _power(reach)
        reach *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _slide(x: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """``take`` (minimum or maximum) over all windows of ``width``."""
    reach = 1
    while reach * 2 <= width:
        x = take(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return take(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the selected anchors of a text.

    Each string of LENGTH bytes belongs to the leftmost of its least grams.  A place is
    packed as at << 16 | before << 8 | after: the strings of this anchor start from
    ``before`` to ``after`` bytes before it.
    """
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = _rolled(np.frombuffer(data, np.uint8), GRAM)
    width = _REACH + 1
    least = _slide(h, width, np.minimum)
    # A gram is least in some window around it if the greatest of the minima of these windows is its own.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(_slide(padded, width, np.maximum)[: len(h)] == h)
    mine = np.searchsorted(at, np.arange(len(least)))
    while len(off := np.flatnonzero(h[at[mine]] != least)):
        mine[off] += 1
    begins = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
    last = np.append(begins[1:], len(mine)) - 1
    own = at[mine[begins]]
    return h[own].view(np.int64), own << 16 | (own - begins) << 8 | (own - last)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) to (anchor, doc_id, digest, at, more): one row for an anchor of a batch, further places packed in more, so that no anchor fills a task."""
    for batch in batches:
        found = [anchors(t or b"") for t in batch.column(2).to_pylist()]
        if not found:
            continue
        ids, digests = (np.repeat(batch.column(i).to_numpy(), [len(h) for h, _ in found]) for i in range(2))
        h, at = (np.concatenate([f[i] for f in found]) for i in range(2))
        order = np.lexsort((at, digests, ids, h))
        h, places = h[order], np.column_stack([ids[order], digests[order], at[order]])
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        ends = np.append(begins[1:], len(h))
        more = np.full(len(begins), None, object)
        for i in np.flatnonzero(ends - begins > 1):
            more[i] = places[begins[i] + 1 : ends[i]].tobytes()
        for i in range(0, max(1, len(begins)), 200_000):
            part = begins[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[part]), *(pa.array(np.ascontiguousarray(places[part, k])) for k in range(3)), pa.array(more[i : i + 200_000], pa.binary())], names=["anchor", "doc_id", "digest", "at", "more"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors, sorted by anchor, to (doc_id, digest, at, anchor) of those at two places or more."""
    held: pa.Table | None = None

    def told(rows: pa.Table) -> pa.RecordBatch:
        anchor = rows["anchor"].to_numpy()
        same = anchor[1:] == anchor[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(anchor) else np.empty(0, bool)
        more = rows["more"].to_pylist()
        some = [i for i, m in enumerate(more) if m is not None]
        many[some] = True
        places = [np.column_stack([rows[c].to_numpy()[many] for c in ("doc_id", "digest", "at")])]
        keys = [anchor[many]]
        for i in some:
            places.append(np.frombuffer(more[i], np.int64).reshape(-1, 3))
            keys.append(np.full(len(places[-1]), anchor[i]))
        out = np.concatenate(places)
        # A place that repeated rows name twice is one place.
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)), pa.array(np.concatenate(keys))], names=["doc_id", "digest", "at", "anchor"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        # The last anchor may go on in the next batch.
        anchor = rows["anchor"].to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        held = rows.slice(cut)
        if cut:
            yield told(rows.slice(0, cut))
    if held is not None:
        yield told(held)


#: Contexts that a task compares before it passes them on.
HELD = 100_000


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text, places, anchors) to (anchor, doc_id, digest, at, left, right, context).

    Of equal contexts of an anchor that meet here, all but the first are repeated as a whole:
    they go on without their bytes and under a key of their own, so copies fill no task.
    """
    held: dict[tuple, list[tuple]] = {}
    n = 0
    for batch in batches:
        for doc_id, digest, text, places, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for place, anchor in set(zip(places, hashes, strict=True)):
                at, left, right = place >> 16, place >> 8 & 255, place & 255
                held.setdefault((anchor, left, right, text[at - left : at - right + LENGTH]), []).append((doc_id, digest, at))
                n += 1
            if n > HELD:
                yield from _context_batches(held)
                held, n = {}, 0
    yield from _context_batches(held)


def _context_batches(held: dict[tuple, list[tuple]]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    out: list[tuple] = []
    for (anchor, left, right, context), places in held.items():
        first = min(places)
        out.append((anchor, *first, left, right, context))
        out += [(doc_id ^ at, doc_id, digest, at, left, right, None) for doc_id, digest, at in places if (doc_id, digest, at) != first]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=_CONTEXT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=_CONTEXT)


_CONTEXT = ["anchor", "doc_id", "digest", "at", "left", "right", "context"]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by anchor, document and place, to (doc_id, digest, start, end) of repeated runs."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, left, right = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array((at - left).astype(np.int32)), pa.array((at - right + LENGTH).astype(np.int32))], names=["doc_id", "digest", "start", "end"])

    def compared() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(6).is_null()
            if known.true_count:
                done.append(whole(batch.filter(known)))
            yield batch.filter(pa.compute.invert(known)) if known.true_count else batch

    done: list[pa.RecordBatch] = []
    for runs in _compared(compared()):
        yield from done
        done.clear()
        yield runs
    yield from done


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, carried, before = None, np.empty(0, np.uint64), None
    for whole in batches:
        for offset in range(0, whole.num_rows, 4096):
            batch = whole.slice(offset, 4096)
            anchor, doc, digest, at, left = (batch.column(i).to_numpy() for i in range(5))
            context = batch.column(6).to_pylist()
            size = np.array([len(c) for c in context])
            widest = GRAM + 2 * _REACH
            # Contexts stand in rows with their anchors below each other; what a text lacks stays empty.
            room = np.zeros((len(context), widest), np.uint8)
            for i, c in enumerate(context):
                room[i, _REACH - left[i] : _REACH - left[i] + len(c)] = np.frombuffer(c, np.uint8)
            j = np.arange(widest - LENGTH + 1)
            there = (j[None, :] >= (_REACH - left)[:, None]) & (j[None, :] + LENGTH <= (_REACH - left + size)[:, None])
            same = np.concatenate(([before is not None and before == (anchor[0], doc[0], digest[0], at[0])], (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]) & (digest[1:] == digest[:-1]) & (at[1:] == at[:-1])))
            there &= ~same[:, None]
            key = mix(_rolled(room, LENGTH) ^ mix(anchor.view(np.uint64)[:, None] + j.astype(np.uint64)[None, :] * _BASE))
            flat = key[there]
            seen = np.ones(len(flat), bool)
            _, first = np.unique(flat, return_index=True)
            seen[first] = False
            if len(carried):
                mine = (anchor == last)[:, None].repeat(len(j), 1)[there]
                seen[mine] |= np.isin(flat[mine], carried)
            grid = np.zeros(there.shape, bool)
            grid[there] = seen
            edge = np.diff(np.pad(grid, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            base = at[row].astype(np.int64) - _REACH
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(digest[row]), pa.array((base + begin).astype(np.int32)), pa.array((base + end - 1 + LENGTH).astype(np.int32))], names=["doc_id", "digest", "start", "end"])
            ends = anchor == anchor[-1]
            new = np.unique(key[ends[:, None] & there])
            carried = np.union1d(carried, new) if anchor[-1] == last else new
            last, before = anchor[-1], (anchor[-1], doc[-1], digest[-1], at[-1])


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs covered by the given ones."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, starts, ends): every row with the byte runs to remove (overlapping, unsorted; null if none).

    Each of the three phases keeps only its result: places of repeated anchors, then runs.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.col("text").cast("binary").alias("text"))
    long = rows.filter(F.octet_length("text") >= LENGTH)
    found = long.mapInArrow(_anchor_rows, "anchor long, doc_id long, digest long, at long, more binary")
    often = found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_often, "doc_id long, digest long, at long, anchor long")
    places = often.groupBy(F.col("doc_id").alias("key"), "digest").agg(F.collect_list("at").alias("places"), F.collect_list("anchor").alias("anchors"))
    places = shared_checkpoint(places)
    contexts = long.join(places.hint("merge"), ["key", "digest"]).mapInArrow(_contexts, "anchor long, doc_id long, digest long, at int, left int, right int, context binary")
    runs = contexts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "digest", "at").mapInArrow(_repeats, "doc_id long, digest long, start int, end int")
    by_doc = shared_checkpoint(runs.groupBy(F.col("doc_id").alias("key"), "digest").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    return rows.join(by_doc.hint("merge"), ["key", "digest"], "left").select(F.when(F.col("key") != _LAST, F.col("key")).alias("doc_id"), "text", "starts", "ends")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or b""
            spans = merged(starts or [], ends or [])
            kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))
            out.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    return repeated_spans(docs).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
