"""Removal of repeated byte strings, over the whole corpus, by hash-compared suffix sorting.

Every LENGTH-byte window belongs to an anchor: the smallest hash among the GRAM-byte strings in it. Equal windows have
equal anchors, so only windows of one anchor need comparing. Neighbouring windows of one anchor form a segment, so the
corpus becomes some 2 / (LENGTH - GRAM + 2) segments a byte:

1. each task lists its segments as (anchor, segment hash, doc, start, windows). A segment that the task has seen
   earlier is repeated and goes no further, so a passage that a third of all documents hold costs a row of each task;
2. sorted by anchor, segments that equal an earlier one are repeated as a whole; an anchor with one segment is done;
3. anchors with several different segments get their bytes from the documents. Their windows are suffixes, which a
   mergesort orders: two compare by the length of their common prefix, found by binary search on prefix polynomial
   hashes, and the byte after it. Neighbours in order that agree on LENGTH bytes are compared byte by byte; of equal
   windows, all but the earliest are repeated.

Documents that are copies as a whole are recognised by digest first and take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, keyed, returned, texts
from .hashing import BUFFER, mix, prefix_hashes, range_hashes

LENGTH, GRAM = 100, 48
#: Bits of a place in a buffer.
PLACE_BITS = 21
#: Segments that a task holds before it passes them on.
HELD = 1_500_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def segments(data: bytes, length: int, gram: int, offsets: np.ndarray):
    """(anchor, segment hash, start, windows) of the segments of a buffer of documents that begin at offsets (the last
    entry is the buffer's end). Windows cross no document. windows is negative where a segment holds its anchor at
    several places, and so may hold equal windows itself."""
    chars = np.frombuffer(data, np.uint8)
    n = len(chars) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    prefix = prefix_hashes(chars)
    at = np.arange(len(chars) - gram + 1)
    hashes = mix(range_hashes(prefix, at, at + gram))
    place, above = np.uint64((1 << PLACE_BITS) - 1), ~np.uint64((1 << PLACE_BITS) - 1)
    high, at = hashes & above, at.astype(np.uint64)
    left = (_sliding_min(high | at, length - gram + 1) & place).astype(np.int64)
    right = (place - (_sliding_min(high | (place - at), length - gram + 1) & place)).astype(np.int64)
    least = hashes[left]
    inside = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[1:] |= ~inside[:-1]
    firsts = offsets[1:-1]
    fresh[firsts[firsts < n]] = True
    start = np.flatnonzero(fresh & inside)
    stop = np.flatnonzero(fresh | ~inside)
    stop = np.append(stop, n)[np.searchsorted(stop, start, "right")]
    whole = mix(range_hashes(prefix, start, stop + length - 1) + (stop - start).astype(np.uint64))
    tied = np.concatenate([[0], np.cumsum(left != right)])
    own = (tied[stop] > tied[start]) | (left[start] != left[stop - 1])
    return least[start], whole, start, np.where(own, start - stop, stop - start)


_SEGMENTS = "anchor long, whole long, doc_id long, start long, windows int, repeated boolean"


def _batch(anchor, whole, doc, start, windows, repeated) -> pa.RecordBatch:
    columns = [pa.array(anchor), pa.array(whole), pa.array(doc), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(repeated)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "whole", "doc_id", "start", "windows", "repeated"])


def _listed(length: int, gram: int):
    def run(found):
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            if not held:
                return
            anchor, whole, doc, start, windows = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((start, doc, whole, anchor))
            anchor, whole, doc, start, windows = (c[order] for c in (anchor, whole, doc, start, windows))
            again = np.zeros(len(anchor), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
            # those that are settled need no place among their anchor's: spread them
            anchor = np.where(again, mix((doc * 1_000_003 + start).astype(np.uint64)).view(np.int64), anchor)
            for a in range(0, len(anchor), 100_000):
                b = a + 100_000
                yield _batch(anchor[a:b], whole[a:b], doc[a:b], start[a:b], windows[a:b], again[a:b])

        for batch in found:
            for docs, starts, data, offsets in _buffers(batch.column(0).to_pylist(), batch.column(1), length):
                anchor, whole, start, windows = segments(data, length, gram, offsets)
                if len(start):
                    which = np.searchsorted(offsets, start, "right") - 1
                    held.append([anchor.view(np.int64), whole.view(np.int64), docs[which], start - offsets[which] + starts[which], windows])
                    size += len(start)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def _buffers(ids: list[int], found, length: int):
    """(doc of each part, its start in the document, bytes of the parts, offsets of the parts and the end). Parts of a long
    document overlap by length - 1 bytes, so that each window is in one of them."""
    docs, starts, parts, size = [], [], [], 0

    def made():
        return np.array(docs, np.int64), np.array(starts, np.int64), b"".join(parts), np.cumsum([0, *map(len, parts)])

    for doc, text in zip(ids, found, strict=True):
        raw = text.as_py().encode("utf-8", "surrogatepass")
        for at in range(0, max(len(raw) - length + 1, 0), BUFFER - length + 1):
            part = raw[at : at + BUFFER]
            if size + len(part) > BUFFER and parts:
                yield made()
                docs, starts, parts, size = [], [], [], 0
            docs.append(doc)
            starts.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield made()


def _sorted_runs(found, n_columns: int):
    """Columns of sorted batches, cut between runs of the first column only."""
    held = None
    for batch in found:
        now = [batch.column(i) for i in range(n_columns)]
        if held is not None:
            now = [pa.chunked_array([*h, *([c] if not isinstance(c, pa.ChunkedArray) else c.chunks)]) for h, c in zip(held, now, strict=True)]
            now = [c.combine_chunks() for c in now]
            now = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c for c in now]
        if not len(now[0]):
            continue
        keys = now[0].to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield [c.slice(0, last) for c in now]
        held = [[c.slice(last)] for c in now]
    if held is not None and len(held[0][0]):
        yield [h[0] for h in held]


def _compared(found):
    """Segments by anchor: repeated where an earlier equal one stands; else, with others of the anchor, still open
    (repeated is null)."""
    for columns in _sorted_runs(found, 6):
        anchor, whole, doc, start, windows, settled = (c.to_numpy(zero_copy_only=False) for c in columns)
        same = np.zeros(len(anchor), bool)
        same[1:] = anchor[1:] == anchor[:-1]
        again, own, windows = settled.astype(bool), windows < 0, np.abs(windows)
        again[1:] |= same[1:] & (whole[1:] == whole[:-1])
        runs = np.flatnonzero(~same)
        several = np.repeat(np.add.reduceat((~again).astype(np.int64), runs) > 1, np.diff(np.append(runs, len(anchor))))
        out = again | several | own
        yield _batch(anchor[out], whole[out], doc[out], start[out], windows[out], pa.array(again[out], mask=~again[out]))


def common_prefix(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of the suffixes that begin at a and at b, by binary search on
    prefix hashes. There must be ``most`` bytes behind each."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = range_hashes(prefix, a, a + middle) == range_hashes(prefix, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(chars: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of suffixes (starts ``at``) by group, then by their first ``most`` bytes, then as given: a bottom-up mergesort
    of all groups at once, whose comparisons cost the logarithm of ``most``. group must be ascending."""

    def before(x, y):  # is suffix x, of a later list, before y?
        n = common_prefix(prefix, at[x], at[y], most)
        whole = n >= most
        i = np.where(whole, 0, n)
        return ~whole & (chars[at[x] + i] < chars[at[y] + i])

    order = np.arange(len(at))
    first = np.searchsorted(group, group)  # where the group begins
    size = np.bincount(group, minlength=int(group[-1]) + 1)[group] if len(group) else group
    width, place = 1, order - first
    while len(at) and width < size.max():
        pair = first + place // (2 * width) * (2 * width)
        middle, end = np.minimum(pair + width, first + size), np.minimum(pair + 2 * width, first + size)
        left = np.arange(len(at)) < middle
        # how many of the other list come before: strictly smaller ones for the left list, not greater ones for the right
        low, high = np.where(left, middle, pair), np.where(left, end, middle)
        base = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            half = (low[open_] + high[open_]) >> 1
            own, other = order[open_], order[half]
            on_left = left[open_]
            goes = np.where(on_left, False, True)
            goes[on_left] = before(other[on_left], own[on_left])
            goes[~on_left] = ~before(own[~on_left], other[~on_left])
            low[open_[goes]] = half[goes] + 1
            high[open_[~goes]] = half[~goes]
        target = np.where(left, np.arange(len(at)), np.arange(len(at)) - (middle - pair)) + (low - base)
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, 2 * width
    return order


def repeated_windows(data: bytes, starts: np.ndarray, windows: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Segments stand in data at starts, in order of anchor, then of place in the corpus. For all their windows in that
    order: does an equal one stand before it? Equal windows hold their anchor at one distance from their start, so the
    suffixes are sorted in groups of anchor and distance, which are small."""
    chars, total = np.frombuffer(data, np.uint8), int(windows.sum())
    prefix = prefix_hashes(chars)
    sizes = windows + length - 1
    each = np.arange(len(chars) - gram + 1)
    hashes = mix(range_hashes(prefix, each, each + gram)).view(np.int64)
    places = np.flatnonzero(hashes == np.repeat(anchor, sizes)[: len(hashes)])
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(total)
    distance = places[np.searchsorted(places, at)] - at
    fresh = np.concatenate([[0], anchor[1:] != anchor[:-1]])
    key = np.repeat(np.cumsum(fresh), windows) * (length + 1) + distance
    first = np.argsort(key, kind="stable")
    group = np.cumsum(np.concatenate([[0], key[first][1:] != key[first][:-1]]))
    many = (np.bincount(group) > 1)[group]
    first, group = first[many], group[many]
    out = np.zeros(total, bool)
    if not len(first):
        return out
    order = suffix_order(chars, prefix, at[first], group, length)
    groups, sorted_at = group[order], at[first][order]
    a, b = sorted_at[:-1], sorted_at[1:]
    equal = (groups[1:] == groups[:-1]) & (range_hashes(prefix, a, a + length) == range_hashes(prefix, b, b + length))
    maybe = np.flatnonzero(equal)
    for k in range(0, len(maybe), 20_000):  # byte by byte
        few = maybe[k : k + 20_000]
        span = np.arange(length)
        equal[few] = (chars[a[few, None] + span] == chars[b[few, None] + span]).all(axis=1)
    out[first[order[1:][equal]]] = True  # the sort is stable: the first of equal windows is the earliest
    return out


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _settled(length: int, gram: int):
    """Open segments with their bytes, by anchor: the runs of repeated windows in them."""

    def run(found):
        for columns in _sorted_runs(found, 5):
            anchor, doc, start, windows = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
            raw = columns[4]
            cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            ends = np.append(cuts[1:], len(anchor))
            a = 0
            while a < len(cuts):  # some anchors at a time
                b = max(a + 1, int(np.searchsorted(np.cumsum(windows)[ends - 1], np.sum(windows[: cuts[a]]) + 200_000)))
                i, j = cuts[a], ends[b - 1]
                parts = [x.as_py() for x in raw.slice(i, j - i)]
                at = np.cumsum([0, *map(len, parts)])[:-1]
                count = windows[i:j].astype(np.int64)
                flags = repeated_windows(b"".join(parts), at, count, anchor[i:j], length, gram)
                # a run may go over from one segment to the next in this order: cut it there
                owner = np.repeat(np.arange(j - i), count)
                first = np.cumsum(count) - count
                x, y = _runs_of(flags)
                marks = np.unique(np.concatenate([x, first[(first > 0) & flags[np.minimum(first, len(flags) - 1)]]]))
                stops = np.minimum(y[np.searchsorted(y, marks, "right")], (first + count)[owner[marks]]) if len(marks) else marks
                own = owner[marks]
                yield pa.RecordBatch.from_arrays([pa.array(doc[i:j][own]), pa.array(start[i:j][own] + marks - first[own]), pa.array((stops - marks).astype(np.int32))], ["doc_id", "start", "windows"])
                a = b

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text), no two texts equal: (doc_id, start, windows), runs of repeated windows, not merged."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = docs.mapInArrow(_listed(length, gram), _SEGMENTS)
    by_anchor = listed.repartition(shards, "anchor").sortWithinPartitions("anchor", "whole", "doc_id", "start")
    compared = scratch.keep(by_anchor.mapInArrow(_compared, _SEGMENTS), "compared")
    known = compared.where("repeated").select("doc_id", "start", "windows")
    places = compared.where("repeated is null").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("places"))

    def cut(found):
        for batch in found:
            out = []
            for doc, text, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                out += [(p["anchor"], doc.as_py(), p["start"], p["windows"], raw[p["start"] : p["start"] + p["windows"] + length - 1]) for p in places.as_py()]
            kinds = {"anchor": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "windows": pa.int32(), "bytes": pa.binary()}
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    cut_out = docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(cut, "anchor long, doc_id long, start long, windows int, bytes binary")
    open_ = cut_out.repartition(shards, "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return known.unionByName(open_.mapInArrow(_settled(length, gram), "doc_id long, start long, windows int"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null if
    with_bytes is false).

    Texts are UTF-8 bytes, null is empty. A byte is removed when a string of ``length`` bytes that covers it also starts
    earlier: in a document of smaller doc_id, or in the same one before. Strings are judged on the input. Texts shorter
    than ``length`` stay. Rows without doc_id are left out. Rows that repeat a doc_id are documents of their own, in order
    of their texts' SHA-256; rows that repeat both doc_id and text are one document, and get its result each.
    """
    scratch, docs = Scratch(docs.sparkSession, "substrings"), texts(docs)
    docs, back = keyed(docs, scratch)
    digests = scratch.keep(docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n")), "digests")
    firsts = digests.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = scratch.keep(digests.join(firsts, "sha").where("doc_id > first").select("doc_id").distinct(), "copies")
    few = copies.count() <= BROADCAST_IDS
    copied = F.broadcast(copies) if few else copies
    unique = docs.join(copied, "doc_id", "left_anti")
    spans = repeated_spans(unique, length, gram, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))

    def cut(found):
        for batch in found:
            out = []
            for doc, text, spans, copy in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                kept, n_spans, end = [], 0, 0
                places = [(0, len(raw))] if copy.as_py() and len(raw) >= length else sorted((s["start"], s["start"] + s["windows"] + length - 1) for s in spans.as_py() or ())
                for a, b in places:
                    if a > end or not n_spans:
                        kept.append(raw[end:a])
                        n_spans += 1
                    end = max(end, b)
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((doc.as_py(), len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    copied = copies.withColumn("copy", F.lit(True))
    joined = docs.join(F.broadcast(copied) if few else copied, "doc_id", "left").join(spans, "doc_id", "left").select("doc_id", "text", "spans", "copy")
    return returned(joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), back)
