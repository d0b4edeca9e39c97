"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swap-based local search.

Only the lengths of pieces matter to a packing, and there are at most ``capacity`` of them. So the packing is made for
the histogram of lengths, as patterns (a multiset of lengths that share a sequence) with multiplicities: best-fit
decreasing first, then a local search over the underfull sequences that moves a piece, exchanges one for one, or two
for one, whenever the fuller of two sequences gets fuller (squared fill grows), until the emptiest run empty. The
histogram is all that reaches the driver; its size depends on the capacity, not on the corpus. Pieces then find their
slot by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, texts

#: Pieces that one rank window may hold, on average; more pieces of a length are ranked in more windows.
RANKED_TOGETHER = 100_000

Pattern = tuple[int, ...]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns with multiplicities that hold ``counts[length]`` pieces of each length."""
    open_bins: dict[int, Counter] = defaultdict(Counter)  # by room left
    rooms: list[int] = []

    def put(pattern: Pattern, times: int) -> None:
        room = capacity - sum(pattern)
        if times:
            if room not in open_bins or not open_bins[room]:
                insort(rooms, room)
            open_bins[room][pattern] += times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put((length,) * each, left // each)
                put((length,) * (left % each), int(left % each > 0))
                break
            room = rooms[at]
            pattern, times = open_bins[room].popitem()
            if not open_bins[room]:
                rooms.pop(at)
            each = room // length
            full = min(times, left // each)
            part = left % each if full < times and left // each < times else 0
            put(pattern + (length,) * each, full)
            put(pattern + (length,) * part, int(part > 0))
            put(pattern, times - full - int(part > 0))
            left -= full * each + part
    return Counter({p: n for bins in open_bins.values() for p, n in bins.items()})


def local_search(patterns: Counter, capacity: int) -> Counter:
    """Move, one-for-one and two-for-one exchanges between underfull sequences, all of them. Each moves load from the
    emptier to the fuller one, so squared fill strictly grows; a sequence that runs empty is gone. An exchange between
    two patterns is made in as many sequences as both have. Ends when there are as few sequences as the total allows,
    or no pair of patterns has an exchange left. Never makes more sequences."""
    total = sum(sum(p) * n for p, n in patterns.items())
    least = -(-total // capacity)
    counts, n = Counter(patterns), sum(patterns.values())
    settled: set[Pattern] = set()  # no two of these have an exchange
    heap = [(-sum(p), p) for p in counts if sum(p) < capacity]
    heapify(heap)
    while heap and n > least:
        now = heappop(heap)[1]
        if now in settled or not counts[now]:
            continue
        for other in sorted([now, *(p for p in settled if counts[p])], key=lambda p: (-sum(p), p)):
            times = counts[now] // 2 if other == now else min(counts[now], counts[other])
            low, high = (list(p) for p in sorted((now, other), key=lambda p: (sum(p), p)))
            if not times or not _improve(low, high, capacity):
                continue
            counts[now] -= times
            counts[other] -= times
            n -= 0 if low else times
            for made in (tuple(sorted(x, reverse=True)) for x in (low, high) if x):
                before = counts[made]
                counts[made] += times
                if sum(made) < capacity and (made not in settled or before < 2):
                    settled.discard(made)
                    heappush(heap, (-sum(made), made))
            heappush(heap, (-sum(now), now))
            break
        else:
            settled.add(now)
    return +counts


def _improve(low: list[int], high: list[int], capacity: int) -> bool:
    """One exchange that moves load from low to the fuller high, if there is any: a move of the largest piece that fits,
    else the exchange that fills most."""
    room = capacity - sum(high)
    if not room:
        return False
    if fits := [x for x in low if x <= room]:
        low.remove(best := max(fits))
        high.append(best)
        return True
    gain, best_in, best_out = 0, (), ()
    sizes, others, many, have = sorted(set(low)), sorted(set(high)), Counter(low), Counter(high)

    def consider(into: tuple, out: tuple) -> None:
        nonlocal gain, best_in, best_out
        if gain < sum(into) - sum(out) <= room:
            gain, best_in, best_out = sum(into) - sum(out), into, out

    for out in others:
        if at := bisect_right(sizes, room + out):
            consider((sizes[at - 1],), (out,))
        i, j = 0, len(sizes) - 1  # two of low's that come nearest to what fits
        while i <= j:
            if sizes[i] + sizes[j] > room + out:
                j -= 1
            else:
                if i < j or many[sizes[i]] > 1:
                    consider((sizes[i], sizes[j]), (out,))
                i += 1
        for other in others[: bisect_right(others, out)]:  # two of high's for one of low's
            if other != out or have[out] > 1:
                if at := bisect_right(sizes, room + out + other):
                    consider((sizes[at - 1],), (out, other))
    for x in best_in:
        low.remove(x)
        high.append(x)
    for x in best_out:
        high.remove(x)
        low.append(x)
    return gain > 0


def pack_lengths(counts: dict[int, int], capacity: int) -> Counter:
    return local_search(best_fit_decreasing(counts, capacity), capacity)


def slots(patterns: Counter, first: int = 0) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: (length, first rank, sequence of the first rank, offset), sorted. A run's ranks go
    to consecutive sequences at one offset."""
    taken: Counter = Counter()
    rows, sequence = [], first
    for pattern, times in sorted(patterns.items(), reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, encoder, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids; encoder() makes the object whose encode(text)
    gives a document's ids, end id included. A longer document is cut into pieces of ``capacity``; its first piece
    holds the remainder. ``start`` counts the document's ids before the piece. No ids, no piece."""

    def run(found):
        made = encoder()
        for batch in found:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = made.encode(text.as_py()).astype("<u4", copy=False)
                cut = len(ids) % capacity or min(capacity, len(ids))
                edges = [0, *range(cut, len(ids) + 1, capacity)] if len(ids) else [0]
                raw = memoryview(ids).cast("B")
                out += [(doc, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, _PIECES)


def assign(pieces: DataFrame, capacity: int, key: tuple[str, ...] = ("doc_id", "piece"), scratch: Scratch | None = None) -> DataFrame:
    """pieces with sequence_id and offset: a packing into as few sequences of ``capacity`` as found. Pieces of full length
    stand alone and aren't moved; their sequences have negative numbers. pieces is read three times: give a table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    alone = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    if not counts:
        return alone
    lengths, ranks, sequences, offsets = slots(pack_lengths(counts, capacity))
    salts = F.array(*[F.lit(-(-counts.get(n, 1) // RANKED_TOGETHER)) for n in range(capacity)])
    salted = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64(*key), F.element_at(salts, (F.col("length") + 1).cast("int"))))
    by_length = Window.partitionBy("length").orderBy("salt")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    # the runs of ranks are bounded by the capacity: best-fit opens a pattern or two for each length that it places
    edges = lengths * (1 << 44) + ranks
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(found):
        for batch in found:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(edges, length.astype(np.int64) * (1 << 44) + rank, "right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long").unionByName(alone)


def pack_documents(docs: DataFrame, encoder, capacity: int = 1024) -> DataFrame:
    """Each piece of each document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have their end id alone; a document whose encoder gives no id has no row; repeated rows are
    packed as often as they come; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return assign(scratch.keep(token_pieces(docs, encoder, capacity), "pieces"), capacity)
