"""Line dedup by a segment-partition edit join.

Lines of two texts are alike when at most EDITS insertions, deletions and changes of characters lead from one to the
other, and no more than one for each TENTH characters of the longer. A line split into EDITS + 1 segments keeps one of
them whole in every line within EDITS edits, at a place that the edits shift only so far. So each line lists its
segments by (length of the line, number, content), and looks for the segments that lines of its own length and up to
EDITS shorter would have, in the multi-match-aware windows. What meets at a key is verified with banded bit-parallel edit
distance. Equal lines are one line from the start.

A key at which many lines meet gives first a few pairs of each; after what those connect, only pairs of lines that
aren't connected yet and whose character counts allow it: an edit changes two of the counts by one at most, so lines
whose profiles are further apart than 2 * EDITS can't be alike.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, only_ids, returned, texts
from .components import components
from .hashing import BASE, mix, powers

EDITS, TENTH = 2, 10
#: Lines that meet at one key, above which only lines not connected otherwise are paired.
CROWDED = 12
#: Lines that may need a name of their own: 24 bytes each, on the driver and in every worker.
MOST_RENAMED = 1_000_000
#: Counts in a line's profile.
KINDS = 32
#: Characters that are hashed at a time.
CHARS = 1 << 18


def allowed(longer: int) -> int:
    return min(EDITS, longer // TENTH)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance if it is at most ``most``, else most + 1. What both begin and end with is cut off; then a band
    of bit vectors (vertical differences of the table's column around its diagonal) moves along the longer string."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start, end = 0, len(b)
    if a[:end] != b:
        low, high = 0, end  # length of the common prefix
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if a[:half] == b[:half] else (low, half - 1)
        start = low
    else:
        return len(a) - len(b)
    a, b = a[start:], b[start:]
    low, high = 0, len(b)
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[-half:] == b[-half:] else (low, half - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not b:
        return len(a)
    if most == 0:
        return 1
    return _banded(a, b, most)


def _banded(a: str, b: str, most: int) -> int:
    """a is the longer. Rows are characters of a, columns of b; bit ``width - 1 - 2 * most + i`` ... the band holds rows
    column - most .. column + most. The score follows the band's lowest row, then the last row of the table."""
    if len(a) <= most:
        return _small(a, b, most)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score = full << (width - most - 1) & full, 0, most
    limit = most + len(b) - (len(a) - most)
    shift, mask = most + 1 - width, top >> 1
    for j, c in enumerate(b):
        found = places.get(c, 0)
        x = (found >> shift if shift >= 0 else found << -shift) & full
        shift += 1
        zero = ((((x & plus) + plus) ^ plus) | x | minus) & full
        up, down = minus | (~(zero | plus) & full), zero & plus
        if j < len(a) - most:
            score += not zero & top
        else:
            score += bool(up & mask) - bool(down & mask)
            mask >>= 1
        if score > limit:
            return most + 1
        plus, minus = down | (~((zero >> 1) | up) & full), (zero >> 1) & up
    return min(score, most + 1)


def _small(a: str, b: str, most: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def line_id(line: str) -> tuple[int, int]:
    """128 bits of a line, as two signed longs."""
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


class Names:
    """A long for each line, no two alike: the first half of its 128 bits, or for the few lines whose half another line
    has, too, one of their own (see renamed)."""

    def __init__(self, identify=line_id, others: dict[tuple[int, int], int] | None = None):
        self.identify, self.others = identify, others or {}

    def __call__(self, line: str) -> int:
        found = self.identify(line)
        return self.others.get(found, found[0]) if self.others else found[0]


def renamed(places: DataFrame, scratch: Scratch) -> dict[tuple[int, int], int]:
    """Names for all but one of the lines that share h1. Of n different lines about n * n / 2^65 do, a million of some 6e12,
    so they fit in memory; more than MOST_RENAMED are an error."""
    halves = places.groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).where("low <> high").select("h1", "low")
    halves = scratch.keep(halves, "halves")
    if halves.isEmpty():
        return {}
    some = halves.count()
    if some > MOST_RENAMED:
        raise ValueError(f"{some} first halves of lines' hashes meet; the bound is {MOST_RENAMED}")
    others = places.join(F.broadcast(halves), "h1").where("h2 <> low").select("h1", "h2").distinct().limit(MOST_RENAMED + 1).collect()
    if len(others) > MOST_RENAMED:
        raise ValueError(f"more than {MOST_RENAMED} lines share the first halves of their hashes")
    out: dict[tuple[int, int], int] = {}
    left, taken, salt = [tuple(r) for r in others], set(), 0
    while left:  # a new name may be some line's, too; such lines get another
        tried = {line: xxhash.xxh3_64_intdigest(repr(line).encode(), salt) - (1 << 63) for line in left}
        new = places.sparkSession.createDataFrame([(n,) for n in set(tried.values())], "h1 long")
        used = taken | {r[0] for r in places.join(F.broadcast(new), "h1", "left_semi").select("h1").distinct().collect()}
        left, salt = [], salt + 1
        for line, name in tried.items():
            if name in used:
                left.append(line)
            else:
                out[line] = name
                used.add(name)
                taken.add(name)
    return out


def segment_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line's number, key, listed) of the lines' own segments (listed) and of those that they look for."""
    sizes = np.array([len(x) for x in lines], np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    power, inverse = powers(len(chars))
    prefix = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[: len(chars)], out=prefix[1:])
    begin = np.cumsum(sizes) - sizes
    numbers, keys, own = [], [], []
    parts = EDITS + 1
    for delta in range(EDITS + 1):
        length = sizes - delta
        short, long_ = length // parts, length % parts  # the last long_ segments have one character more
        for i in range(parts):
            longer_before = np.maximum(i - (parts - long_), 0)
            place = i * short + longer_before
            size = short + (i >= parts - long_)
            for at in range(max(-i, delta - (EDITS - i)), min(i, delta + EDITS - i) + 1):
                start = place + at
                good = np.flatnonzero((start >= 0) & (start + size <= sizes) & (length >= TENTH - 1))
                a = begin[good] + start[good]
                h = (prefix[a + size[good]] - prefix[a]) * inverse[a]
                keys.append(mix(h * BASE + length[good].astype(np.uint64) * np.uint64(parts) + np.uint64(i)))
                numbers.append(good)
                own.append(np.full(len(good), delta == 0 and at == 0))
    return np.concatenate(numbers), np.concatenate(keys), np.concatenate(own)


_PLACES = "h1 long, h2 long, doc_id long, line int"


def _placed(identify, found):
    for batch in found:
        h1, h2, docs, numbers = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for i, line in enumerate(lines_of(text.as_py())):
                if line and not line.isspace():
                    a, b = identify(line)
                    h1.append(a)
                    h2.append(b)
                    docs.append(doc)
                    numbers.append(i)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((h1, h2, docs, numbers), kinds, strict=True)], ["h1", "h2", "doc_id", "line"])


def _keyed(names: Names, found):
    """(key, line, listed); a line that the task has just seen isn't listed again."""
    seen: set[int] = set()
    held: list[str] = []
    ids: list[int] = []
    size = 0

    def flush():
        if held:
            number, key, own = segment_keys(held)
            lines = np.array(ids, np.int64)[number]
            for a in range(0, len(key), 200_000):
                b = a + 200_000
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b].view(np.int64)), pa.array(lines[a:b]), pa.array(own[a:b])], ["key", "line", "listed"])

    for batch in found:
        for text in batch.column(1):
            for line in lines_of(text.as_py()):
                if len(line) < TENTH - 1 or line.isspace():
                    continue
                name = names(line)
                if name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                held.append(line)
                ids.append(name)
                size += len(line)
                if size > CHARS:
                    yield from flush()
                    held, ids, size = [], [], 0
    yield from flush()


_MET = "a long, b long, key long, listed boolean"


def _met(pairs_a, pairs_b, keys=(), listed=()) -> pa.RecordBatch:
    a, b = np.concatenate([*pairs_a, np.empty(0, np.int64)]), np.concatenate([*pairs_b, np.empty(0, np.int64)])
    blank = np.zeros(len(a), bool)
    blank[: len(a) - len(keys)] = True
    keys = np.concatenate([np.zeros(len(a) - len(keys), np.int64), np.asarray(keys, np.int64)])
    flags = np.concatenate([blank[: len(a) - len(listed)] & False, np.asarray(listed, bool)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(keys, mask=blank), pa.array(flags)], ["a", "b", "key", "listed"])


def _runs(found, n_columns: int):
    """Columns of sorted batches, in whole runs of the first column."""
    held = None
    for batch in found:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_columns)]
        if held is not None:
            now = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last:
            yield [c[:last] for c in now]
        held = [c[last:] for c in now]
    if held is not None and len(held[0]):
        yield held


def _bounds(key: np.ndarray):
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.append(starts[1:], len(key))


def _candidates(found):
    """Pairs of lines that meet at a key, at least one of them listed; of a crowded key, pairs with the first listed line
    and of neighbours, and the key's lines themselves."""
    for key, line, listed in _runs(found, 3):
        left, right, hot_keys, hot_lines, hot_listed = [], [], [], [], []
        starts, ends = _bounds(key)
        size = 0
        some = np.maximum.reduceat(listed.astype(np.int8), starts) > 0
        least, most = np.minimum.reduceat(line, starts), np.maximum.reduceat(line, starts)
        for i in np.flatnonzero(some & (least != most)).tolist():
            names, own = line[starts[i] : ends[i]], listed[starts[i] : ends[i]].astype(bool)
            listed_names = np.unique(names[own])
            others = np.setdiff1d(names, listed_names)
            if len(listed_names) + len(others) <= CROWDED:
                every = np.concatenate([listed_names, others])
                for n, one in enumerate(listed_names):
                    left.append(every[n + 1 :])
                    right.append(np.full(len(every) - n - 1, one))
                    size += len(every)
            else:
                every = np.concatenate([listed_names, others])
                left += [every[1:], every[1:]]
                right += [np.full(len(every) - 1, listed_names[0]), every[:-1]]
                hot_lines.append(every)
                hot_keys.append(np.full(len(every), key[starts[i]]))
                hot_listed.append(np.arange(len(every)) < len(listed_names))
                size += 3 * len(every)
            if size > 200_000:
                yield _met(left, right)
                left, right, size = [], [], 0
        yield _met(left, right)
        if hot_lines:
            yield _met(hot_lines, hot_lines, np.concatenate(hot_keys), np.concatenate(hot_listed))


def profile(line: str) -> bytes:
    """How many of the line's characters are of each of KINDS kinds, 255 meaning that or more. Characters that an edit
    adds or takes away change one count each, so the counts of alike lines differ by EDITS each at most."""
    kinds = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") % KINDS
    return np.minimum(np.bincount(kinds, minlength=KINDS), 255).astype(np.uint8).tobytes()


def _open_pairs(found):
    """Of crowded keys (key, line, component, listed, profile): pairs of unconnected lines, at least one listed, with
    near profiles. Lines are ordered by the count that varies most, and each meets those within EDITS of its own."""
    for key, line, component, listed, profiles in _runs(found, 5):
        starts, ends = _bounds(key)
        left, right, size = [], [], 0
        for a, b in zip(starts, ends, strict=True):
            counts = np.frombuffer(b"".join(profiles[a:b]), np.uint8).reshape(-1, KINDS).astype(np.int16)
            widest = int(np.argmax(np.ptp(counts, axis=0)))
            order = np.argsort(counts[:, widest], kind="stable")
            counts, names, own = counts[order], line[a:b][order], listed[a:b][order].astype(bool)
            _, at, n = np.unique(component[a:b][order], return_inverse=True, return_counts=True)
            largest, along = int(np.argmax(n)), counts[:, widest]
            low, high = np.searchsorted(along, along - EDITS, "left"), np.searchsorted(along, along + EDITS, "right")
            for i in np.flatnonzero(at != largest).tolist():
                near = np.arange(low[i], high[i])
                near = near[((at[near] == largest) | ((at[near] != at[i]) & (near > i))) & (own[near] | own[i])]
                near = near[np.abs(counts[near] - counts[i]).sum(axis=1) <= 2 * EDITS]
                left.append(np.full(len(near), names[i]))
                right.append(names[near])
                size += len(near)
            if size > 200_000:
                yield _met(left, right)
                left, right, size = [], [], 0
        yield _met(left, right)


def _contents(ids: DataFrame, n_ids: int, docs: DataFrame, names: Names) -> DataFrame:
    """(name, content) of the lines whose name is among ids; the texts come out of the documents."""

    def read(found):
        for batch in found:
            out: dict[str, int] = {}
            for text in batch.column(1):
                out.update((line, names(line)) for line in lines_of(text.as_py()) if len(line) >= TENTH - 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(out.values()), pa.int64()), pa.array(list(out), pa.string())], ["name", "content"])

    return only_ids(docs.mapInArrow(read, "name long, content string"), ids, n_ids, "name").dropDuplicates(["name"])


def _profiled(found):
    for batch in found:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([profile(x) for x in batch.column(1).to_pylist()], pa.binary())], ["node", "profile"])


def _verified(pairs: DataFrame, docs: DataFrame, names: Names, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of lines that are alike."""
    ids = scratch.keep(pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct(), "ids")
    n_ids = ids.count()
    if not n_ids:
        return pairs
    content = scratch.keep(_contents(ids, n_ids, docs, names), "content")

    def compare(found):
        for batch in found:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                most = allowed(max(len(x), len(y)))
                good.append(edit_distance(x, y, most) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (content.select(F.col("name").alias(n), F.col("content").alias(c)) for n, c in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def removed_lines(docs: DataFrame, scratch: Scratch, identify=line_id) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text). (places of all lines, places of those that go): h1, h2, doc_id, line (from 0). identify may be
    replaced in tests, to make halves of hashes meet."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = scratch.keep(docs.mapInArrow(partial(_placed, identify), _PLACES), "places")
    names = Names(identify, renamed(places, scratch))
    keyed = docs.mapInArrow(partial(_keyed, names), "key long, line long, listed boolean").repartition(shards, "key").sortWithinPartitions("key", "line")
    met = scratch.keep(keyed.mapInArrow(_candidates, _MET), "met")
    pairs = scratch.keep(met.where("key is null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    links = scratch.keep(_verified(pairs, docs, names, scratch), "links")
    joined = components(links, scratch)
    hot = met.where("key is not null").select("key", F.col("a").alias("node"), "listed")
    if not hot.isEmpty():
        hot = hot.join(joined, "node", "left").select("key", F.col("node").alias("line"), F.coalesce("component", "node").alias("component"), "listed")
        ids = scratch.keep(hot.select(F.col("line").alias("name")).distinct(), "crowded")
        profiles = scratch.keep(_contents(ids, ids.count(), docs, names).mapInArrow(_profiled, "node long, profile binary"), "profiles")
        hot = hot.join(profiles.withColumnRenamed("node", "line"), "line").select("key", "line", "component", "listed", "profile")
        more = hot.repartition(shards, "key").sortWithinPartitions("key", "line").mapInArrow(_open_pairs, _MET)
        more = scratch.keep(more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "open-pairs")
        second = scratch.keep(_verified(more, docs, names, scratch), "more-links")
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), scratch)
    lines = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    lines = lines.withColumn("name", F.col("h1"))
    if names.others:
        others = docs.sparkSession.createDataFrame([(*line, name) for line, name in names.others.items()], "h1 long, h2 long, other long")
        lines = lines.join(F.broadcast(others), ["h1", "h2"], "left").withColumn("name", F.coalesce("other", "h1")).drop("other")
    lines = lines.join(joined.withColumnRenamed("node", "name"), "name", "left")
    lines = scratch.keep(lines.where("n > 1 or component is not null"), "lines")
    groups = lines.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"))
    keepers = lines.join(groups, "component", "left").select("h1", "h2", F.coalesce("group_first", "first").alias("keep"))
    gone = places.join(keepers, ["h1", "h2"]).where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line")))
    return places, gone.select("h1", "h2", "doc_id", "line")


def dedup_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256, text (what stays; null if with_text is false).

    Lines end at line feeds. Of lines that are alike, over any number of steps, the first stays (smallest doc_id, then
    place in the document). Lines of white space alone stay. Null texts are empty: one line, nothing removed. Rows without
    doc_id are left out. Rows that repeat a doc_id are documents of their own, in order of their texts' SHA-256; rows that
    repeat both doc_id and text are one document, and get its result each.
    """
    scratch, docs = Scratch(docs.sparkSession, "lines"), texts(docs)
    docs, back = keyed(docs, scratch)
    _, gone = removed_lines(docs, scratch)
    gone = gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))

    def cut(found):
        for batch in found:
            n, removed, hashes, left = [], [], [], []
            for text, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines, gone = lines_of(text.as_py()), set(gone or ())
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                n.append(len(lines))
                removed.append(len(gone))
                hashes.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                left.append(kept if with_text else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_removed", "kept_sha256", "text"])

    found = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    return returned(found.mapInArrow(cut, "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string"), back)
