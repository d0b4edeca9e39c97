"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits or of non-ASCII characters, lower-cased. The benchmark comes in blocks of
bounded size; for each block the documents are read once, and runs of MIN_TILE words that also stand in an item (the
shared seeds) make a pair of document and item a candidate. A candidate is tiled: the longest matches of words not
yet marked, found by running Karp-Rabin hashing, are marked again and again until none has MIN_TILE words. A document is
contaminated by an item when the tiles cover enough of the item, in whatever order its parts come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, sliced, texts
from .hashing import powers, range_hashes, separators, windows, word_hashes

MIN_TILE, COVERAGE = 5, 0.6
#: Items and characters of one block; a block is what a task holds of the benchmark.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
_BETWEEN = separators(b"0123456789abcdefghijklmnopqrstuvwxyz")


def words_of(found: list[str]):
    return word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in found], _BETWEEN)


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length) of greedy string tiling: of what is unmarked, the longest common
    runs of at least ``least`` words are marked, those of one length by ascending start in the pattern, each with the
    first free start in the text; and so on with what is left.

    The greatest length comes by bisection (a run of n words has runs of n - 1), where windows of one length meet by
    Karp-Rabin hashes that run along the words; matches are compared word by word. A round costs the length of both
    sides times its logarithm, however often words repeat."""
    free_p, free_t, tiles = np.ones(len(pattern), bool), np.ones(len(text), bool), []
    hashed_p, hashed_t = _running(pattern), _running(text)
    longest = min(len(pattern), len(text))
    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if _meeting(hashed_p, free_p, hashed_t, free_t, n)[0].size else (low, n - 1)
        longest = low
        if longest < least:
            break
        own, keys = _meeting(hashed_p, free_p, hashed_t, free_t, longest)
        places = _unmarked(free_t, longest)
        hashes = range_hashes(hashed_t, places, places + longest)
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        first, end = np.searchsorted(hashes, keys, "left"), np.searchsorted(hashes, keys, "right")
        at = dict(zip(keys.tolist(), first.tolist(), strict=True))  # of each hash, the first place that may be free
        for i, key, stop in zip(own.tolist(), keys.tolist(), end.tolist(), strict=True):
            if not free_p[i : i + longest].all():
                continue
            while at[key] < stop and not free_t[places[at[key]] : places[at[key]] + longest].all():
                at[key] += 1
            for j in places[at[key] : stop].tolist():
                if free_t[j : j + longest].all() and np.array_equal(pattern[i : i + longest], text[j : j + longest]):
                    free_p[i : i + longest] = free_t[j : j + longest] = False
                    tiles.append((i, j, longest))
                    break
        longest -= 1  # what overlapped a tile may still match beside it
    return tiles


def _running(words: np.ndarray) -> np.ndarray:
    """Prefix sums from which each window's hash follows."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words))[0][: len(words)], out=out[1:])
    return out


def _unmarked(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of so many unmarked words."""
    if len(free) < size:
        return np.empty(0, np.int64)
    run = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(run[size:] - run[:-size] == size)


def _meeting(hashed_p, free_p, hashed_t, free_t, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the pattern, hashes) of the unmarked windows of this size whose hash an unmarked one of the text has."""
    own, there = _unmarked(free_p, size), _unmarked(free_t, size)
    keys = range_hashes(hashed_p, own, own + size)
    met = np.isin(keys, range_hashes(hashed_t, there, there + size))
    return own[met], keys[met]


class Block:
    """Items, and the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.ids = [i for i, _ in items]
        self.words = [w.copy() for w in words_of([t for _, t in items])]
        self.least = least
        seeds, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, words in enumerate(self.words):
            for k in {min(least, len(words))} - {0}:
                found = np.unique(windows(words, k))
                seeds.append(found)
                owners.append(np.full(len(found), i))
        seed, owner = np.concatenate(seeds), np.concatenate(owners)
        order = np.lexsort((owner, seed))
        self.seeds, self.owners = seed[order], owner[order]
        self.sizes = sorted({min(least, len(w)) for w in self.words} - {0})
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.seeds >> np.uint64(44)] = True

    def hits(self, words: np.ndarray):
        """{item: starts of seeds in words}."""
        out: dict[int, set[int]] = {}
        for k in self.sizes:
            found = windows(words, k)
            maybe = np.flatnonzero(self.sieve[found >> np.uint64(44)])
            for at in maybe.tolist():
                a, b = np.searchsorted(self.seeds, found[at], "left"), np.searchsorted(self.seeds, found[at], "right")
                for item in self.owners[a:b].tolist():
                    out.setdefault(item, set()).update(range(at, at + k))
        return out

    def covered(self, words: np.ndarray, item: int, places: set[int]) -> tuple[int, int]:
        """(tiles, words of the item that they cover). Only words within seeds can be in a tile."""
        at = np.array(sorted(places))
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        text = np.insert(words[at], gaps, 0)  # 0 stands for what lies between
        target = self.words[item]
        tiles = greedy_tiles(target, text, min(self.least, len(target)))
        return len(tiles), sum(n for _, _, n in tiles)


def _blocks(benchmark: DataFrame):
    items, size = [], 0
    for row in benchmark.toLocalIterator():
        items.append((row[0], row[1]))
        size += len(row[1])
        if len(items) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield items
            items, size = [], 0
    if items:
        yield items


_FOUND = "doc_id long, item_id long, n_tiles long, covered long, item_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_words) of each document and item whose tiles cover at least ``coverage``
    of the item's words.

    An item of fewer than ``least`` words must occur whole. Items without words, or null, match nothing; documents
    without words are matched by nothing. Rows without doc_id or item_id are left out. Repeated rows give a row each.
    """
    scratch, docs = Scratch(docs.sparkSession, "decontaminate"), texts(docs)
    context = docs.sparkSession.sparkContext
    parts = []
    for items in _blocks(texts(benchmark, key="item_id")):
        shared = context.broadcast(Block(items, least))

        def run(found, shared=shared):
            block = shared.value
            for batch in sliced(found):
                out = []
                for doc, words in zip(batch.column(0).to_pylist(), words_of(batch.column(1).to_pylist()), strict=True):
                    for item, places in sorted(block.hits(words).items()):
                        n, total = len(block.words[item]), len(places)
                        if total < coverage * n:
                            continue
                        tiles, total = block.covered(words, item, places)
                        if total >= coverage * n:
                            out.append((doc, block.ids[item], tiles, total, n))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_tiles", "covered", "item_words"])

        parts.append(scratch.keep(docs.mapInArrow(run, _FOUND), "found"))
        shared.unpersist()
    if not parts:
        return docs.sparkSession.createDataFrame([], _FOUND)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    scratch = Scratch(docs.sparkSession, "decontaminate-drop")
    gone = scratch.keep(contaminated(docs, benchmark, coverage, least).select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
