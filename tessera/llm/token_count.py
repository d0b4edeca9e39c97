"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with failure links: when a word can't go on from a node, the failure link says where the text
after the popped tokens stands in the trie, and a precomputed number says how many tokens were popped. A word of n bytes
takes O(n) steps, with no back-tracking and without making its pieces.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .tokens import byte_symbols

#: Different words whose counts a worker process keeps before it starts afresh.
CACHE_WORDS = 400_000


class LongestMatch:
    """count(word): tokens of the greedy longest-match segmentation of word, all of it; -1 if it has none."""

    def __init__(self, vocabulary):
        self.children: list[dict[int, int]] = [{}]
        self.token = [False]
        for entry in vocabulary:
            node = 0
            for b in entry:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(False)
                node = self.children[node][b]
            self.token[node] = node != 0
        n = len(self.children)
        #: where the rest of a node's string stands after its popped tokens (-1: nowhere), and how many were popped
        self.failure, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in self.children[u].items():
                    below.append(v)
                    if self.token[v]:
                        self.failure[v], self.popped[v] = 0, 1
                        continue
                    at, n_popped = self.failure[u], self.popped[u]
                    while at >= 0 and b not in self.children[at]:
                        n_popped += self.popped[at]
                        at = self.failure[at]
                    if at >= 0:
                        self.failure[v], self.popped[v] = self.children[at][b], n_popped
            level = below

    def count(self, word: bytes) -> int:
        children, failure, popped = self.children, self.failure, self.popped
        at = total = 0
        for b in word:
            while b not in children[at]:
                total += popped[at]
                at = failure[at]
                if at < 0:
                    return -1
            at = children[at][b]
        while at > 0:
            total += popped[at]
            at = failure[at]
        return total if at == 0 else -1


def word_pieces(path: str) -> tuple[list[bytes], bytes]:
    """(vocabulary, word mark) for greedy word pieces out of a byte-level vocabulary file: a piece that begins a word
    carries the mark, a space, in front; all single bytes are pieces, so each word has a segmentation."""
    symbols = byte_symbols()
    entries = [bytes(symbols[c] for c in token) for token in json.load(open(path))["model"]["vocab"]]
    return sorted({*entries, *(bytes([b]) for b in range(256))}), b" "


_LOADED: dict[str, tuple[LongestMatch, bytes, dict]] = {}


def _loaded(path: str):
    if path not in _LOADED:
        vocabulary, mark = word_pieces(path)
        _LOADED[path] = LongestMatch(vocabulary), mark, {}
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): words at ASCII white space, and greedy longest-match pieces of all words together.

    Null and empty texts have no words and 0 tokens. Rows without doc_id are left out; repeated rows give a row each.
    A word of any length takes time in proportion to it.
    """

    def run(found):
        automaton, mark, known = _loaded(path)
        for batch in found:
            words, sizes = [], []
            for text in batch.column(1).to_pylist():
                own = text.encode("utf-8", "surrogatepass").split()
                sizes.append(len(own))
                words += own
            counts = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            for i in np.flatnonzero(counts < 0).tolist():
                word = words[i]
                n = known.get(word)
                if n is None:
                    n = automaton.count(mark + word)
                    if len(word) <= 64:
                        known[word] = n
                counts[i] = n
            if len(known) > CACHE_WORDS:
                known.clear()
            n_words = np.array(sizes, np.int64)
            sums = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(n_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(sums[ends] - sums[ends - n_words])], ["doc_id", "n_words", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
