import random
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest

from tessera.llm import packing, token_count, token_store
from tessera.llm.common import Scratch
from tessera.llm.tokens import encoder

from .data import frame, texts

P = pytest.importorskip("public_tokenizers")
ODD = ["", "  a  b", "x \n y", "héllo WORLD's  I'm", "a\tb c", "　x", "日本語 テスト 한국어 한국", "é café ẍ", "İstanbul ΣΑΣ.", "a\x1cb c", "a\x85b \xa0c", "<|endoftext|> x", "😀😀 ok", "ǅ ß ẞ", "\x00 \x01a", "ﬁ ½ ²", "a" * 3000, "1234567 12 3.5e7", " lead", "trail ", "\n\nx\n\n\ny", "ͅa ϴ K", "𝐀𝟙 x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    made = encoder(P.path(name), 2)
    for text in ODD + [t for t in texts(8) if t]:
        assert made.encode(text).tolist() == made.plain.encode(text, add_special_tokens=False).ids + [2], text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_every_character(name):
    """All code points of the planes that have characters, some of the others, and random text over all planes."""
    made = encoder(P.path(name))
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    found = ["a" + c + "b" for c in every if ord(c) < 0x33000 or 0xE0000 <= ord(c) < 0xE0200 or ord(c) % 97 == 0]
    r = random.Random(6)
    found += ["".join(r.choice(every) if r.random() < 0.3 else chr(r.choice([32, 39, 65, 115, 0x300, 0x3B1])) for _ in range(r.randint(1, 30))) for _ in range(20_000)]
    for a in range(0, len(found), 100_000):
        part = found[a : a + 100_000]
        for text, want in zip(part, made.plain.encode_batch(part, add_special_tokens=False), strict=True):
            assert made.encode(text).tolist() == want.ids, ascii(text)


def test_packing_of_lengths():
    r = random.Random(4)
    for _ in range(60):
        capacity = r.choice([10, 37, 128])
        counts = Counter(r.randint(1, capacity) for _ in range(r.choice([1, 20, 500])))
        counts[r.randint(1, capacity)] += r.choice([0, 10_000])
        found = packing.pack_lengths(counts, capacity)
        assert Counter({n: sum(p.count(n) * t for p, t in found.items()) for n in counts}) == counts
        assert all(sum(p) <= capacity for p in found)
        assert sum(found.values()) <= sum(packing.best_fit_decreasing(counts, capacity).values())


def test_local_search_empties_bins():
    # best fit would have found better; the search must, by exchanges
    start = Counter({(6, 3): 1, (5, 4): 1, (2,): 1})
    assert sum(packing.local_search(start, 10).values()) == 2
    start = Counter({(7,): 1, (4, 4): 1, (3, 2): 1})
    assert sum(packing.local_search(start, 10).values()) == 2


def test_local_search_takes_up_all_bins():
    start = Counter({(7,): 200, (4, 4): 200, (3, 2): 200})
    assert sum(packing.local_search(start, 10).values()) == 400


def check_packed(rows, lengths, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    assert sum(lengths) <= len(sequences) * capacity
    return len(sequences)


def test_packed_documents(spark):
    capacity, made = 64, partial(encoder, P.path("byte_bpe_50k.json"), 2)
    found = texts(9, 150)
    rows = packing.pack_documents(frame(spark, found), made, capacity).collect()
    want = []
    for i, t in enumerate(found):
        ids = made().plain.encode(t or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % capacity or capacity
        edges = [0, *range(cut, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    n = check_packed(rows, [w[3] for w in want], capacity)
    assert n <= -(-sum(w[3] for w in want) // capacity) + 1
    assert packing.pack_documents(frame(spark, []), made, capacity).count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(5)
    for n, m in [(1, 1), (5, 3), (511, 2), (512, 50), (5000, 40_000), (70_000, 300)]:
        ids = (r.zipf(1.3, n) % m).astype(np.uint32)
        table = token_store.Frequencies(*np.unique(ids, return_counts=True))
        raw = token_store.encode_block(ids, table)
        assert token_store.decode_block(raw, n, table, table.slots()).tolist() == ids.tolist()
    assert len(raw) < 70_000 * 2
    broken = bytearray(raw)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_store.decode_block(bytes(broken), n, table, table.slots())


def test_store(spark):
    made = partial(encoder, P.path("word_bpe_49k.json"), 2)
    found = texts(10, 150)
    path = Scratch(spark, "t").root + "/store"
    token_store.write_store(frame(spark, found), path, made, 49_408)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, path).collect())
    want, start = [], 0
    for i, t in enumerate(found):
        ids = made().plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    token_store.write_store(frame(spark, []), path + "-empty", made, 49_408)
    assert token_store.read_store(spark, path + "-empty").count() == 0


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_longest_match():
    r = random.Random(6)
    for _ in range(40):
        vocabulary = {bytes(r.choices(b"abc", k=r.randint(1, 5))) for _ in range(12)} | ({b"a", b"b", b"c"} if r.random() < 0.7 else set())
        automaton = token_count.LongestMatch(vocabulary)
        for _ in range(60):
            word = bytes(r.choices(b"abc", k=r.randint(0, 14)))
            assert automaton.count(word) == greedy(word, vocabulary), (vocabulary, word)


def test_token_counts(spark):
    path = P.path("byte_bpe_50k.json")
    found = [*texts(11), "a" * 5000]
    vocabulary = set(token_count.word_pieces(path)[0])
    got = sorted(tuple(r) for r in token_count.token_counts(frame(spark, found), path).collect())
    words = [(t or "").encode().split() for t in found]
    assert got == [(i, len(w), sum(greedy(b" " + x, vocabulary) for x in w)) for i, w in enumerate(words)]
    assert token_count.token_counts(frame(spark, []), path).count() == 0
