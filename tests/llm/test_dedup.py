import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from tessera.llm.common import Scratch
from tessera.llm.components import components

from .data import frame, texts


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (300, 300)]
    found = rows(components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")), "node", "component")
    assert found == [(i, 0) for i in range(41)] + [(100, 100), (200, 100), (300, 100)]
    assert rows(components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")), "node", "component") == []


@pytest.mark.parametrize("digest", [exact_dedup.digest_of, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))])
def test_exact(spark, digest):
    found = texts()
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in found]
    first, count = {}, defaultdict(int)
    for i, t in enumerate(normal):
        first.setdefault(t, i)
        count[t] += 1
    want = [(i, first[t], count[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(normal)]
    got = exact_dedup.exact_groups(frame(spark, found), digest)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.drop_copies(frame(spark, found))
    assert kept.columns == frame(spark, found).columns
    assert rows(kept, "doc_id") == [(w[0],) for w in want if w[3]]


def test_merge_index(spark):
    """Runs, levels and filters against a dictionary: whatever the batches, each digest once with least id and count."""
    r = random.Random(5)
    batches = [[(r.randrange(3000).to_bytes(2, "big"), r.randrange(10**6)) for _ in range(n)] for n in (900, 0, 1500, 1, 700, 1200, 300)]
    index, want = exact_dedup.MergeIndex(Scratch(spark, "test-index")), {}
    for batch in batches:
        index.add(spark.createDataFrame(batch, "digest binary, doc_id long").repartition(3))
        for d, i in batch:
            want[d] = (min(want.get(d, (i, 0))[0], i), want.get(d, (i, 0))[1] + 1)
        assert all(len(level) < exact_dedup.FANOUT for level in index.levels)
    assert [len(level) for level in index.levels] == [0, 1, 1]  # six runs that aren't empty
    got = [(bytes(d), k, n) for d, k, n in rows(index.compact(), "digest", "keep_id", "n")]
    assert got == sorted((d, *v) for d, v in want.items())


@pytest.mark.parametrize("bitmaps", [exact_dedup.BROADCAST_BITMAPS, 0])
def test_filter(spark, monkeypatch, bitmaps):
    """A filter lets all of its run's digests through and few others, broadcast or joined."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_BITMAPS", bitmaps)
    entries = spark.range(20_000).selectExpr("unhex(sha2(string(id), 256)) AS digest", "id AS keep_id", "1L AS n")
    run = exact_dedup.Run(Scratch(spark, "test-filter"), entries.where("keep_id < 10000"), "run")
    hit = {r.keep_id for r in run.probed(entries).where("hit").collect()}
    assert hit >= set(range(10_000)) and len(hit) < 10_000 + 10_000 // exact_dedup.FILTER_BITS * 1.2


def brute_sets(found, k):
    out = []
    for t in found:
        w = (t or "").encode().lower().split()
        out.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, k):
    found = texts(2, 200)
    sets, u = brute_sets(found, k), Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                u.join(i, j)
    want = [(i, len(s), u.find(i), u.find(i) == i) for i, s in enumerate(sets)]
    assert sum(not w[3] for w in want) > 20
    assert rows(near_dedup.near_groups(frame(spark, found), k), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_group(spark):
    """A crowded region: copies that differ in a word each, and one that only one of them leads to."""
    base = [f"w{i}" for i in range(60)]
    found = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(f"other{i}" for i in range(9))]
    got = rows(near_dedup.near_groups(frame(spark, found * 2), 2), "doc_id", "component_id", "class_id")
    sets, u = brute_sets(found * 2, 2), Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                u.join(i, j)
    assert got == [(i, u.find(i), i % 61) for i in range(122)]


def family(n):
    """Pairs of documents that share 0.804 with each other and 0.78 with all others."""
    common = [f"c{i}" for i in range(178)]
    out = []
    for i in range(n):
        both = [f"p{i}-{j}" for j in range(3)]
        out += [" ".join([*common, *both, *(f"q{i}{side}-{j}" for j in range(22))]) for side in "ab"]
    random.Random(n).shuffle(out)
    return out


def brute_near(found, k):
    sets, u = brute_sets(found, k), Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                u.join(i, j)
    return [(i, u.find(i)) for i in range(len(found))]


def test_near_in_crowded_regions(spark):
    """Far over 48 components in the regions that a pair shares, and nothing else connects the pairs."""
    found = family(300)
    want = brute_near(found, 1)
    assert len({w[1] for w in want}) == 300
    assert rows(near_dedup.near_groups(frame(spark, found), 1), "doc_id", "component_id") == want


def test_near_in_cut_regions(spark):
    """Regions of 48 components or fewer, each lying in many tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        found = family(20)
        assert rows(near_dedup.near_groups(frame(spark, found), 1), "doc_id", "component_id") == brute_near(found, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_long_and_empty(spark):
    long = " ".join(f"word{i}" for i in range(300_000))
    got = rows(near_dedup.near_groups(frame(spark, [long, long + " z", "", None]), 2), "doc_id", "n_shingles", "component_id")
    assert got == [(0, 299_999, 0), (1, 300_000, 0), (2, 0, 2), (3, 0, 3)]
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = np.random.default_rng(1)
    for _ in range(4000):
        a = "".join(r.choice(list("ab"), r.integers(0, 12)))
        b = "".join(r.choice(list("ab"), r.integers(0, 12)))
        for most in range(4):
            assert line_dedup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1), (a, b, most)
    long = "".join(r.choice(list("abcd"), 70_000))
    assert line_dedup.edit_distance(long, "x" + long[:-1] + "y", 2) == 2
    assert line_dedup.edit_distance(long, long[:50] + long[51:69_000] + "q" + long[69_000:], 2) == 2


def brute_lines(found):
    lines = [(i, j, x) for i, t in enumerate(found) for j, x in enumerate((t or "").split("\n"))]
    names = sorted({x for _, _, x in lines if x.strip()})
    u = Union()
    for i, a in enumerate(names):
        for b in names[:i]:
            most = min(2, max(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and most and levenshtein(a, b) <= most:
                u.join(a, b)
    seen, gone = set(), defaultdict(set)
    for i, j, x in lines:
        if x.strip():
            if u.find(x) in seen:
                gone[i].add(j)
            seen.add(u.find(x))
    out = []
    for i, t in enumerate(found):
        own = (t or "").split("\n")
        out.append((i, len(own), len(gone[i]), hashlib.sha256("\n".join(x for j, x in enumerate(own) if j not in gone[i]).encode()).hexdigest()))
    return out


def test_lines(spark):
    found = texts(4, 80)
    got = rows(line_dedup.dedup_lines(frame(spark, found)), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == brute_lines(found)


def test_lines_whose_names_meet(spark):
    """First halves of 4 bits: all but 16 lines get names of their own, and nothing else changes."""

    def identify(line):
        h = int.from_bytes(hashlib.md5(line.encode()).digest()[:8], "big") >> 1
        return h % 16, h

    found = texts(6, 60)
    docs = frame(spark, found).where("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') AS text")
    places, gone = line_dedup.removed_lines(docs, Scratch(spark, "test-names"), identify)
    named = line_dedup.renamed(places, Scratch(spark, "test-names"))
    assert len(named) == len(set(named.values())) > 16 and not set(named.values()) & set(range(16))
    n_gone = defaultdict(int)
    for (doc,) in rows(gone, "doc_id"):
        n_gone[doc] += 1
    assert [(d, n_gone[d]) for d, *_ in brute_lines(found)] == [(d, n) for d, _, n, _ in brute_lines(found)]


def test_profiles_of_alike_lines_are_near():
    rng = random.Random(5)
    for _ in range(300):
        line = "".join(rng.choice("abcde é中\x00") for _ in range(rng.randint(0, 40))) + "z" * rng.choice([0, 300])
        other = list(line)
        for _ in range(line_dedup.EDITS):
            at = rng.randint(0, len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        apart = [abs(x - y) for x, y in zip(line_dedup.profile(line), line_dedup.profile("".join(other)), strict=True)]
        assert max(apart) <= line_dedup.EDITS and sum(apart) <= 2 * line_dedup.EDITS


def test_crowded_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWDED", 5)
    stem = "the same long beginning of a line that many others share "
    found = [stem + "".join(chr(97 + (i * k) % 26) for k in range(1, 12)) for i in range(26)] + [stem + "aaaaaaaaaab", stem + "bdfhjlnprtx"]
    got = rows(line_dedup.dedup_lines(frame(spark, found)), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == brute_lines(found)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def brute_repeats(found, length):
    first, out = {}, []
    for i, t in enumerate(found):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if raw[j : j + length] in first:
                gone[j : j + length] = b"\1" * length
            first.setdefault(raw[j : j + length], 1)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "seed"), [(100, 48, 5), (20, 8, 6), (12, 5, 7)])
def test_repeats(spark, length, gram, seed):
    found = [*texts(seed, 150), "y" * 700, "z" + "y" * 650, "ab" * 300, "ba" * 200]
    got = rows(substring_dedup.remove_repeats(frame(spark, found), length, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(found, length)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_of_ids(spark):
    """Rows of one doc_id are documents in order of their digests; rows that repeat id and text are one document."""
    r = random.Random(1)
    w = "".join(r.choice("abcdefgh") for _ in range(150))
    found = [(1, w), (1, "q" + w), (2, w), (2, w), (3, "z" * 20), (None, w), (4, None)]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    first, second = sorted((w, "q" + w), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    left = "q" if second[0] == "q" else ""
    want = [(1, 151 if left else 150, 150), (1, 150 if left else 151, 0), (2, 150, 150), (2, 150, 150), (3, 20, 0), (4, 0, 0)]
    got = substring_dedup.remove_repeats(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed") == sorted(want)
    assert {bytes(r["kept"]) for r in got.collect()} == {first.encode(), left.encode(), b"", b"z" * 20}


def test_repeats_in_long_text(spark):
    r = np.random.default_rng(2)
    part = "".join(r.choice(list("abcdefgh "), 1_200_000))
    found = [part, "q" + part[500_000:1_100_000], part[3:50] + part]
    got = rows(substring_dedup.remove_repeats(frame(spark, found)), "doc_id", "n_removed", "n_spans")
    assert got == [(0, 0, 0), (1, 600_000, 1), (2, 1_200_000, 1)]


def test_suffix_order():
    r = np.random.default_rng(3)
    chars = r.integers(97, 99, 5000).astype(np.uint8)
    at, group = r.integers(0, 4900, 600), np.sort(r.integers(0, 9, 600))
    order = substring_dedup.suffix_order(chars, substring_dedup.prefix_hashes(chars), at, group, 30)
    assert order.tolist() == sorted(range(600), key=lambda i: (group[i], chars[at[i] : at[i] + 30].tobytes(), i))
