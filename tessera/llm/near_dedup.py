"""MinHash near-dedup by an LSH forest.

A document's set holds its distinct k-word shingles (64-bit hashes). Equal sets are one class; only one of each class
goes on. A forest of TREES trees orders the classes: a tree's label is a list of keys of WIDTH min-hash values each, its
own key first and those of the next trees after it. Classes with one first key form a region of the tree.

1. In FIRST_TREES trees, rows sorted by label are paired with the neighbour of longest common prefix and with the
   smallest of their region and deeper regions. Verified links give components.
2. In all trees, the same among the regions that still hold several components; rows carry their sketches, and only
   pairs that these let through come out.
3. What is still open is settled: in each region, the rows outside its largest component are tested against each other
   and against that component's members. Few of them are compared by sketch in one task. Many are dealt into blocks, and
   each pair of blocks is compared in one task, by sketch and then on full sets, from which only links come out.

Every pair is filtered by an estimate far below the threshold and verified on its full sets. A pair of similarity 0.8
shares no region with probability (1 - 0.8^WIDTH)^TREES = 3e-6. Groups that are connected cost nothing in the third round,
however large; what stays open beside them costs its rows times the group's in comparisons of sketches, though not in rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, only_ids, sliced, texts
from .components import components
from .hashing import mix, separators, shingle_set, word_hashes

TREES, WIDTH, FIRST_TREES = 32, 5, 4
VALUES = TREES * WIDTH
#: Rows outside a region's largest component above which pairs are compared by blocks, and the rows of a block.
CROWDED, BLOCK = 64, 512
#: How far below the threshold the estimate of a pair may be (some five standard deviations at 0.8: one link in 10^5 at most).
SLACK = 0.15

_seeds = np.random.default_rng(20240229)
_XOR = _seeds.integers(0, 1 << 32, VALUES, np.uint32)[:, None]
_MULTIPLY = _seeds.integers(0, 1 << 31, VALUES, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_COMBINE = _seeds.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """VALUES min-hash values of a set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        part = x[None, a : a + 1024] ^ _XOR
        part *= _MULTIPLY
        np.minimum(least, part.min(axis=1), out=least)
    return least


def ascii_lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def sets_of(found: list[str], k: int):
    for words in word_hashes([ascii_lower(t) for t in found], separators()):
        yield shingle_set(words, k)


_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, prefixes array<long>, sketch binary"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(found):
        for batch in sliced(found):
            n, h1, h2, prefixes, sketches = [], [], [], [], []
            for s in sets_of(batch.column(1).to_pylist(), k):
                n.append(len(s))
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((whole >> 64) - (1 << 63))
                h2.append((whole & (1 << 64) - 1) - (1 << 63))
                if len(s):
                    values = min_hashes(s)
                    keys = mix((values.reshape(TREES, WIDTH).astype(np.uint64) * _COMBINE).sum(axis=1, dtype=np.uint64))
                    prefixes.append(keys.view(np.int64))
                    sketches.append((values >> np.uint32(24)).astype(np.uint8).tobytes())
                else:
                    prefixes.append([])
                    sketches.append(b"")
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, h1, h2)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "prefixes", "sketch"])

    return docs.mapInArrow(run, _SIGNED)


def _trees(classes: DataFrame, trees: int) -> DataFrame:
    """(prefix, tree, rep, comp, size, prefixes), a row for each tree of each class; prefixes of different trees differ."""
    rows = classes.select("rep", "comp", "size", F.posexplode(F.slice("prefixes", 1, trees) if trees < TREES else F.col("prefixes")).alias("tree", "prefix"), "prefixes")
    return rows.withColumn("prefix", F.col("prefix").bitwiseXOR(F.xxhash64("tree")))


def _label(depth: int) -> list:
    """The next trees' keys after a row's own."""
    return [F.element_at("prefixes", F.pmod(F.col("tree") + i, F.lit(TREES)).cast("int") + 1).alias(f"deeper{i}") for i in range(1, depth + 1)]


def _ordered(rows: DataFrame, shards: int) -> DataFrame:
    """rows (prefix, deeper1, deeper2, rep, comp, size, ...) in the order of their labels; a region may lie in several tasks."""
    order = ["prefix", "deeper1", "deeper2", "rep"]
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)


def _runs(found, n_columns: int):
    """Of sorted batches, the columns of each run of equal first column that holds several components (column "comp");
    runs may span batches."""
    held = None
    for batch in found:
        at = batch.schema.get_field_index("comp")
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_columns)]
        now = now if held is None else [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        yield from _whole_runs([c[:last] for c in now], at)
        held = [c[last:] for c in now]
    if held is not None:
        yield from _whole_runs(held, at)


def _whole_runs(columns, at: int):
    prefix, comp = columns[0], columns[at]
    if len(prefix) < 2:
        return
    starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
    least, most = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    ends = np.r_[starts[1:], len(prefix)]
    for i in np.flatnonzero(least != most).tolist():
        yield [c[starts[i] : ends[i]] for c in columns]


def _near_size(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    return denominator * np.minimum(x, y) >= numerator * np.maximum(x, y)


def _pairs(a, b) -> pa.RecordBatch:
    a, b = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _emit(chunks):
    """Pairs in batches of bounded size."""
    left, right, size = [], [], 0
    for a, b in chunks:
        left.append(a)
        right.append(b)
        size += len(a)
        if size > 200_000:
            yield _pairs(left, right)
            left, right, size = [], [], 0
    yield _pairs(left, right)


def _agree(sketches: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of rows of sketches, whether they agree often enough."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), 20_000):
        b = a + 20_000
        out[a:b] = (sketches[x[a:b]] == sketches[y[a:b]]).sum(axis=1) >= _least(threshold)
    return out


def _least(threshold: float) -> int:
    return int(np.floor(max(0.0, threshold - SLACK) * VALUES))


def _stacked(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, VALUES)


def linking_pairs(found, numerator: int, denominator: int, sketched: bool = False):
    """A few pairs of each row: with its neighbour in the order of labels, whose common prefix is the longest, and with the
    smallest rep of its region and of its deeper regions (an original mostly comes before its copies); of these, the ones
    that aren't connected yet. Rows with sketches give only pairs that agree."""

    def chunks():
        for _, one, two, rep, comp, size, *sketch in _runs(found, 7 if sketched else 6):
            rows = np.arange(len(rep))
            heads = [np.full(len(rep), int(np.argmin(rep)))]
            fresh = np.r_[True, one[1:] != one[:-1]]
            for level in (fresh, fresh | np.r_[True, two[1:] != two[:-1]]):
                starts = np.flatnonzero(level)
                least = np.minimum.reduceat(rep, starts)
                where = np.flatnonzero(rep == np.repeat(least, np.diff(np.r_[starts, len(rep)])))
                heads.append(where[np.cumsum(level) - 1])
            every = _stacked(sketch[0]) if sketched else None
            for other in (*heads, np.maximum(rows - 1, 0)):
                x = np.flatnonzero((comp != comp[other]) & _near_size(size, size[other], numerator, denominator))
                if sketched:
                    x = x[_agree(every, x, other[x], numerator / denominator)]
                yield rep[x], rep[other[x]]

    return _emit(chunks())


def _beside(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows with the columns that table has for their key: a broadcast where table is small, else a join whose skew is dealt anew."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_IDS // 4 else table, key)


def several(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (prefix, comp, ...) of the regions that hold several components; grouped over whole regions, wherever their
    rows lie."""
    found = scratch.keep(rows.groupBy("prefix").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("prefix"), "several")
    return scratch.keep(only_ids(rows, found, found.count(), "prefix"), "inside")


def open_rows(inside: DataFrame, scratch: Scratch) -> DataFrame:
    """Of regions that hold several components, the rows outside the largest one: prefix, tree, rep, comp, size, largest
    (null where each component has one row), n_rest and n_comps (rows and components outside the largest).

    Everything about a region is a grouped aggregate over all its rows, wherever they lie."""
    held = inside.groupBy("prefix", "comp").agg(F.count("*").alias("n"))
    regions = held.groupBy("prefix").agg(F.max(F.struct("n", (-F.col("comp")).alias("comp"))).alias("most"), F.sum("n").alias("n"), F.count("*").alias("n_comps"))
    found = F.col("most.n") > 1
    regions = regions.select(
        "prefix", F.when(found, -F.col("most.comp")).alias("largest"), (F.col("n") - F.when(found, F.col("most.n")).otherwise(0)).alias("n_rest"), (F.col("n_comps") - found.cast("long")).alias("n_comps")
    )
    rest = _beside(inside, scratch.keep(regions, "regions"), "prefix").where(F.col("largest").isNull() | (F.col("comp") != F.col("largest")))
    return scratch.keep(rest, "rest")


def small_pairs(rest: DataFrame, sketches: DataFrame, shards: int, numerator: int, denominator: int) -> DataFrame:
    """In each region that isn't crowded, the pairs of rows of different components whose sketches agree."""

    def chunks(found):
        for _, rep, comp, size, sketch in _runs(found, 5):
            x, y = np.nonzero(np.tri(len(rep), k=-1, dtype=bool) & (comp[:, None] != comp) & _near_size(size[:, None], size, numerator, denominator))
            good = _agree(_stacked(sketch), x, y, numerator / denominator)
            yield rep[x[good]], rep[y[good]]

    rows = rest.where((F.col("n_rest") <= CROWDED) & (F.col("n_comps") > 1)).join(sketches, "rep").select("prefix", "rep", "comp", "size", "sketch")
    return rows.repartition(shards, "prefix").sortWithinPartitions("prefix", "rep").mapInArrow(lambda found: _emit(chunks(found)), "a long, b long")


def crowded_links(rest: DataFrame, forest: DataFrame, docs: DataFrame, k: int, numerator: int, denominator: int, scratch: Scratch) -> DataFrame:
    """Links of rows of different components in crowded regions. The rows are dealt into blocks, and each pair of blocks
    is compared in one task, by sketch and then on full sets; only links come out. Rows that share several regions are
    compared in the first."""
    rest = rest.where((F.col("n_rest") > CROWDED) & (F.col("n_comps") > 1)).select("prefix", "tree", "rep", "comp", "n_rest")
    if rest.isEmpty():
        return rest.select(F.col("rep").alias("a"), F.col("comp").alias("b"))
    n = F.ceil(F.col("n_rest") / BLOCK)
    rows = rest.withColumn("own", F.pmod(F.xxhash64("rep"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    pair = (F.xxhash64("prefix", F.least("own", "other"), F.greatest("own", "other"))).alias("block")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side")
    dealt = scratch.keep(rows.select(pair, side, "tree", "rep", "comp"), "crowded")
    ids = scratch.keep(rest.select(F.col("rep").alias("doc_id")).distinct(), "crowded-ids")
    signed = only_ids(forest.withColumnRenamed("rep", "doc_id"), ids, ids.count()).select("doc_id", "prefixes", "sketch")
    sets = scratch.keep(_sets(ids, docs, k, scratch).join(signed, "doc_id"), "crowded-sets")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(sets, dealt["rep"] == sets["doc_id"]).select("block", "side", "tree", "rep", "comp", "prefixes", "sketch", "shingles")
    rows = rows.repartition(shards, "block").sortWithinPartitions("block")
    least = _least(numerator / denominator)

    def compare(found):
        held: list[tuple] = []
        now = None
        for batch in found:
            for row in zip(*batch.columns, strict=True):
                if row[0].as_py() != now:
                    yield _linked_blocks(held, least, numerator, denominator)
                    held, now = [], row[0].as_py()
                held.append((*(x.as_py() for x in row[1:6]), np.frombuffer(row[6].as_buffer(), np.uint8), np.frombuffer(row[7].as_buffer(), np.uint64)))
        yield _linked_blocks(held, least, numerator, denominator)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _linked_blocks(held, least: int, numerator: int, denominator: int) -> pa.RecordBatch:
    """Links between the rows of a pair of blocks (sides 1 and 2), or within one block (side 0). held: (side, tree, rep,
    comp, prefixes, sketch, shingles)."""
    left, right = [], []
    one, two = [x for x in held if x[0] != 2], [x for x in held if x[0] != 1]
    if one and two:
        tree = held[0][1]
        reps, comps, sizes = (np.array(x) for x in zip(*((x[2], x[3], len(x[6])) for x in two), strict=True))
        prefixes, sketches = np.array([x[4][: tree + 1] for x in two]), np.stack([x[5] for x in two])
        for side, _, rep, comp, own_prefixes, sketch, own in one:
            good = (comps != comp) & _near_size(sizes, len(own), numerator, denominator)
            if side == 0:
                good &= reps < rep
            good &= (prefixes[:, tree] == own_prefixes[tree]) & ~(prefixes[:, :tree] == np.array(own_prefixes[:tree], np.int64)).any(axis=1)
            at = np.flatnonzero(good)
            at = at[(sketches[at] == sketch).sum(axis=1) >= least]
            at = at[_similar(own, [two[i][6] for i in at], numerator, denominator)]
            left.append(np.full(len(at), rep))
            right.append(reps[at])
    return _pairs(left, right)


def tested(tests: DataFrame, members: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, numerator: int, denominator: int, scratch: Scratch) -> DataFrame:
    """Links of rows with members of components: tests (rep, comp), members (rep, comp). Both sides of a component are dealt
    into blocks, and each pair of blocks is compared in one task, by sketch and then on full sets, so that rows grow with
    the blocks and not with the pairs; only links come out."""
    if tests.isEmpty():
        return tests.select(F.col("rep").alias("a"), F.col("comp").alias("b"))
    tests = scratch.keep(tests, "tests")
    n_tests = tests.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("n_tests"))
    sizes = scratch.keep(members.join(n_tests, "comp").groupBy("comp", "n_tests").agg(F.ceil(F.count("*") / BLOCK).alias("n_members")), "sizes")
    block = lambda n: F.pmod(F.xxhash64("rep"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = tests.join(sizes, "comp").select("comp", "rep", block("n_tests").alias("x"), spread("n_members").alias("y"), F.lit(True).alias("test"))
    two = members.join(sizes, "comp").select("comp", "rep", spread("n_tests").alias("x"), block("n_members").alias("y"), F.lit(False).alias("test"))
    dealt = scratch.keep(one.unionByName(two).withColumn("block", F.xxhash64("comp", "x", "y")).select("block", "rep", "test"), "dealt")
    sets = _sets(dealt.select(F.col("rep").alias("doc_id")), docs, k, scratch).join(sketches.withColumnRenamed("rep", "doc_id"), "doc_id")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(sets, dealt["rep"] == sets["doc_id"]).select("block", "rep", "test", "sketch", "shingles").repartition(shards, "block").sortWithinPartitions("block")
    least = _least(numerator / denominator)

    def compare(found):
        held: list[tuple] = []
        now = None
        for batch in found:
            for key, rep, test, sketch, shingles in zip(*batch.columns, strict=True):
                if key.as_py() != now:
                    yield _linked(held, least, numerator, denominator)
                    held, now = [], key.as_py()
                held.append((rep.as_py(), test.as_py(), np.frombuffer(sketch.as_buffer(), np.uint8), np.frombuffer(shingles.as_buffer(), np.uint64)))
        yield _linked(held, least, numerator, denominator)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _linked(held, least: int, numerator: int, denominator: int) -> pa.RecordBatch:
    """Links between the tests and the members of one pair of blocks. held: (rep, test, sketch, shingles)."""
    members, left, right = [x for x in held if not x[1]], [], []
    if members:
        reps, sizes, sketches = np.array([x[0] for x in members]), np.array([len(x[3]) for x in members]), np.stack([x[2] for x in members])
        for rep, test, sketch, own in held:
            at = np.flatnonzero(_near_size(sizes, len(own), numerator, denominator)) if test else ()
            if len(at):
                at = at[(sketches[at] == sketch).sum(axis=1) >= least]
                at = at[_similar(own, [members[i][3] for i in at], numerator, denominator)]
                left.append(np.full(len(at), rep))
                right.append(reps[at])
    return _pairs(left, right)


def _similar(own: np.ndarray, others: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Whether own and each of the other (not empty) sets are to be linked."""
    if not others:
        return np.empty(0, bool)
    every, sizes = np.concatenate(others), np.array([len(x) for x in others])
    where = np.minimum(np.searchsorted(own, every), len(own) - 1)
    shared = np.add.reduceat((own[where] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return denominator * shared >= numerator * (sizes + len(own) - shared)


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches (a byte of each min-hash value) agree often enough."""

    def run(found):
        for batch in found:
            if not batch.num_rows:
                continue
            x, y = (_stacked(batch.column(i).to_pylist()) for i in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= _least(threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    one = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    two = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(doc_id, shingles) of the documents with these ids, shingles being sorted 64-bit hashes; written."""
    ids = scratch.keep(ids.distinct(), "ids")

    def shingle(found):
        for batch in sliced(found):
            sets = [s.tobytes() for s in sets_of(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return scratch.keep(only_ids(docs, ids, ids.count()).select("doc_id", "text").mapInArrow(shingle, "doc_id long, shingles binary"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, k: int, numerator: int, denominator: int, scratch: Scratch) -> DataFrame:
    """The pairs with denominator * intersection >= numerator * union of their full sets."""
    sets = _sets(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), docs, k, scratch)

    def compare(found):
        for batch in sliced(found, 2):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(denominator * shared >= numerator * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    Texts are lower-cased (A-Z) and split at ASCII white space; a document with fewer than k words is one shingle; one
    without words has an empty set and is linked with nothing. Documents are linked when
    denominator * intersection >= numerator * union. class_id: the smallest doc_id of equal set; component_id: the
    smallest reachable one; kept: doc_id = component_id. Rows without doc_id are left out; rows that repeat a doc_id
    get a row each. Any number of links is followed; which pairs are tested, and what may be missed, stands above.
    """
    spark = docs.sparkSession
    scratch, docs = Scratch(spark, "near"), texts(docs)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = scratch.keep(signatures(docs, k), "signatures")
    full = signed.where("n_shingles > 0")
    classes = scratch.keep(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    forest = scratch.keep(full.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "prefixes", "sketch"), "forest")
    sketches = forest.select("rep", "sketch")
    alone = forest.select("rep", F.col("rep").alias("comp"), "size", "prefixes")
    linking = partial(linking_pairs, numerator=numerator, denominator=denominator)
    check = partial(verified, docs=docs, k=k, numerator=numerator, denominator=denominator, scratch=scratch)

    def connected(joined, rows, key="comp"):
        """The rows with their present component."""
        return rows.drop(key).join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn(key, F.coalesce("component", "rep")).drop("component")

    def join_more(joined, more):
        if more.isEmpty():
            return joined
        # what was connected before counts as one node
        return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)

    first = _ordered(_trees(alone, FIRST_TREES).select("prefix", *_label(2), "rep", "comp", "size"), shards).mapInArrow(linking, "a long, b long")
    first = scratch.keep(first.where("a != b").distinct(), "pairs")
    joined = components(scratch.keep(check(scratch.keep(likely(first, sketches, numerator / denominator), "likely")), "links"), scratch)

    rows = _trees(connected(joined, alone).select("rep", "comp", "size", "prefixes"), TREES)
    inside = several(rows.select("prefix", F.col("tree").cast("long").alias("tree"), *_label(2), "rep", "comp", "size"), scratch)
    second = _ordered(inside.select("prefix", "deeper1", "deeper2", "rep", "comp", "size").join(sketches, "rep").select("prefix", "deeper1", "deeper2", "rep", "comp", "size", "sketch"), shards)
    second = scratch.keep(second.mapInArrow(partial(linking, sketched=True), "a long, b long").distinct(), "pairs")
    joined = join_more(joined, scratch.keep(check(second), "links"))

    rest = open_rows(several(connected(joined, inside.drop("deeper1", "deeper2")).select("prefix", "tree", "rep", "comp", "size"), scratch), scratch)
    third = scratch.keep(small_pairs(rest, sketches, shards, numerator, denominator).distinct(), "pairs")
    third = scratch.keep(check(third), "links").unionByName(scratch.keep(crowded_links(rest, forest, docs, k, numerator, denominator, scratch), "crowded-links"))
    tests = rest.where("largest is not null").select("rep", F.col("largest").alias("comp")).distinct()
    members = joined.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    third = third.unionByName(scratch.keep(tested(tests, members, sketches, docs, k, numerator, denominator, scratch), "tested"))
    joined = join_more(joined, third)
    found = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    found = found.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    class_id = F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", class_id.alias("class_id"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The documents, all columns, one of each component: the one of smallest doc_id."""
    scratch = Scratch(docs.sparkSession, "near-drop")
    gone = scratch.keep(near_groups(docs, k, numerator, denominator).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
