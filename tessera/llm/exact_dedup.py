"""Exact dedup with a log-structured merge index, in DataFrame operations only.

Rows come in batches of memtables (a memtable is what one input task reads). Each batch flushes a run: its distinct
digests, sorted in each file, with the smallest identifier and the count of each. Two runs of a level are merged into
one of the next. A run has a filter, a bitmap over hashes of its digests: a merge probes each run's entries against the
other's filter, carries on those that the other can't hold, and groups only the hits, of which the smallest identifier
stays. Digests with several rows in the last run are verified on their bytes: the normalised texts of their rows are
grouped by digest and text, so digests that stand for more than one text are found and resolved by text. Grouping
combines within tasks first, so a text that a third of all rows share costs no task more than a row of each other task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts

#: Digests with several rows that may be broadcast to the rows: some 100 bytes each in memory, 20 MB in all.
BROADCAST_DIGESTS = 200_000
#: Batches of memtables, each of which flushes a run; runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 2
#: A filter has at least so many bits an entry, with one hash: at most a sixteenth of the entries are probed in vain.
FILTER_BITS = 16
#: Bits of one bitmap of a filter (Spark's bitmap functions fix them; 4 KB), and bitmaps that may be broadcast: 16 MB.
BITMAP_BITS, BROADCAST_BITMAPS = 1 << 15, 1 << 12


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Run:
    """Sorted entries (digest, keep_id, n), each digest once, and a filter of them."""

    def __init__(self, scratch: Scratch, entries: DataFrame, name: str):
        ordered = entries.select("digest", "keep_id", "n").sortWithinPartitions("digest")
        self.scratch, (self.entries, self.path) = scratch, scratch.write(ordered, name)
        self.size = self.entries.count()  # from the files' footers
        self.bits = max(BITMAP_BITS, 1 << (FILTER_BITS * max(self.size, 1) - 1).bit_length())
        self._filter = None

    def place(self) -> Column:
        """Where a digest stands in the filter."""
        return F.shiftrightunsigned(F.xxhash64("digest"), 65 - self.bits.bit_length())

    def filter(self) -> DataFrame:
        """(bucket, bitmap), written when first asked for."""
        if self._filter is None:
            placed = self.entries.select(self.place().alias("place"))
            made = placed.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
            self._filter = self.scratch.write(made, "filter")
        found = self._filter[0]
        return F.broadcast(found) if self.bits // BITMAP_BITS <= BROADCAST_BITMAPS else found

    def probed(self, entries: DataFrame) -> DataFrame:
        """The entries with ``hit``: whether this run may hold their digest. False is certain."""
        bit = F.bitmap_bit_position("place")
        byte = F.conv(F.hex(F.substring("bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = F.expr("(byte & shiftleft(1, cast(bit % 8 AS int))) != 0")
        held = entries.withColumn("place", self.place()).withColumn("bucket", F.bitmap_bucket_number("place"))
        held = held.join(self.filter(), "bucket", "left").withColumn("bit", bit).withColumn("byte", byte)
        return held.select(*entries.columns, F.coalesce(set_, F.lit(False)).alias("hit"))

    def drop(self) -> None:
        for path in [self.path, *([self._filter[1]] if self._filter else [])]:
            self.scratch.drop(path)


class MergeIndex:
    """Runs by level under a folder of the shared store."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels = scratch, []

    def add(self, rows: DataFrame) -> None:
        """Flush a batch of rows (digest, doc_id) as a run, and merge levels that are full."""
        run = Run(self.scratch, rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")), "run-0")
        level = 0
        while run.size:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            run, self.levels[level] = self._merged(self.levels[level], level + 1), []
            level += 1
        run.drop()

    def _merged(self, runs: list[Run], level: int) -> Run:
        """One run of several, which are removed."""
        parts = []
        for run in runs:
            entries = run.entries.withColumn("maybe", F.lit(False))
            for other in runs:
                if other is not run:
                    entries = other.probed(entries).withColumn("maybe", F.col("maybe") | F.col("hit")).drop("hit")
            parts.append(entries)
        # read once: written with the outcome of the probes, then carried on or grouped
        probed, path = self.scratch.write(reduce(DataFrame.unionByName, parts), f"probed-{level}", partition_by="maybe")
        hits = probed.where("maybe").groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        done = Run(self.scratch, probed.where("NOT maybe").drop("maybe").unionByName(hits), f"run-{level}")
        for run in runs:
            run.drop()
        self.scratch.drop(path)
        return done

    def compact(self) -> DataFrame | None:
        """The entries of all runs, merged into one; None if there are none."""
        while len(left := [run for level in self.levels for run in level]) > 1:
            self.levels = [[self._merged(left[:FANOUT], len(self.levels)), *left[FANOUT:]]]
        return left[0].entries if left else None


def exact_groups(docs: DataFrame, digest=digest_of) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after ``normalised``; of equal texts the smallest doc_id stays. Null texts equal
    empty ones. Rows without doc_id are left out; rows that repeat a doc_id count in group_size, and all of them are
    kept if their id is. ``digest`` may be replaced in tests, to make digests collide.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    normal = texts(docs).select("doc_id", normalised("text").alias("text"))
    batch = F.pmod(F.spark_partition_id(), F.lit(BATCHES)).alias("batch")
    rows, _ = scratch.write(normal.select("doc_id", digest("text").alias("digest"), F.sha2("text", 256).alias("sha"), batch), "digests", partition_by="batch")
    index = MergeIndex(scratch)
    for k in range(BATCHES):
        index.add(rows.where(F.col("batch") == k).select("digest", "doc_id"))
    entries = index.compact()
    if entries is None:
        entries = docs.sparkSession.createDataFrame([], "digest binary, keep_id long, n long")
    several = entries.where("n > 1")
    small = several.count() <= BROADCAST_DIGESTS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    hits = normal.withColumn("digest", digest("text")).join(near(several.select("digest")), "digest", "left_semi")
    by_text = hits.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    verified = scratch.keep(by_text.select("digest", F.sha2("text", 256).alias("sha"), "keep_id", "n"), "verified")
    collided = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    if collided.isEmpty():
        found = rows.join(near(several), "digest", "left")
    else:  # digests of more than one text: the texts' own SHA-256 tells them apart
        found = rows.join(near(verified), ["digest", "sha"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that equal one of smaller doc_id."""
    scratch = Scratch(docs.sparkSession, "exact-drop")
    gone = scratch.keep(exact_groups(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    from .common import BROADCAST_IDS

    few = gone.count() <= BROADCAST_IDS
    return docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
