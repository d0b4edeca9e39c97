"""Token-ID files: documents' ids, entropy-coded by range asymmetric numeral systems (rANS) with a static shared table.

A store is a folder with two Parquet tables. ``table`` holds the frequency of each id, counted over all documents and
scaled to 2^20. ``segments`` holds runs of whole documents in ascending doc_id order (folder ``shard=N`` by ascending
N, rows by ascending start), each with its documents' ids and lengths, and its tokens as independent blocks: each
block has its own lanes, final states (its checkpoint), words and CRC-32, so any block decodes without the others,
on any executor. Parquet as container makes writes atomic and works on every file system that Spark reads.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, texts

SCALE_BITS, LANES, BLOCK, SEGMENT = 20, 512, 65_536, 262_144
_LOW = np.uint64(1 << 31)
_32, _SCALE, _MASK = np.uint64(32), np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)


class Frequencies:
    """A static table: symbols (ascending ids) with counts, scaled so that each has at least 1 of 2^SCALE_BITS."""

    def __init__(self, symbols, counts):
        symbols, counts = np.asarray(symbols, np.int64), np.asarray(counts, np.float64)
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order], counts[order]
        size, n = 1 << SCALE_BITS, len(self.symbols)
        if n > size:
            raise ValueError(f"more than {size} different ids")
        freq = 1 + np.floor(counts / max(counts.sum(), 1) * (size - n)).astype(np.int64)
        if n:
            freq[np.argmax(freq)] += size - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if n else self.freq
        self.code = np.full(int(self.symbols[-1]) + 1 if n else 0, -1, np.int32)
        self.code[self.symbols] = np.arange(n)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    """lanes u32, states u64 each, words u32 each. Token i is in lane i % lanes; rows of lanes go through in reverse."""
    codes = table.code[ids]
    lanes = max(1, min(LANES, len(ids)))
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    freqs, starts = table.freq[codes], table.start[codes]
    limits = ((_LOW >> _SCALE) << _32) * freqs
    for a in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        b = min(a + lanes, len(ids))
        x, f = state[: b - a], freqs[a:b]
        out = x >= limits[a:b]
        if out.any():
            words.append(x[out].astype("<u4"))
            x = np.where(out, x >> _32, x)
        q = x // f
        state[: b - a] = (q << _SCALE) + (x - q * f) + starts[a:b]
    body = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    return np.uint32(lanes).astype("<u4").tobytes() + state.astype("<u8").tobytes() + body.tobytes()


def decode_block(raw: bytes, n: int, table: Frequencies, slots: np.ndarray) -> np.ndarray:
    lanes = int(np.frombuffer(raw, "<u4", 1)[0])
    state = np.frombuffer(raw, "<u8", lanes, 4).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", offset=4 + 8 * lanes).astype(np.uint64)
    out, at = np.empty(n, np.int32), 0
    for a in range(0, n, lanes):
        b = min(a + lanes, n)
        x = state[: b - a]
        slot = x & _MASK
        code = slots[slot]
        out[a:b] = code
        x = table.freq[code] * (x >> _SCALE) + slot - table.start[code]
        short = x < _LOW
        k = int(np.count_nonzero(short))
        if k:
            x[short] = (x[short] << _32) | words[at : at + k]
            at += k
        state[: b - a] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("a block of the token store is damaged")
    return table.symbols[out].astype(np.uint32)


_RAW = "shard int, first_doc long, n_docs int, start long, n_tokens long, docs binary, lengths binary, ids binary"
_SEGMENT = "shard int, first_doc long, n_docs int, start long, n_tokens long, docs binary, lengths binary, block_bytes array<int>, block_crc32 array<long>, blocks binary"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _raw_segments(docs: DataFrame, encoder, shards: int) -> DataFrame:
    """Whole documents in doc_id order, tokenised, in segments; start counts from the shard's first token."""

    def run(found):
        made, shard, start = encoder(), TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def segment():
            narrow = all(int(x.max(initial=0)) < 1 << 16 for x in ids)
            raw = np.concatenate(ids).astype("<u2" if narrow else "<u4").tobytes()
            return _arrow([(shard, docs[0], len(docs), start, size, np.array(docs, "<i8").tobytes(), np.array([len(x) for x in ids], "<i8").tobytes(), bytes([2 if narrow else 4]) + raw)], _RAW)

        for batch in found:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = made.encode(text.as_py())
                docs.append(doc)
                ids.append(got)
                size += len(got)
                if size >= SEGMENT:
                    yield segment()
                    start += size
                    docs, ids, size = [], [], 0
        if docs:
            yield segment()

    return texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _RAW)


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def write_store(docs: DataFrame, path: str, encoder, n_ids: int, shards: int | None = None) -> None:
    """Write the documents' ids to a new store at path. n_ids bounds the ids (the vocabulary's size), and with it what the
    driver gathers: the table of counts and a total for each shard."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "tokens")
    raw, raw_path = scratch.write(_raw_segments(docs, encoder, shards), "ids")

    def count(found):
        total = np.zeros(n_ids, np.int64)
        for batch in found:
            for x in batch.column(0):
                total += np.bincount(_ids(x.as_py()), minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    table = raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table.coalesce(1).write.parquet(f"{path}/table")
    frequencies = read_table(spark, path)
    totals = dict(raw.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before, total = {}, 0
    for shard in sorted(totals):
        before[shard], total = total, total + totals[shard]

    def code(found):
        names = [x.split()[0] for x in _RAW.split(", ")]
        for batch in found:
            for row in zip(*[batch.column(batch.schema.get_field_index(n)) for n in names], strict=True):
                shard, first, n_docs, start, n, docs, lengths, ids = (x.as_py() for x in row)
                ids = _ids(ids)
                blocks = [encode_block(ids[a : a + BLOCK], frequencies) for a in range(0, n, BLOCK)]
                yield _arrow([(shard, first, n_docs, start + before[shard], n, docs, lengths, [len(x) for x in blocks], [zlib.crc32(x) for x in blocks], b"".join(blocks))], _SEGMENT)

    raw.mapInArrow(code, _SEGMENT).write.option("compression", "none").partitionBy("shard").parquet(f"{path}/segments")
    scratch.drop(raw_path)


def read_table(spark: SparkSession, path: str) -> Frequencies:
    """The store's table; it has a row for each id of the vocabulary that occurs."""
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").collect()
    return Frequencies([r["id"] for r in rows], [r["n"] for r in rows])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; a wrong checksum is an error. For ids
    themselves, see decode_segment."""
    frequencies = read_table(spark, path)

    def run(found):
        slots = frequencies.slots()
        for batch in found:
            out = []
            for row in zip(*batch.columns, strict=True):
                start, docs, lengths, ids = decode_segment([x.as_py() for x in row], frequencies, slots)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(lengths)
                out += [(d, start + e - n, n, zlib.crc32(raw[4 * (e - n) : 4 * e])) for d, n, e in zip(docs.tolist(), lengths.tolist(), ends.tolist(), strict=True)]
            yield _arrow(out, "doc_id long, start long, n_tokens long, ids_crc32 long")

    columns = ["start", "n_tokens", "docs", "lengths", "block_bytes", "block_crc32", "blocks"]
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").select(*columns)
    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_segment(row: list, frequencies: Frequencies, slots: np.ndarray):
    """(start, doc ids, lengths, all ids) of a row of segments: start, n_tokens, docs, lengths, block_bytes, block_crc32, blocks."""
    start, n, docs, lengths, sizes, sums, blocks = row
    parts, at = [], 0
    for k, (size, crc) in enumerate(zip(sizes, sums, strict=True)):
        raw = blocks[at : at + size]
        if zlib.crc32(raw) != crc:
            raise ValueError("a block of the token store fails its checksum")
        parts.append(decode_block(raw, min(BLOCK, n - k * BLOCK), frequencies, slots))
        at += size
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return start, np.frombuffer(docs, "<i8"), np.frombuffer(lengths, "<i8"), ids
