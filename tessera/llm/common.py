"""What the corpus operators share: the shared folder, written intermediates, and reading documents.

Conventions that hold for every operator here:

* a null text counts as empty; a row whose doc_id is null is no document and is left out;
* other columns of the input are ignored unless an operator says that it keeps them;
* lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (never a local checkpoint), so that a lost
  executor costs a re-read of the written table and no recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch between Spark and a worker while an intermediate is written; Spark's own default is 64 MB.
ARROW_BYTES, ARROW_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of a batch that a worker takes up at a time; a single longer text goes through alone.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: Ids that may be broadcast: 8 bytes each, so at most some 16 MB with overhead.
BROADCAST_IDS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_tessera_tmp"):
        spark._tessera_tmp = tempfile.mkdtemp(prefix="tessera-")
    return "file://" + spark._tessera_tmp


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


@contextmanager
def small_batches(spark: SparkSession):
    """Actions in here pass batches of ARROW_BYTES at most to workers (a single row may be larger)."""
    before = spark.conf.get(ARROW_SETTING)
    spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ARROW_SETTING, before)


class Scratch:
    """Written intermediates of one run of an operator. Those that its lazy result reads stay until the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        atexit.register(_remove_quietly, spark, self.root)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
        self._count += 1
        path = f"{self.root}/{self._count:02d}-{name}"
        writer = df.write.option("compression", "zstd")
        with small_batches(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written and read again."""
        return self.write(df, name)[0]

    def drop(self, path: str) -> None:
        remove(self.spark, path)


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id long, text string) of the documents; null text becomes empty, rows without doc_id go."""
    return docs.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) in which doc_id is a key, and the way back. Mostly that is docs itself and None. Rows that repeat a
    doc_id become documents of their own, numbered anew in order of doc_id and their texts' SHA-256; rows that repeat both
    become one. The way back is (doc_id, key), a row for each row of docs; see returned."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs, None
    shards, with_sha = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.withColumn("sha", F.sha2("text", 256))
    rows = with_sha.select("doc_id", "sha").distinct().repartitionByRange(shards, "doc_id", "sha").sortWithinPartitions("doc_id", "sha")
    rows = scratch.keep(rows.withColumn("key", F.monotonically_increasing_id()), "keys")  # ascending with the place in this order
    joined = with_sha.join(rows, ["doc_id", "sha"])
    own = joined.select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    return scratch.keep(own, "documents"), scratch.keep(joined.select("doc_id", "key"), "back")


def returned(found: DataFrame, back: DataFrame | None) -> DataFrame:
    """The rows found for documents of keyed, for the rows that it was given."""
    return found if back is None else back.join(found.withColumnRenamed("doc_id", "key"), "key").drop("key")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only_ids(rows: DataFrame, ids: DataFrame, n_ids: int, key: str = "doc_id") -> DataFrame:
    """The rows whose key is among ids (n_ids of them): by a broadcast within BROADCAST_IDS, else by a shuffled join."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids.hint("shuffle_hash"), key, "left_semi")


def sliced(found, text: int = 1):
    """The batches in slices of SLICE_ROWS rows and about SLICE_BYTES of the given column, so that what a worker makes of
    texts at a time is bounded. An empty batch stays one slice."""
    for batch in found:
        for a in range(0, max(batch.num_rows, 1), SLICE_ROWS):
            part = batch.slice(a, SLICE_ROWS)
            column = part.column(text)
            if column.nbytes <= SLICE_BYTES or not pa.types.is_string(column.type):
                yield part
                continue
            start, size = 0, 0
            for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
                if size and size + (n or 0) > SLICE_BYTES:
                    yield part.slice(start, i - start)
                    start, size = i, 0
                size += n or 0
            yield part.slice(start)
