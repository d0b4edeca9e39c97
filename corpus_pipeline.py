"""A corpus pipeline: each stage takes the documents that the stage before kept, and the last packs their tokens.

Rows without doc_id leave at the first stage. Null texts count as empty. Rows that repeat a doc_id stay or go together.
Columns beside those of documents don't pass; an empty table gives empty stages.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, documents
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.language_id import drop_rejected
from tessera.llm.near_dedup import drop_near_copies
from tessera.llm.packing import pack_documents
from tessera.llm.tokens import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters, are foreign to all known languages, or whose language isn't sure."""
    return drop_rejected(docs).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (each run of ASCII white space counting as one space), the smallest doc_id stays."""
    return drop_copies(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the smallest doc_id of a group stays, and all texts without words do."""
    return drop_near_copies(docs, 5, 80, 100).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that cover 0.6 of a benchmark item's words with tiles of five words or more, in whatever order."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document's ids and their places in sequences of 1024, as op1_packing gives them."""
    import public_tokenizers

    return pack_documents(docs, partial(encoder, public_tokenizers.path("byte_bpe_50k.json"), 2), 1024)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("packing", packing)]

#: The language model, tiling and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}-{name.replace(' ', '-')}")
    return docs
