"""The queries of the corpus operators, thin digests of what the operators return, and their SQL where SQL can say it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Ids that the vocabulary word_bpe_49k.json can give, its two special tokens included.
WORD_IDS = 49_408


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import encoder

    return pack_documents(documents(spark, sf_dir), partial(encoder, vocabulary("byte_bpe_50k.json"), 2), 1024)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(documents(spark, sf_dir), 2, 80, 100)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir), with_text=False).drop("text")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal

    return find_personal(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), with_bytes=False).drop("kept")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store
    from .tokens import encoder

    path = f"{Scratch(spark, 'store').root}/store"
    write_store(documents(spark, sf_dir), path, partial(encoder, vocabulary("word_bpe_49k.json"), 2), WORD_IDS)
    return read_store(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import page_languages

    found = page_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
    return found.withColumn("posterior", F.round("posterior", 6))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_packing, op2_decontamination, op3_near_dedup, op4_line_dedup, op5_personal_data, op6_exact_dedup, op7_token_count, op8_substring_dedup, op9_token_store, op10_language_id, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; the others are tested against brute force."""
    normal = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
    exact = f"""
        WITH n AS (SELECT doc_id, {normal} AS t FROM documents WHERE doc_id IS NOT NULL),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t"""
    return {"op6_exact_dedup": exact}
