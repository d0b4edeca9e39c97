"""Streaming, an extension: incremental loads as streams, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.build import upsert


def upsert_stream(stream: DataFrame, target: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys in the Parquet table at target. A batch writes a version folder of its
    own number and reads the one before, so a batch that is run again gives the same version."""

    def load(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.dropDuplicates(key)
        if number:
            rows = upsert(spark.read.parquet(f"{target}/version={number - 1}"), rows, key)
        rows.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows, final once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"))
