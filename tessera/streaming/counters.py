"""Streaming counterparts of keyed counters and of the ordered cursor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Database


def running_totals(stream: DataFrame, keys: Sequence[str], delta: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Totals per key, kept by Structured Streaming; with a watermark, old keys that include its column are let go."""
    if watermark:
        stream = stream.withWatermark(*watermark)
    return stream.groupBy(*keys).agg(F.sum(delta).alias("total"), F.count(F.lit(1)).alias("n"))


def increments_into(stream: DataFrame, db: Database, table: str, keys: Sequence[str], counter: str, delta: str, sets: Sequence[str], seq: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into a table's counters. Each batch is one commit, which holds the batch's number under the
    checkpoint's name, so that a batch that is run again counts once."""

    def fold(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            db.increments_once(checkpoint, number, table, batch, keys, counter, delta, sets, seq)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream of bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
