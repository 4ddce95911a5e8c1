"""The online form of the daily build: a file stream whose batches are upserted by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldglass.sources import versions


def landed_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_stream(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: list[str],
    day: str,
    order: list[Column],
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Apply every available file once, each batch as one version of the table at `target`.

    A batch replayed after a failure gives the same rows.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        versions.upsert(prepare(batch), target, keys, day, order)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
