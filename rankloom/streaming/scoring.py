"""Scoring impressions as they arrive: a stream joined with a snapshot of history, by the batch functions.

The history is a static side with a strict time predicate, so no state is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import behavioural_features


def stream_impressions(spark: SparkSession, folder: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def score_stream(stream: DataFrame, history: DataFrame, articles: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Features of each micro-batch's impressions go to sink(batch, id), which must be idempotent by id."""

    def each(batch: DataFrame, nr: int) -> None:
        sink(behavioural_features(batch, history, articles), nr)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
