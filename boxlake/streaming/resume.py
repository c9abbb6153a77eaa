"""Resumable prediction as a stream: new query files are read once, and the checkpoint remembers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def predict_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, predict: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs predict over JSON lines in source that no earlier call has taken, and appends the results to target as Parquet.

    Call again after a crash or with more files: committed batches are not repeated, and an interrupted one is redone.
    """
    rows = spark.readStream.schema(schema).json(source)
    return predict(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
