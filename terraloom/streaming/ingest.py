"""Incremental processing of newly arrived scenes with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_scenes(
    spark: SparkSession,
    source: str,
    schema,
    process: Callable[[DataFrame], DataFrame],
    output: str,
    state: str,
    pattern: str = "*.parquet",
) -> None:
    """Run ``process`` once over every source file not seen before and append its result.

    The stream's checkpoint is the ledger of processed files. Each micro-batch is written to its own
    batch folder in overwrite mode, so a batch replayed after a failure replaces its first attempt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
