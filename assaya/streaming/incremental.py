"""Incremental runs as a file stream: each new file is assessed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def assess_new_files(spark: SparkSession, source: str, sink: str, checkpoint: str, assess: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads the Parquet files that came since the last call and appends their results to ``sink``."""
    docs = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        assess(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a batch that runs again replaces itself

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
