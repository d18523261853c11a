"""Resumable ingest as a file stream: an addition to the batch sink of ``sources.files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_once(rows: DataFrame, out: str, checkpoint: str, key: str, event_time: str, delay: str = "1 day") -> StreamingQuery:
    """Writes each key once within the delay; a restart goes on where the checkpoint stands."""
    once = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
