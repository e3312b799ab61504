"""Arriving files: the batch parse unchanged over a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """``file_id, length, content`` of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.selectExpr("path AS file_id", "length", "content")


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Parses what has arrived and appends the rows to a Parquet table; each file counts once."""
    return parse(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
