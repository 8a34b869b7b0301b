"""Continuous file ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "json",
    pattern: str = "*",
    files_per_trigger: int = 1000,
    bytes_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Newly arriving files of a folder as a stream of rows.

    A micro-batch is bounded in files or, if given, in bytes.
    """
    bound = (
        {"maxBytesPerTrigger": str(bytes_per_trigger)}
        if bytes_per_trigger
        else {"maxFilesPerTrigger": str(files_per_trigger)}
    )
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .options(**options, **bound)
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def land(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append everything that has arrived to a table, exactly once.

    Runs until the folder is drained; running it again picks up only new
    files. The checkpoint belongs in the same shared storage as the table.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
    query.awaitTermination()
