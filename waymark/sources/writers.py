"""Sinks: replace, append, CSV report, knowledge-base table, keyed upsert."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.readers import CSV_OPTIONS

KB_FILE_ROWS = 1_000_000
CSV_FILE_ROWS = 50_000


def replace_table(df: DataFrame, path: str, file_rows: int = 0) -> None:
    """Write the result as the table's new content.

    The rows go to a folder of their own; only when they are all there, one
    row in the table's list of versions makes it the current one. A run that
    fails before that leaves the table as it was. Old versions stay until the
    storage's own rules remove them. Files split after ``file_rows`` rows.
    """
    spark = df.sparkSession
    version = f"{path}/versions/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(version)
    number = (_versions(spark, path) or (0, ""))[0] + 1
    row = spark.createDataFrame([(number, version)], _VERSION)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


_VERSION = "number long, folder string"


def _versions(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the current version, None before the first one."""
    try:
        commits = spark.read.schema(_VERSION).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = commits.agg(F.max(F.struct("number", "folder")).alias("last")).first()["last"]
    return (last["number"], last["folder"]) if last else None


def append_table(df: DataFrame, path: str) -> None:
    """Add rows. Running it twice adds them twice."""
    df.write.mode("append").parquet(path)


def write_report_csv(df: DataFrame, path: str, file_rows: int = CSV_FILE_ROWS) -> None:
    """A ranked result as CSV with a header and no row index.

    Files split after ``file_rows`` rows: one with line breaks in its cells is
    read by one task (see ``readers.read_csv``).
    """
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("maxRecordsPerFile", file_rows).csv(path)


def write_kb(documents: DataFrame, path: str, file_rows: int = KB_FILE_ROWS) -> None:
    """The knowledge base: id, document, metadata and, if there, the vector.

    Ids are expected to be unique (see ``dedupe.keep_first``). Each task
    writes its own files, split after ``file_rows`` rows.
    """
    replace_table(documents, path, file_rows)


def upsert(current: DataFrame, changes: DataFrame, key: str, insert: bool = True) -> DataFrame:
    """``current`` with the rows of ``changes`` laid over it and, with
    ``insert``, those of new keys added.

    A column that ``changes`` lacks, or holds NULL in, keeps its value. Both
    sides hold one row per key. ``replace_table`` may write the result over
    the table it was read from: every version has a folder of its own.
    """
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    merged = current.join(new, key, "full_outer" if insert else "left")
    return merged.select(
        *[
            F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c)
            if c != key and c in changes.columns
            else F.col(c)
            for c in current.columns
        ]
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows appended to a table, or the current version of a replaced one."""
    current = _versions(spark, path)
    return spark.read.parquet(current[1] if current else path)
