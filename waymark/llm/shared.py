"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import work_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """The frame written once to the cluster's shared folder and read back.

    Cuts the lineage with files every executor can reach, so a lost executor
    costs no recomputation of what came before.
    """
    path = work_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space; none in a NULL text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(frame: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under fixed names: whatever else the
    frame holds, clashing names included, stays out of the work."""
    return frame.select(*(frame[source].alias(name) for name, source in columns.items()))
