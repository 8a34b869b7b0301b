"""Data tests. Each returns the rows that break the rule; none is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("row_count"))
        .filter("row_count > 1")
    )


def null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNull())


def orphans(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent row. A NULL key refers to nothing."""
    known = parent.select(key).distinct()
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def run_declared(models: Mapping[str, DataFrame], tests: Sequence[tuple[str, str, str]]) -> DataFrame:
    """model, column, test, failing rows of each declared test (model, column,
    ``unique`` or ``not_null``). ``unique`` counts the values that repeat."""

    def failing(model: str, column: str, test: str) -> DataFrame:
        broken = {"unique": not_unique, "not_null": null_keys}[test](models[model], column)
        return broken.agg(F.count("*").alias("failing_rows")).select(
            F.lit(model).alias("model"), F.lit(column).alias("column_name"), F.lit(test).alias("test"), "failing_rows"
        )

    return reduce(DataFrame.unionByName, (failing(*test) for test in tests))
