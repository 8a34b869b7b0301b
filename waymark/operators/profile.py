"""Column profiles: numeric summary, NULL and value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
LINEAR_STEPS = 65_536
LOG_STEPS = 64  # per e-fold


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    return df.select(F.inline(cells)).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum.

    Spark's exact ``percentile`` keeps every distinct value of a column in
    one buffer. Here the wanted ranks are closed in on: values are counted in
    steps that rise with the value, only the steps that hold a wanted rank
    are opened and counted in finer ones, and what is left is folded by value
    and ranked. Quartiles interpolate linearly.
    """
    values = _long(df, columns)
    stats = values.groupBy("column_name").agg(
        F.count("*").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    position = F.col("q") * (F.col("count") - 1)
    # One row per column, quartile and neighbouring rank, here and in every
    # frame made from it: at most six times the number of profiled columns.
    wanted = (
        stats.select("column_name", "count", F.explode(F.array(*[F.lit(q) for q in QUARTILES])).alias("q"))
        .withColumn("position", position)
        .select(
            "column_name",
            "q",
            "position",
            F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))).alias("rank"),
        )
        .withColumn("before", F.lit(0).cast("long"))
    )
    log_step = F.signum("v") * F.floor(F.log1p(F.abs("v")) * LOG_STEPS)
    # halves, because the whole span may be more than a double holds
    span = F.col("high") / 2 - F.col("low") / 2
    share = F.when(span > 0, (F.col("v") / 2 - F.col("low") / 2) / span).otherwise(F.lit(0.0))

    keys = ["column_name"]
    for level, step in (("log_step", log_step), ("fine_step", F.floor(share * LINEAR_STEPS))):
        values = values.withColumn(level, step.cast("long"))
        wanted = _close_in(values, wanted, keys, level)
        keys.append(level)
        opened = wanted.select(*keys, "low", "high").distinct()
        values = values.drop("low", "high").join(F.broadcast(opened), keys)
    found = _close_in(values, wanted.drop("low", "high"), keys, "v")

    share_up = F.max("position") - F.floor(F.max("position"))
    quartile = found.groupBy("column_name", "q").agg(
        (F.min("v") + (F.max("v") - F.min("v")) * share_up).alias("value")
    )
    wide = quartile.groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{int(q * 100)}")
            for q in QUARTILES
        ]
    )
    return stats.join(wide, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def _close_in(values: DataFrame, wanted: DataFrame, keys: list[str], level: str) -> DataFrame:
    """The wanted ranks with the step of ``level`` that holds each of them.

    ``before`` counts the values below the step. The window runs over one row
    per step, not per value.
    """
    steps = values.groupBy(*keys, level).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    upto = Window.partitionBy(*keys).orderBy(level)
    steps = steps.withColumn("inside", F.sum("n").over(upto) - F.col("n"))
    start = F.col("before") + F.col("inside")
    return (
        steps.join(F.broadcast(wanted.drop("low", "high")), keys)
        .filter((start <= F.col("rank")) & (F.col("rank") < start + F.col("n")))
        .withColumn("before", start)
        .drop("n", "inside")
    )


def _per_column(df: DataFrame, counter, name: str, columns: Sequence[str] | None) -> DataFrame:
    columns = list(columns or df.columns)
    one_row = df.agg(*[counter(c).alias(c) for c in columns])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(name)) for c in columns]
    )
    return one_row.select(F.inline(cells))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, lambda c: F.count_if(F.col(f"`{c}`").isNull()), "null_count", columns)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-NULL count per column."""
    return _per_column(df, lambda c: F.count(F.col(f"`{c}`")), "value_count", columns)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    total = counted[0]
    for one in counted[1:]:
        total = total.unionByName(one)
    return total
