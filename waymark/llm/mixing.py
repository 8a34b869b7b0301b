"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has
put out up to and including it, divided by the source's target. Copies of all
sources, sorted by that time, are the mix; it ends where the total budget is
used up. Documents of one source come in an order shuffled by a hash of their
id, and a source whose target exceeds its size starts over.

Everything is DataFrame work. Running sums are taken in two steps (bucket
totals, then rows within a bucket), so no window holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, word_count

PASSES = 3
BUCKETS = 4096
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Id, source and size in words of each document; a NULL text has none."""
    return docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source, source_size, target: shares of the total size by weight.

    Sources in code point order (NULL last) take the weights in turn. A target
    stops at `passes` times its source's size and the excess goes to the
    others by weight: the stopped sources are those whose stop lies lowest per
    unit of weight, found by one running sum over the sources.
    Works on one row per source, so the windows hold sources, not documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (turn + 1).cast("int"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(passes) * F.col("source_size")
    by_cap = Window.orderBy(cap.cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    rows = by_source.withColumn("weight", weight).select(
        "source",
        "source_size",
        "weight",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gone"),
    )
    # With all sources of a lower stop stopped, this one stops too if its share still passes its stop.
    left, weight_left = F.col("total") - F.col("capped"), F.col("weights") - F.col("gone")
    stops = cap * weight_left <= left * F.col("weight")
    rows = rows.withColumn("stops", stops)
    free = rows.select(
        "*",
        F.sum(F.when(F.col("stops"), cap).otherwise(F.lit(0))).over(whole).alias("stopped"),
        F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(F.lit(0))).over(whole).alias("stopped_weight"),
    )
    shared = (F.col("weight") * (F.col("total") - F.col("stopped"))).cast("double") / (
        F.col("weights") - F.col("stopped_weight")
    )
    return free.select(
        "source",
        "source_size",
        F.when(F.col("stops"), cap.cast("double")).otherwise(shared).alias("target"),
        "total",
    )


def finish_times(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """sized + source_size, target, total and `before`: words of the source up
    to and including the document in its shuffled order.

    The order is by md5 of the id, ties by id, NULL first. Rows that repeat an
    id with the same size are interchangeable.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = sized.withColumn("shuffle", digest).withColumn(
        "bucket", F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int") % BUCKETS
    )
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("source").alias("o_source"),
        F.col("bucket").alias("o_bucket"),
        F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"),
    )
    within = (
        Window.partitionBy("source", "bucket")
        .orderBy("shuffle", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = rows.withColumn("inside", F.sum("size").over(within))
    wanted = goal.select(F.col("source").alias("g_source"), "source_size", "target", "total")
    return (
        running.join(
            offsets,
            F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")),
        )
        .join(wanted, F.col("source").eqNullSafe(F.col("g_source")))
        .select("*", (F.col("inside") + F.col("offset")).alias("before"))
        .drop("o_source", "o_bucket", "g_source", "inside", "offset", "bucket", "bucket_size")
    )


def finish(copy: Column) -> Column:
    """Virtual finish time of a copy: exact whole numbers, one division."""
    return F.try_divide((copy * F.col("source_size") + F.col("before")).cast("double"), F.col("target"))


def queue(timed: DataFrame, passes: int = PASSES) -> DataFrame:
    """All copies that may enter the mix, with their finish time."""
    copies = timed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return copies.withColumn("finish", finish(F.col("copy")))


def cutoff(timed: DataFrame, passes: int = PASSES, steps: int = 1 << 16) -> DataFrame:
    """One row `cut`: the last finish time at which the words of all copies up
    to it stay within the total; copies with equal times enter together.

    Totals per step of the time axis (at most `steps` + 1 rows), the step in
    which the budget ends, and a running sum over the copies of that step
    alone. At time 1 every source is at its target, so the budget ends soon
    after 1; times over 2 share the last step.
    """
    copies = queue(timed, passes).select("finish", "size", "total")
    step = F.least(F.floor(F.col("finish") * (steps // 2)), F.lit(steps)).cast("long")
    copies = copies.withColumn("step", step)
    per_step = copies.groupBy("step").agg(
        F.sum("size").alias("words"), F.max("total").alias("total"), F.max("finish").alias("last")
    )
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.col("upto") <= F.col("total")
    edge = per_step.withColumn("upto", F.sum("words").over(so_far)).agg(
        F.min(F.when(~fits, F.col("step"))).alias("step"),
        F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("earlier"),
        F.coalesce(F.max(F.when(fits, F.col("last"))), F.lit(-1.0)).alias("last"),
    )
    upto = Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        copies.where(F.col("step") == edge.select("step").scalar())
        .withColumn("upto", F.sum("size").over(upto) + edge.select("earlier").scalar())
        .where(fits)
        .agg(F.max("finish").alias("inside"))
    )
    return edge.select(F.coalesce(inside.scalar(), F.col("last")).alias("cut"))


def mix_amounts(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    passes: int = PASSES,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row.

    An empty table gives no rows. A source without words has target 0 and is
    not taken; NULL sources form one source, NULL ids are allowed, rows that
    repeat are rows of their own. Other columns of `docs` are ignored.
    """
    sized = materialize(sizes(docs, id, text, source), "mixing-sizes")
    timed = finish_times(sized, targets(sized, weights, passes))
    cut = cutoff(timed, passes)
    taken = sum(
        (F.when((F.col("size") > 0) & (finish(F.lit(copy)) <= F.col("cut")), 1).otherwise(0) for copy in range(passes)),
        F.lit(0),
    )
    return (
        timed.withColumn("cut", cut.scalar())
        .withColumn("copies", taken.cast("int"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    passes: int = PASSES,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: (doc_id, copy, finish) range-sorted by finish time over
    all partitions, ended at the total budget."""
    sized = materialize(sizes(docs, id, text, source), "mixing-sizes")
    timed = finish_times(sized, targets(sized, weights, passes))
    inside = queue(timed, passes).withColumn("cut", cutoff(timed, passes).scalar())
    return (
        inside.where("finish <= cut")
        .select("doc_id", "source", "size", "copy", "finish")
        .orderBy("finish", F.col("source").asc_nulls_last(), "doc_id")
    )
