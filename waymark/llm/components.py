"""Connected components of links between whole-number ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v.

    large: every node ties its larger neighbours to its smallest one (itself
    included); small: its smaller neighbours and itself to its smallest one.
    The smallest neighbour comes from an aggregation, so a node with very many
    neighbours is not gathered in one place.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = (
            edges.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
    return tied.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every id in links (a, b): the smallest id reachable.

    Alternates the two star operations until nothing changes; each halves the
    depth or better. Every round is written to the shared folder. NULL ids and
    links of an id to itself are left out.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "component-links")
    state = None
    while True:
        # Same count and same sum of hashes: the links did not change.
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == now:
            break
        state = now
        edges = materialize(_stars(_stars(edges, True), False), "component-stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
