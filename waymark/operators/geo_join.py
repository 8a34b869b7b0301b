"""Places: gazetteer, radius join, nearest businesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import nearest as N
from waymark.operators.scope import STATES

RADIUS_KM = 5.0


def gazetteer(business: DataFrame) -> DataFrame:
    """Lower-case city and state to the mean position of its businesses."""
    return (
        business.filter(
            F.col("city").isNotNull()
            & F.col("state").isNotNull()
            & F.col("latitude").isNotNull()
            & F.col("longitude").isNotNull()
        )
        .groupBy(F.lower("city").alias("city"), "state")
        .agg(
            F.round(F.avg("latitude"), 6).alias("latitude"),
            F.round(F.avg("longitude"), 6).alias("longitude"),
            F.count("*").alias("n_business"),
        )
    )


def locate(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the position of each query's city; an unknown place drops out,
    because a search without a position has no result."""
    spots = places.select(
        F.col("city").alias("__city"), F.col("state").alias("__state"), "latitude", "longitude"
    )
    known = (F.lower(queries["city"]) == F.col("__city")) & (queries["state"] == F.col("__state"))
    return queries.join(spots, known).drop("__city", "__state")


def locate_text(queries: DataFrame, named: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the position of the place that a message itself names.

    ``queries``: conv_id, turn, text; ``named``: conv_id, turn, location, the
    city found in it (:func:`waymark.operators.intent.intent`). A state counts
    where its code stands in capitals ("Tampa, FL"). City and state mean that
    place, a city alone or a state alone the middle of all businesses there. A
    message that names no known place drops out.
    """
    n = F.col("n_business")

    def middle(*keys: str) -> DataFrame:
        spots = [F.round(F.sum(F.col(c) * n) / F.sum(n), 6).alias(c) for c in ("latitude", "longitude")]
        return places.groupBy(*keys).agg(*spots)

    none = F.lit(None).cast("string")
    known = (
        places.select("city", "state", "latitude", "longitude")
        .unionByName(middle("city").withColumn("state", none))
        .unionByName(middle("state").withColumn("city", none))
        .select(F.col("city").alias("__city"), F.col("state").alias("__state"), "latitude", "longitude")
    )
    said = F.nullif(F.regexp_extract("text", rf"\b({'|'.join(STATES)})\b", 1), F.lit(""))
    told = queries.join(named.select("conv_id", "turn", "location"), ["conv_id", "turn"]).withColumn("__said", said)
    same = F.col("location").eqNullSafe(F.col("__city")) & F.col("__said").eqNullSafe(F.col("__state"))
    return told.join(known, same).drop("location", "__said", "__city", "__state")


def within_radius(points: DataFrame, items: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """All (query_id, item_id, distance_km) with distance at most the radius.

    ``points``: query_id, latitude, longitude; ``items``: item_id, latitude,
    longitude. An equi join on grid cell and block, so a crowded cell is
    spread over many tasks, then the exact distance.
    """
    cell = ("band", "cell")
    spread, placed = N.to_cells(
        points.select("query_id", "latitude", "longitude"),
        items.select("item_id", "latitude", "longitude"),
        radius_km,
    )
    grid = N.block_grid(spread, placed, cell)
    left, right = N.split_blocks(spread, placed, grid, cell)
    right = right.withColumnsRenamed({"latitude": "item_lat", "longitude": "item_lon"})
    distance = geo.short_distance_km(
        F.col("latitude"), F.col("longitude"), F.col("item_lat"), F.col("item_lon")
    )
    return (
        left.join(right, "block")
        .select("query_id", "item_id", distance.alias("distance_km"))
        .filter(F.col("distance_km") <= radius_km)
    )


def closest(points: DataFrame, items: DataFrame, k: int, radius_km: float = RADIUS_KM) -> DataFrame:
    """The k businesses nearest to each point within the radius."""
    return N.nearest(points, items, k, "distance", radius_km).select(
        "query_id", "item_id", "distance_km", "rank"
    )
