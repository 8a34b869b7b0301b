"""The recommendation searches.

All take many queries at once: ``query_id``, ``vector`` and, where a place
matters, ``latitude`` and ``longitude``. ``items`` are business vectors. They
return one row per query and hit; names and texts are joined on afterwards,
so they never pass through the scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions import vectors as V
from waymark.operators.geo_join import RADIUS_KM
from waymark.operators.nearest import WIDTH, nearest

# Candidates fetched and results kept by each search.
CLI_CANDIDATES, CLI_RESULTS, CLI_MIN_COSINE = 25, 5, 0.0
FORM_CANDIDATES, FORM_RESULTS = 20, 3
GLOBAL_RESULTS = 10
NEAR_CANDIDATES, NEAR_RESULTS = 5, 2
KB_RESULTS = 5
FOLLOW_UP_RESULTS, FOLLOW_UP_MIN_COSINE = 5, 0.1
PREFERENCE_RESULTS = 1


def as_items(business_vectors: DataFrame) -> DataFrame:
    return business_vectors.withColumnRenamed("business_id", "item_id")


def rerank(hits: DataFrame, results: int, *order: Column) -> DataFrame:
    """Second stage: reorder each query's hits and keep the first ones."""
    by = Window.partitionBy("query_id").orderBy(*order, "business_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= results)


# Digits that count when hits are ordered, and digits shown.
RANKED, SHOWN = 12, 6


def _hits(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id",
        F.col("item_id").alias("business_id"),
        F.round("l2", RANKED).alias("l2"),
        F.round("cosine", RANKED).alias("similarity"),
        F.round("distance_km", 9).alias("distance_km"),
        "rank",
    )


def _shown(*names: str) -> list[Column]:
    return [F.round(name, SHOWN).alias(name) for name in names]


def two_stage(
    queries: DataFrame,
    items: DataFrame,
    candidates: int,
    results: int,
    radius_km: float | None = RADIUS_KM,
    min_cosine: float | None = None,
    nearer_first: bool = False,
    unit_items: bool = False,
    width: int | Column = WIDTH,
    few: bool = False,
) -> DataFrame:
    """Nearest candidates by L2 within the radius, then the best by cosine.

    ``min_cosine`` cuts between the stages; ``nearer_first`` breaks cosine
    ties by distance; ``unit_items`` takes the business vectors at length one,
    leaving out those without a direction. A query without text, place or candidate has no rows.
    """
    hits = _hits(nearest(queries, items, candidates, "l2", radius_km, unit_items=unit_items, width=width, few=few))
    if min_cosine is not None:
        hits = hits.filter(F.col("similarity") >= min_cosine)
    order = [F.desc("similarity")] + ([F.asc("distance_km")] if nearer_first else [])
    return rerank(hits, results, *order).select(
        "query_id", "rank", "business_id", *_shown("similarity", "distance_km")
    )


def cli_search(queries: DataFrame, items: DataFrame, width: int | Column = WIDTH) -> DataFrame:
    return two_stage(queries, items, CLI_CANDIDATES, CLI_RESULTS, min_cosine=CLI_MIN_COSINE, width=width)


def form_search(queries: DataFrame, items: DataFrame, width: int | Column = WIDTH) -> DataFrame:
    return two_stage(queries, items, FORM_CANDIDATES, FORM_RESULTS, width=width)


def near_search(
    queries: DataFrame, items: DataFrame, results: int = NEAR_RESULTS, width: int | Column = WIDTH, few: bool = False
) -> DataFrame:
    """Unit business vectors against the query vector as it is."""
    return two_stage(
        queries, items, NEAR_CANDIDATES, results, nearer_first=True, unit_items=True, width=width, few=few
    )


def global_search(
    queries: DataFrame, items: DataFrame, results: int = GLOBAL_RESULTS, width: int | Column = WIDTH, few: bool = False
) -> DataFrame:
    """No place: unit vectors on both sides, largest inner product."""
    found = nearest(queries, items, results, "ip", unit_queries=True, unit_items=True, width=width, few=few)
    hits = _hits(found)
    return rerank(hits, results, F.desc("similarity")).select(
        "query_id", "rank", "business_id", *_shown("similarity")
    )


def kb_search(
    queries: DataFrame, items: DataFrame, results: int = KB_RESULTS, width: int | Column = WIDTH, few: bool = False
) -> DataFrame:
    """Smallest squared distance. ``similarity_score`` is that distance, so
    lower is better in spite of its name."""
    found = _hits(nearest(queries, items, results, "l2", width=width, few=few))
    return found.select(
        "query_id", "rank", "business_id", F.round(F.round("l2", SHOWN), 4).alias("similarity_score")
    )


def follow_up(
    follow_ups: DataFrame,
    previous: DataFrame,
    items: DataFrame,
    results: int = FOLLOW_UP_RESULTS,
) -> DataFrame:
    """A follow-up ranks only the hits of the search before it.

    ``previous``: query_id, business_id, distance_km. The first ``results`` by
    cosine are taken, then those under the threshold are dropped; distance
    and score are rounded for display. A query has at most as many pairs as
    the earlier search had hits.
    """
    pairs = (
        previous.select("query_id", "business_id", "distance_km")
        .join(follow_ups.select("query_id", F.col("vector").alias("q_vector")), "query_id")
        .join(items.select(F.col("item_id").alias("business_id"), "vector"), "business_id")
    )
    scored = pairs.select(
        "query_id",
        "business_id",
        "distance_km",
        F.round(V.cosine(F.col("q_vector"), F.col("vector")), RANKED).alias("similarity"),
    )
    top = rerank(scored, results, F.desc("similarity"))
    return top.filter(F.col("similarity") >= FOLLOW_UP_MIN_COSINE).select(
        "query_id",
        "rank",
        "business_id",
        F.round("distance_km", 2).alias("distance_km"),
        F.round("similarity", 4).alias("similarity"),
    )


def preference_search(
    queries: DataFrame, items: DataFrame, width: int | Column = WIDTH, few: bool = False
) -> DataFrame:
    """Best business near each user for the user's preference vector."""
    return near_search(queries, items, PREFERENCE_RESULTS, width, few)


def pair_scores(pairs: DataFrame) -> DataFrame:
    """L2, inner product and cosine of rows that hold two vectors ``a``, ``b``."""
    a, b = F.col("a"), F.col("b")
    return pairs.withColumns({"l2": V.squared_l2(a, b), "ip": V.dot(a, b), "cosine": V.cosine(a, b)})


def seeded_between(key: Column, seed: int, low: float, high: float, digits: int) -> Column:
    """A value in [low, high] that depends only on the key and the seed."""
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_001)) / F.lit(10_000.0)
    return F.round(F.lit(low) + part * (high - low), digits)


def present(hits: DataFrame, business: DataFrame, fill_seed: int | None = None) -> DataFrame:
    """Hits with the business's name, categories, place, stars and distance.

    ``distance_km`` is measured from ``origin_lat``/``origin_lon`` where a hit
    has them, and is NULL otherwise; a business at latitude or longitude 0
    counts as unplaced. ``fill_seed`` fills missing stars (3.5 to 5) and
    distances (0.5 to 5 km) with repeatable values.
    """
    shown = business.select(
        "business_id", "name", "categories", "city", "state", "latitude", "longitude", "stars"
    )
    placed = hits.join(shown, "business_id")
    has_spot = (F.col("latitude") != 0) & (F.col("longitude") != 0)
    distance = F.lit(None).cast("double")
    if "origin_lat" in hits.columns:
        leg = geo.geodesic_km(*[F.col(c) for c in ("origin_lat", "origin_lon", "latitude", "longitude")])
        placed = placed.withColumn(
            "__km",
            F.when(F.col("origin_lat").isNotNull() & F.col("origin_lon").isNotNull() & has_spot, leg),
        )
        distance = F.round("__km", 2)
    stars = F.round("stars", 1)
    if fill_seed is not None:
        key = F.col("business_id")
        distance = F.coalesce(distance, seeded_between(key, fill_seed, 0.5, 5.0, 2))
        stars = F.coalesce(stars, seeded_between(key, fill_seed + 1, 3.5, 5.0, 1))
    keep = [c for c in hits.columns if c not in ("business_id", "origin_lat", "origin_lon", "distance_km", "stars")]
    return placed.select(
        *keep,
        "business_id",
        "name",
        F.coalesce("categories", F.lit("")).alias("categories"),
        "city",
        "state",
        stars.alias("stars"),
        distance.alias("distance_km"),
    )
