"""Places and recommendation searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import cohort, embed, geo_join, intent, nearest, preferences, prompts, search
from waymark.plans.knowledge import _prose, combined_text, knowledge_base
from waymark.sources.sample_views import SampleViews

KNN = 10


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _spots(v: SampleViews) -> DataFrame:
    """Every gazetteer place as a point."""
    places = geo_join.gazetteer(v.business())
    return places.select(F.concat_ws("/", "city", "state").alias("query_id"), "latitude", "longitude")


def _business_points(v: SampleViews) -> DataFrame:
    return v.business().select(F.col("business_id").alias("item_id"), "latitude", "longitude")


def gazetteer(v: SampleViews) -> DataFrame:
    return geo_join.gazetteer(v.business())


def geo_radius(v: SampleViews) -> DataFrame:
    pairs = geo_join.within_radius(_spots(v), _business_points(v))
    return _rounded(pairs.toDF("place", "business_id", "distance_km"), "distance_km")


def geo_nearest(v: SampleViews) -> DataFrame:
    found = geo_join.closest(_spots(v), _business_points(v), KNN)
    return _rounded(found.toDF("place", "business_id", "distance_km", "rank"), "distance_km")


def _items(v: SampleViews) -> DataFrame:
    return search.as_items(v.business_vectors())


def _vector_queries(v: SampleViews) -> DataFrame:
    return v.vectors().select(F.col("vec_id").cast("string").alias("query_id"), "vector")


def _knn(v: SampleViews, metric: str, score: str) -> DataFrame:
    found = nearest.nearest(_vector_queries(v), _items(v), KNN, metric, width=v.vector_width())
    return found.select("query_id", "rank", F.col("item_id").alias("business_id"), F.round(score, 6).alias(score))


def knn_l2(v: SampleViews) -> DataFrame:
    return _knn(v, "l2", "l2")


def knn_ip(v: SampleViews) -> DataFrame:
    return _knn(v, "ip", "ip")


def knn_cosine(v: SampleViews) -> DataFrame:
    return _knn(v, "cosine", "cosine")


def knn_pivots(v: SampleViews) -> DataFrame:
    """The same as knn_l2, searched by cells around pivots as very large tables are."""
    found = nearest.nearest_by_pivots(_vector_queries(v), _items(v), KNN, "l2", pivots=32)
    return found.select("query_id", "rank", F.col("item_id").alias("business_id"), F.round("l2", 6).alias("l2"))


def knn_lsh(v: SampleViews) -> DataFrame:
    found = nearest.nearest_lsh(_vector_queries(v), _items(v), KNN)
    return found.select("query_id", "rank", F.col("item_id").alias("business_id"), F.round("cosine", 6).alias("cosine"))


def _located(v: SampleViews, queries: DataFrame | None = None) -> DataFrame:
    queries = v.message_queries() if queries is None else queries
    return geo_join.locate(queries, geo_join.gazetteer(v.business()))


def search_cli(v: SampleViews) -> DataFrame:
    return search.cli_search(_located(v), _items(v), width=v.vector_width())


def search_form(v: SampleViews) -> DataFrame:
    return search.form_search(_located(v), _items(v), width=v.vector_width())


def search_near(v: SampleViews) -> DataFrame:
    return search.near_search(_located(v), _items(v), width=v.vector_width())


def search_global(v: SampleViews) -> DataFrame:
    return search.global_search(v.message_queries(), _items(v), width=v.vector_width())


def search_kb(v: SampleViews) -> DataFrame:
    return search.kb_search(v.message_queries(), _items(v), width=v.vector_width())


def search_followup(v: SampleViews) -> DataFrame:
    hits = search.follow_up(v.follow_up_queries(), search.cli_search(_located(v), _items(v), width=v.vector_width()), _items(v))
    names = v.business().select("business_id", "name", "categories")
    return hits.join(names, "business_id")


def followup_best(v: SampleViews) -> DataFrame:
    """The one best hit of every follow-up, if it is similar enough."""
    before = search.cli_search(_located(v), _items(v), width=v.vector_width())
    return search.follow_up(v.follow_up_queries(), before, _items(v), 1)


def search_text(v: SampleViews) -> DataFrame:
    """Message text against business texts, both through the same encoder."""
    docs = embed.embed_words(combined_text(v), "combined_text").select(
        F.col("business_id").alias("item_id"), "vector"
    )
    asked = v.chat().filter("role = 'user'").select(
        F.expr("conv_id || '-' || turn").alias("query_id"), "wish"
    )
    return search.global_search(embed.embed_words(asked, "wish"), docs, search.KB_RESULTS, few=True)


def search_kb_text(v: SampleViews) -> DataFrame:
    """Message text against the knowledge-base documents, by squared distance."""
    docs = knowledge_base(v).select(F.col("id").alias("item_id"), "vector")
    asked = v.chat().filter("role = 'user'").select(
        F.expr("conv_id || '-' || turn").alias("query_id"), "wish"
    )
    return search.kb_search(embed.embed_words(asked, "wish"), docs, few=True)


def _presented(v: SampleViews) -> DataFrame:
    asked = _located(v).select(
        "query_id", F.col("latitude").alias("origin_lat"), F.col("longitude").alias("origin_lon")
    )
    hits = search.kb_search(v.message_queries(), _items(v), width=v.vector_width()).join(asked, "query_id", "left")
    return search.present(hits, v.business())


def search_presented(v: SampleViews) -> DataFrame:
    return _presented(v)


def prompt_table(v: SampleViews) -> DataFrame:
    return prompts.prompt_table(v.message_queries(), _presented(v))


def prefs_recommend(v: SampleViews) -> DataFrame:
    queries = _located(v, v.preference_queries())
    found = search.preference_search(queries, _items(v), width=v.vector_width())
    names = v.business().select("business_id", "name", "city", "state", "categories")
    return found.withColumnRenamed("query_id", "user_id").join(names, "business_id")


def prefs_text_recommend(v: SampleViews) -> DataFrame:
    """Best business near each user for the user's preference text."""
    asked = v.user().select(F.col("user_id").alias("query_id"), "city", "state", "categories")
    queries = geo_join.locate(embed.embed_words(asked, "categories"), geo_join.gazetteer(v.business()))
    texts = embed.embed_words(_prose(v), "combined_text")
    found = search.preference_search(queries, search.as_items(texts), few=True)
    return found.withColumnRenamed("query_id", "user_id")


def text_search(v: SampleViews) -> DataFrame:
    """Businesses near the place that a message names, for what it says:
    place, query vector and hits all come from the text."""
    asked = v.chat().filter("role = 'user'").select(
        F.expr("conv_id || '-' || turn").alias("query_id"), "conv_id", "turn", F.col("wish").alias("text")
    )
    named = intent.intent(asked.select("conv_id", "turn", "text"), cohort.vocabulary(v.business()))
    placed = geo_join.locate_text(asked, named, geo_join.gazetteer(v.business()))
    texts = embed.embed_words(_prose(v), "combined_text")
    found = search.near_search(embed.embed_words(placed, "text"), search.as_items(texts), few=True)
    return found.join(asked.select("query_id", "conv_id", "turn"), "query_id")


def search_text_near(v: SampleViews) -> DataFrame:
    return text_search(v).drop("query_id")


def user_preferences(v: SampleViews) -> DataFrame:
    sets = preferences.preference_sets(v.user())
    return sets.withColumn("preferences", F.array_join("preferences", ", "))


def preference_lookup(v: SampleViews) -> DataFrame:
    """Stored preferences of every user who has chatted."""
    found = preferences.look_up(v.user(), v.chat().select("user_id"))
    return found.select("user_id", "name", "categories")
