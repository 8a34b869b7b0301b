"""Conversation analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import cohort, preferences, search
from waymark.operators import conversation as C
from waymark.operators import intent as I
from waymark.session import work_dir
from waymark.plans import recommend
from waymark.sources import writers
from waymark.sources.sample_views import SampleViews


def feedback_class(v: SampleViews) -> DataFrame:
    told = C.classify(v.chat())
    return told.select(
        "conv_id",
        "turn",
        "feedback",
        C.feedback_class(F.col("text"), positive=(), negative=C.NEGATIVE_SHORT).alias("feedback_short"),
    )


def _moves(v: SampleViews) -> DataFrame:
    return C.cursor(v.chat().select("conv_id", "turn", "role", "user_id", "text"), v.results())


def feedback_status(v: SampleViews) -> DataFrame:
    return _moves(v).select("conv_id", "turn", "feedback", "action", "shown_turn", "shown_rank")


def last_item(v: SampleViews) -> DataFrame:
    return C.last_item(_moves(v), v.results()).select("conv_id", "turn", "feedback", "business_id")


def next_suggestion(v: SampleViews) -> DataFrame:
    return C.next_suggestion(_moves(v), v.results()).select(
        "conv_id", "turn", "action", "shown_turn", "shown_rank", "business_id"
    )


def _liked(v: SampleViews) -> DataFrame:
    reacted = C.last_item(_moves(v), v.results())
    return C.category_sets(C.category_feedback(reacted, v.business()))


def liked_categories(v: SampleViews) -> DataFrame:
    return _liked(v)


def liked_from_search(v: SampleViews) -> DataFrame:
    """From message to preference: each message is searched for by its own
    text and place, and the reactions are to what that search showed."""
    results = recommend.text_search(v).select("conv_id", "turn", "rank", "business_id")
    messages = v.chat().select("conv_id", "turn", "role", "user_id", "text")
    reacted = C.last_item(C.cursor(messages, results), results)
    return C.category_sets(C.category_feedback(reacted, v.business()))


def _stored_preferences(v: SampleViews, label: str, add_users: bool) -> DataFrame:
    path = work_dir(v.spark, label)
    writers.replace_table(v.user().select("user_id", "name", "categories"), path)
    stored = writers.read_table(v.spark, path)
    writers.replace_table(preferences.store_liked(stored, _liked(v), add_users=add_users), path)
    return writers.read_table(v.spark, path)


def prefs_upsert(v: SampleViews) -> DataFrame:
    """The stored preference table, laid over with what was liked, read back."""
    return _stored_preferences(v, "preferences", add_users=False)


def prefs_register(v: SampleViews) -> DataFrame:
    """The same with a row for everyone who liked something and is not in the table."""
    return _stored_preferences(v, "registered", add_users=True)


def intent(v: SampleViews) -> DataFrame:
    asked = v.chat().filter("role = 'user'").select("conv_id", "turn", F.col("wish").alias("text"))
    return I.intent(asked, cohort.vocabulary(v.business()))


def _selections(v: SampleViews) -> DataFrame:
    return C.place_selections(v.place_messages(), v.results(), v.business())


def place_mentions(v: SampleViews) -> DataFrame:
    return _selections(v).select("conv_id", "turn", "list_turn", "rank", "business_id", "name")


def itinerary_legs(v: SampleViews) -> DataFrame:
    return C.itinerary(_selections(v)).withColumn("leg_km", F.round("leg_km", 6))


def itinerary_totals(v: SampleViews) -> DataFrame:
    return C.itinerary_totals(C.itinerary(_selections(v))).withColumn(
        "total_km", F.round("total_km", 6)
    )


def planning_search(v: SampleViews) -> DataFrame:
    """Hits of every message with the distance from the place chosen last."""
    chosen = _selections(v)
    origins = C.search_origins(v.place_messages(), chosen)
    # A message that chose a place was no search.
    hits = v.results().join(chosen, ["conv_id", "turn"], "left_anti").join(origins, ["conv_id", "turn"])
    shown = search.present(hits, v.business())
    return shown.select("conv_id", "turn", "rank", "mode", "origin_id", "business_id", "name", "stars", "distance_km")


def chat_history(v: SampleViews) -> DataFrame:
    return C.history(v.chat().select("conv_id", "turn", "role", "text"))
