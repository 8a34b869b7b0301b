"""Chat logs as data: feedback, suggestions, chosen places, itineraries.

Input is a log ``(conv_id, turn, role, text)`` with one row per position, and
a result list ``(conv_id, turn, rank, business_id)`` of what a message finds
when it runs as a search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.ordered import running
from waymark.session import work_dir

# Phrases that mark a message as positive or negative.
POSITIVE = ("i like", "liked it", "great", "perfect", "this works", "i love it")
NEGATIVE = ("not a fan", "dislike", "something else", "another", "next", "don't", "didn't like")
NEGATIVE_SHORT = ("not a fan", "don't like", "dislike", "another", "next")


def mentions_any(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(text)
    hit = low.contains(phrases[0])
    for phrase in phrases[1:]:
        hit = hit | low.contains(phrase)
    return hit


def feedback_class(
    text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE
) -> Column:
    """``positive`` (checked first), ``negative`` or ``search``."""
    found = F.when(mentions_any(text, negative), "negative").otherwise("search")
    if not positive:
        return found
    return F.when(mentions_any(text, positive), "positive").otherwise(found)


def classify(messages: DataFrame, **phrases) -> DataFrame:
    """User messages with their class."""
    return messages.filter(F.col("role") == "user").withColumn(
        "feedback", feedback_class(F.col("text"), **phrases)
    )


def cursor(messages: DataFrame, results: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Where each user message leaves the conversation.

    Adds ``action`` and the shown item as (``shown_turn``, ``shown_rank``):
    the turn of the search whose list is current, and the place in it. The
    item reacted to is (``before_turn``, ``before_rank``), NULL if none.

    * A positive message before anything was found runs as a search.
    * A search with hits starts a list at rank 1, one without changes nothing.
    * A negative message moves one rank on; past the end it is ``no_more``.

    ``carried`` says where earlier messages left a conversation, one row each:
    conv_id, list_turn, list_size, used (how many negative messages followed
    the list). With it, the last two are added to what is returned.
    """
    n_results = results.groupBy("conv_id", "turn").agg(F.count("*").alias("n_results"))
    told = classify(messages).join(n_results, ["conv_id", "turn"], "left")
    told = told.withColumn("n_results", F.coalesce("n_results", F.lit(0)))

    # A negative message never starts a list, so the first message that can
    # start one does: until then every positive message runs as a search.
    can_start = F.col("feedback").isin("search", "positive") & (F.col("n_results") > 0)
    if carried is not None:
        told = told.join(carried, "conv_id", "left")
    nothing_before = F.lit(True) if carried is None else F.col("list_turn").isNull()
    is_search = (F.col("feedback") == "search") | (
        (F.col("feedback") == "positive") & (F.col("seen") - can_start.cast("int") == 0) & nothing_before
    )
    starts = is_search & (F.col("n_results") > 0)
    told = running(
        told,
        ["conv_id"],
        "turn",
        sums={
            "seen": can_start.cast("int"),
            "noes": (F.col("feedback") == "negative").cast("int"),
        },
        lasts={
            "list": F.when(
                starts, F.struct(F.col("turn"), F.col("n_results").alias("size"), F.col("noes"))
            )
        },
    )
    told = told.withColumns({"is_search": is_search, "starts": starts})
    if carried is not None:
        before_all = F.struct(F.col("list_turn").alias("turn"), F.col("list_size").alias("size"), (-F.col("used")).alias("noes"))
        told = told.withColumn("list", F.coalesce("list", F.when(F.col("list_turn").isNotNull(), before_all)))
    is_no = F.col("feedback") == "negative"
    used = F.col("noes") - F.col("list.noes")
    size = F.col("list.size")
    has_list = F.col("list").isNotNull()
    action = (
        F.when(F.col("starts"), "shown")
        .when(F.col("is_search"), "no_results")
        .when(F.col("feedback") == "positive", "liked")
        .when(has_list & (used < size), "next")
        .otherwise("no_more")
    )
    reacts = has_list & ~F.col("is_search")
    before = F.least(F.when(is_no, used).otherwise(used + 1), size)
    return told.select(
        *messages.columns,
        "feedback",
        action.alias("action"),
        F.when(has_list, F.col("list.turn")).alias("shown_turn"),
        F.when(has_list, F.least(used + 1, size)).cast("int").alias("shown_rank"),
        F.when(reacts, F.col("list.turn")).alias("before_turn"),
        F.when(reacts, before).cast("int").alias("before_rank"),
        *([] if carried is None else [size.alias("list_size"), F.least(used, size).alias("used")]),
    )


def _item(moves: DataFrame, results: DataFrame, turn: str, rank: str) -> DataFrame:
    listed = results.select(
        "conv_id", F.col("turn").alias(turn), F.col("rank").alias(rank), "business_id"
    )
    return moves.join(listed, ["conv_id", turn, rank])


def last_item(moves: DataFrame, results: DataFrame) -> DataFrame:
    """The business each feedback message reacts to."""
    reacting = moves.filter(F.col("before_turn").isNotNull())
    return _item(reacting, results, "before_turn", "before_rank")


def next_suggestion(moves: DataFrame, results: DataFrame) -> DataFrame:
    """The business shown in answer to each search and each accepted 'next'."""
    answered = moves.filter(F.col("action").isin("shown", "next"))
    return _item(answered, results, "shown_turn", "shown_rank")


def category_feedback(reacted: DataFrame, business: DataFrame) -> DataFrame:
    """Distinct (user_id, feedback, category), lower-case and trimmed."""
    tokens = F.transform(F.split(F.lower("categories"), ","), lambda t: F.trim(t))
    return (
        reacted.join(business.select("business_id", "categories"), "business_id")
        .select("user_id", "feedback", F.explode(tokens).alias("category"))
        .filter(F.col("category") != "")
        .distinct()
    )


def category_sets(feedback: DataFrame) -> DataFrame:
    """Sorted liked and disliked categories per user, as comma lists.

    The rows are already distinct, so a list is as long as the vocabulary a
    user reacted to, however often the user did.
    """

    def listed(kind: str) -> Column:
        found = F.collect_set(F.when(F.col("feedback") == kind, F.col("category")))
        return F.array_join(F.array_sort(found), ", ")

    return feedback.groupBy("user_id").agg(
        listed("positive").alias("liked"), listed("negative").alias("disliked")
    )


def history(messages: DataFrame) -> DataFrame:
    """Each message with its place in the conversation, from both ends."""
    told = running(
        messages, ["conv_id"], "turn", sums={"position": F.lit(1)}, totals=["position"]
    )
    return told.select(
        *messages.columns,
        F.col("position"),
        (F.col("position_total") - F.col("position") + 1).alias("from_last"),
    )


def _named(messages: DataFrame, lists: DataFrame, results: DataFrame, places: DataFrame) -> DataFrame:
    """Messages that name a place of the list current before them, the first
    such place by rank. ``lists``: the (conv_id, turn) whose results are shown."""
    marked = lists.withColumn("listed", F.lit(True))
    told = messages.join(marked, ["conv_id", "turn"], "left")
    told = running(told, ["conv_id"], "turn", befores={"list_turn": F.when(F.col("listed"), F.col("turn"))})
    asking = told.filter(F.col("list_turn").isNotNull())
    shown = results.withColumnRenamed("turn", "list_turn").join(places, "business_id")
    named = asking.join(shown, ["conv_id", "list_turn"]).filter(F.lower("text").contains(F.lower("name")))
    first = Window.partitionBy("conv_id", "turn").orderBy("rank")
    return named.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1")


def place_selections(messages: DataFrame, results: DataFrame, business: DataFrame) -> DataFrame:
    """Messages that name a place of the list shown last before them.

    Naming comes first: such a message is a choice and not a search, whatever
    it would have found, so its own results are not shown and the list stays.
    Any other message with results starts a new list. The first place by rank
    counts; places without a name never match.

    Whether a message with results is a choice depends on the list before it,
    and so on the choices before that. The choices are worked out in rounds:
    each takes those of the round before as given, and is right at least up to
    the next such message of every conversation. When a round changes nothing
    it is the result. Few conversations need more than two.
    """
    spark = messages.sparkSession
    places = business.filter(F.length("name") > 0).select("business_id", "name", "latitude", "longitude")
    lists = results.select("conv_id", "turn").distinct()
    told, before = lists, None
    while True:
        path = work_dir(spark, "choices")
        _named(messages, told, results, places).select(
            "conv_id", "turn", "list_turn", "rank", "business_id", "name", "latitude", "longitude"
        ).write.parquet(path)
        chosen = spark.read.parquet(path)
        searches = chosen.join(lists, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")
        state = searches.agg(F.count("*"), F.sum(F.xxhash64("conv_id", "turn").cast("decimal(38,0)"))).first()
        if state == before or (before is None and state[0] == 0):
            return chosen
        before = state
        told = lists.join(searches, ["conv_id", "turn"], "left_anti")


def itinerary(selections: DataFrame) -> DataFrame:
    """Visited places in order, with the leg from the place before.

    ``visit`` counts from 1; the first leg has no length.
    """
    here = F.struct("business_id", "latitude", "longitude")
    legs = running(
        selections, ["conv_id"], "turn", sums={"visit": F.lit(1)}, befores={"from_place": here}
    )
    km = geo.geodesic_km(
        F.col("from_place.latitude"), F.col("from_place.longitude"), F.col("latitude"), F.col("longitude")
    )
    return legs.withColumn("km", km).select(
        "conv_id",
        "visit",
        "turn",
        "business_id",
        "name",
        F.col("from_place.business_id").alias("from_business_id"),
        F.when(F.col("from_place").isNotNull(), F.col("km")).alias("leg_km"),
    )


def itinerary_totals(legs: DataFrame) -> DataFrame:
    return legs.groupBy("conv_id").agg(
        F.count("*").alias("n_visits"), F.sum("leg_km").alias("total_km")
    )


def search_origins(messages: DataFrame, selections: DataFrame) -> DataFrame:
    """Mode and start point of every message: ``planning`` from the place
    chosen last, ``search`` without a start before any choice."""
    chosen = selections.select(
        "conv_id",
        "turn",
        F.struct(
            F.col("business_id").alias("origin_id"),
            F.col("latitude").alias("origin_lat"),
            F.col("longitude").alias("origin_lon"),
        ).alias("picked"),
    )
    told = messages.join(chosen, ["conv_id", "turn"], "left")
    told = running(told, ["conv_id"], "turn", lasts={"origin": F.col("picked")})
    return told.select(
        "conv_id",
        "turn",
        F.when(F.col("origin").isNull(), "search").otherwise("planning").alias("mode"),
        "origin.origin_id",
        "origin.origin_lat",
        "origin.origin_lon",
    )
