"""Stored user preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import preference_set
from waymark.sources.writers import upsert


def preference_sets(users: DataFrame) -> DataFrame:
    """Each user's preferences as a sorted set."""
    return users.select(
        "user_id", "name", preference_set(F.col("categories")).alias("preferences")
    )


def look_up(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """The preference rows of the wanted users (one column, ``user_id``)."""
    return users.join(wanted.select("user_id").distinct(), "user_id", "left_semi")


def store_liked(users: DataFrame, sets: DataFrame, add_users: bool = False) -> DataFrame:
    """The preference table with the liked categories in place of the old list.

    A user who liked nothing keeps the old list. An unknown user is left out,
    or added without a name with ``add_users`` (a registration).
    """
    liked = sets.filter(F.col("liked") != "").select("user_id", F.col("liked").alias("categories"))
    return upsert(users.select("user_id", "name", "categories"), liked, "user_id", insert=add_users)
