"""Which businesses and places are in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states served, and the weekdays in table order.
STATES = ("PA", "FL", "TN", "IN", "MO")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MIN_STARS = 3.0

PROFILE_COLUMNS = (
    "business_id",
    "name",
    "address",
    "city",
    "state",
    "postal_code",
    "latitude",
    "longitude",
    "stars",
    "review_count",
    "categories",
)


def in_scope(business: DataFrame, states=STATES) -> DataFrame:
    """Open businesses in the served states, whatever their stars."""
    return business.filter(F.col("is_open") & F.col("state").isin(*states))


def curated(business: DataFrame, states=STATES, min_stars: float = MIN_STARS) -> DataFrame:
    """Scope plus a star minimum, with one column per weekday's hours."""
    days = [F.get_json_object("hours", f"$.{day}").alias(day.lower()) for day in WEEKDAYS]
    return (
        in_scope(business, states)
        .filter(F.col("stars") >= min_stars)
        .select(*PROFILE_COLUMNS, *days)
    )


def filtered(business: DataFrame, states=STATES, min_stars: float = MIN_STARS) -> DataFrame:
    """Scope plus a star minimum, every column but ``is_open``."""
    return in_scope(business, states).filter(F.col("stars") >= min_stars).drop("is_open")


def after(date: Column, cutoff: str) -> Column:
    """Strictly after the cutoff day."""
    return F.to_date(date) > F.to_date(F.lit(cutoff))


def supported_region(place: Column, states=STATES) -> Column:
    """First state code that stands as a word in free text, else NULL.

    The English word "in" reads as Indiana, as in any plain code match.
    """
    found = F.regexp_extract(F.upper(place), rf"\b({'|'.join(states)})\b", 1)
    return F.nullif(found, F.lit(""))
