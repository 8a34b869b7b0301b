"""Cohorts: categories, reviews, users and the engineered business table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import comma_list
from waymark.operators.scope import STATES, after, in_scope


def categories(business: DataFrame, states=STATES) -> DataFrame:
    """One row per category token of the in-scope businesses, trimmed.

    Empty tokens stay; a business without categories has no row.
    """
    return in_scope(business, states).select(
        "business_id", F.explode(comma_list(F.col("categories"))).alias("categories")
    )


def vocabulary(business: DataFrame) -> DataFrame:
    """Known lower-case cities and categories as (kind, term)."""
    city = business.filter(F.col("city").isNotNull()).select(
        F.lit("city").alias("kind"), F.lower("city").alias("term")
    )
    category = business.select(
        F.lit("category").alias("kind"),
        F.explode(comma_list(F.lower("categories"))).alias("term"),
    )
    return city.unionByName(category).distinct()


def relevant_reviews(reviews: DataFrame, business: DataFrame, cutoff: str) -> DataFrame:
    """Reviews of the given businesses after the cutoff day."""
    keys = business.select("business_id").distinct()
    return reviews.filter(after(F.col("date"), cutoff)).join(keys, "business_id", "left_semi")


def relevant_users(users: DataFrame, reviews: DataFrame) -> DataFrame:
    """Users with at least one of the given reviews.

    The ids are folded before the shuffle: a user with very many reviews
    would otherwise land whole on one task of the join's build side.
    """
    keys = reviews.select("user_id").distinct()
    return users.join(keys, "user_id", "left_semi")


def filtered_categories(filtered: DataFrame) -> DataFrame:
    return (
        filtered.filter(F.col("categories").isNotNull())
        .select("business_id", "categories")
        .distinct()
    )


def filtered_attributes(attributes: DataFrame, filtered: DataFrame) -> DataFrame:
    """Attribute maps of the filtered businesses."""
    keys = filtered.select("business_id").distinct()
    return attributes.join(keys, "business_id", "left_semi")


def engineered(filtered: DataFrame, attributes: DataFrame) -> DataFrame:
    """Filtered businesses with their cleaned attributes in place of the raw ones."""
    return filtered.drop("attributes").join(attributes, "business_id")


def category_attributes(filtered_cats: DataFrame, attributes: DataFrame) -> DataFrame:
    """Categories and attributes side by side, per business."""
    return filtered_cats.select("business_id", "categories").join(
        attributes.select("business_id", "attributes"), "business_id"
    )
