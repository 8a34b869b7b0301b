"""Curated business tables, cohorts, profiles and data tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import semistructured as S
from waymark.operators import attributes as A
from waymark.operators import cohort, dedupe, profile, quality, scope
from waymark.sources.sample_views import SampleViews

REVIEW_CUTOFF = "1998-01-01"
# Declared columns of the wide attribute table.
WIDE = {
    "_Attr": ["WiFi", "BikeParking", "RestaurantsPriceRange2", "Ambience"],
    "_Hour": ["Monday", "Sunday"],
    "_Ambience": ["romantic", "casual", "hipster"],
}
NUMERIC = ["id", "latitude", "longitude", "stars", "review_count"]


def business_scope(v: SampleViews) -> DataFrame:
    return scope.in_scope(v.business()).drop("is_open")


def business_model(v: SampleViews) -> DataFrame:
    return scope.curated(v.business())


def category_model(v: SampleViews) -> DataFrame:
    return cohort.categories(v.business())


def category_vocab(v: SampleViews) -> DataFrame:
    return cohort.vocabulary(v.business())


def attribute_model(v: SampleViews) -> DataFrame:
    return A.flatten(v.business())


def attribute_nested(v: SampleViews) -> DataFrame:
    return A.nested(A.flatten(v.business()))


def attribute_final(v: SampleViews) -> DataFrame:
    return A.final(A.flatten(v.business()))


def attribute_truthful(v: SampleViews) -> DataFrame:
    return A.truthful(A.final(A.flatten(v.business())))


def attribute_map(v: SampleViews) -> DataFrame:
    return A.attribute_objects(v.business()).withColumn("attributes", F.to_json("attributes"))


def attribute_wide(v: SampleViews) -> DataFrame:
    return A.widen(v.business(), WIDE)


def filtered_attributes(v: SampleViews) -> DataFrame:
    objects = A.attribute_objects(v.business())
    return cohort.filtered_attributes(objects, scope.filtered(v.business())).withColumn(
        "attributes", F.to_json("attributes")
    )


def engineered(v: SampleViews) -> DataFrame:
    """Filtered businesses with their attribute map (a map, not text).

    The star filter comes before the flattening, so attributes of businesses
    that the join would drop are never shuffled.
    """
    rows = v.business().filter(F.col("stars") >= scope.MIN_STARS)
    return cohort.engineered(scope.filtered(rows), A.attribute_objects(rows))


def engineered_businesses(v: SampleViews) -> DataFrame:
    return engineered(v).withColumn("attributes", F.to_json("attributes"))


def category_attributes(v: SampleViews) -> DataFrame:
    rows = v.business().filter(F.col("stars") >= scope.MIN_STARS)
    return cohort.category_attributes(
        cohort.filtered_categories(scope.filtered(rows)), A.attribute_objects(rows)
    )


def kb_join(v: SampleViews) -> DataFrame:
    return category_attributes(v).withColumn("attributes", F.to_json("attributes"))


def filtered_categories(v: SampleViews) -> DataFrame:
    return cohort.filtered_categories(scope.filtered(v.business()))


def table_counts(v: SampleViews) -> DataFrame:
    return profile.row_counts(
        {"filtered_businesses": scope.filtered(v.business()), "engineered_businesses": engineered(v)}
    )


def _relevant_reviews(v: SampleViews) -> DataFrame:
    return cohort.relevant_reviews(v.review(), scope.filtered(v.business()), REVIEW_CUTOFF)


def relevant_reviews(v: SampleViews) -> DataFrame:
    return _relevant_reviews(v).withColumn("date", F.to_date("date"))


def relevant_users(v: SampleViews) -> DataFrame:
    return cohort.relevant_users(v.user(), _relevant_reviews(v)).select(
        "user_id", "name", "categories"
    )


def _loaded_twice(v: SampleViews) -> DataFrame:
    again = v.business().withColumn("review_count", F.col("review_count") + 1)
    return v.business().unionByName(again).unionByName(v.business())


def kb_dedupe(v: SampleViews) -> DataFrame:
    """First row per business of a table that was loaded more than once."""
    kept = dedupe.keep_first(
        _loaded_twice(v), "business_id", F.asc("id"), F.desc("review_count"), F.asc("name")
    )
    return kept.select("business_id", "name", "review_count")


def row_dedupe(v: SampleViews) -> DataFrame:
    return dedupe.whole_rows(_loaded_twice(v))


def declared_tests(v: SampleViews) -> DataFrame:
    """The data tests declared for the models, with their failing rows."""
    models = {
        "curated_business": scope.curated(v.business()),
        "categories": cohort.categories(v.business()),
        "attributes": A.flatten(v.business()),
    }
    return quality.run_declared(
        models,
        [
            ("curated_business", "business_id", "unique"),
            ("curated_business", "business_id", "not_null"),
            ("categories", "business_id", "not_null"),
            ("attributes", "business_id", "not_null"),
        ],
    )


def profile_numeric(v: SampleViews) -> DataFrame:
    stats = profile.numeric(v.business(), NUMERIC)
    return stats.select(
        "column_name",
        F.col("count").alias("value_count"),
        *[F.round(c, 6).alias(c + "_value") for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


def profile_nulls(v: SampleViews) -> DataFrame:
    return profile.null_counts(v.business())


def profile_counts(v: SampleViews) -> DataFrame:
    return profile.value_counts(v.business())


def dq_unique(v: SampleViews) -> DataFrame:
    return quality.not_unique(cohort.categories(v.business()), "business_id")


def dq_not_null(v: SampleViews) -> DataFrame:
    return quality.null_keys(v.business(), "categories").select("business_id")


def dq_foreign_key(v: SampleViews) -> DataFrame:
    """Categories of businesses that the curated table leaves out."""
    return quality.orphans(cohort.categories(v.business()), scope.curated(v.business()), "business_id")


def region_supported(v: SampleViews) -> DataFrame:
    state = scope.supported_region(F.col("place"))
    return v.user().select("user_id", "place", state.alias("region"), state.isNotNull().alias("supported"))


def weekday_hours(v: SampleViews) -> DataFrame:
    """Opening hours parsed to a map, one row per day."""
    return v.business().select(
        "business_id", F.explode(S.hours_object(F.col("hours"))).alias("day", "open_hours")
    )
