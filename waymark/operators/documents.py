"""One text document, and its metadata, per business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import semistructured as S
from waymark.functions import text as T
from waymark.functions.typed import bare_text, number_text, printed_value, typed_variant, value_kind

# The name of a nameless business, and, in the functions below,
# the labels of document lines and the names of metadata fields.
UNNAMED = "Unknown Business"


def prose(engineered: DataFrame, fix_minutes: bool = False) -> DataFrame:
    """Adds ``attribute_text``, ``hours_text`` and ``combined_text``.

    Businesses whose attribute text still names a price range are left out.
    Rows that agree in everything the text is made from, and in the postal
    code, are folded into one.
    """
    attribute_text = F.coalesce(T.attribute_prose(F.col("attributes")), F.lit(""))
    hours_text = T.hours_prose(S.hours_object(F.col("hours")), fix_minutes)
    return (
        engineered.withColumn("attribute_text", attribute_text)
        .filter(~F.col("attribute_text").contains("RestaurantsPriceRange"))
        .withColumn("hours_text", hours_text)
        .withColumn(
            "combined_text",
            F.concat(
                F.lit("Categories: "),
                F.coalesce("categories", F.lit("")),
                F.lit(". "),
                F.col("attribute_text"),
                F.lit(". "),
                F.col("hours_text"),
                F.lit(". Rated "),
                F.coalesce(number_text(F.col("stars")), F.lit("nan")),
                F.lit(" stars."),
            ),
        )
        .select(
            "business_id",
            T.single_line(F.col("name")).alias("name"),
            "city",
            "state",
            "latitude",
            "longitude",
            T.single_line(F.col("categories")).alias("categories"),
            "attribute_text",
            "hours_text",
            T.single_line(F.col("combined_text")).alias("combined_text"),
            "postal_code",
            F.to_json("attributes").alias("attributes"),
        )
        .dropDuplicates()
        .drop("postal_code", "attributes")
    )


def typed_entries(attributes: Column) -> Column:
    """Attribute map to an array of (name, kind, value); NULL values are dropped.

    In steps, because a lambda works out each expression as often as it is
    mentioned.
    """
    kept = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull())
    bare = F.transform(kept, lambda e: F.struct(e["key"].alias("name"), bare_text(e["value"]).alias("bare")))
    kinds = F.transform(
        bare, lambda e: F.struct(e["name"], value_kind(e["bare"]).alias("kind"), e["bare"])
    )
    typed = F.transform(
        kinds,
        lambda e: F.struct(e["name"], e["kind"], printed_value(e["bare"], e["kind"]).alias("value")),
    )
    return F.coalesce(typed, F.array().cast("array<struct<name:string,kind:string,value:string>>"))


def typed_attributes(objects: DataFrame) -> DataFrame:
    """Attribute maps as typed rows: (business_id, name, kind, value)."""
    return objects.select("business_id", F.inline(typed_entries(F.col("attributes"))))


def _typed_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit("="), e["value"])), ", ")


def document_v1() -> Column:
    """Three lines: id, categories, attributes."""
    return F.concat(
        F.lit("Business ID: "), "business_id",
        F.lit("\nCategories: "), "categories",
        F.lit("\nAttributes: "), _typed_text(F.col("entries")),
        F.lit("\n"),
    )


def document_v2() -> Column:
    """Six lines: name, address, categories, rating, attributes, hours."""
    blank = lambda c: T.default_text(F.col(c))
    return F.concat(
        F.lit("Business Name: "), T.default_text(F.col("name"), UNNAMED),
        F.lit("\nAddress: "), blank("address"), F.lit(", "), blank("city"),
        F.lit(", "), blank("state"), F.lit(" "), blank("postal_code"),
        F.lit("\nCategories: "), blank("categories"),
        F.lit("\nRating: "), F.coalesce(number_text(F.col("stars")), F.lit("None")),
        F.lit(" stars ("), F.coalesce(F.col("review_count").cast("string"), F.lit("None")),
        F.lit(" reviews)"),
        F.lit("\nAttributes: "), _typed_text(F.col("entries")),
        F.lit("\nHours: "), T.pairs_text(S.hours_object(F.col("hours")), ": "),
        F.lit("\n"),
    )


def _variant(col: Column) -> Column:
    return col.cast("variant")


def base_v1() -> Column:
    """Categories and attribute text."""
    return F.create_map(
        F.lit("categories"), _variant(F.col("categories")),
        F.lit("attribute_text"), _variant(_typed_text(F.col("entries"))),
    )


def base_v2() -> Column:
    """Eight business fields."""
    values = {
        "name": T.default_text(F.col("name"), UNNAMED),
        "city": T.default_text(F.col("city")),
        "state": T.default_text(F.col("state")),
        "stars": F.col("stars"),
        "review_count": F.col("review_count"),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
        "categories": T.default_text(F.col("categories")),
    }
    return F.create_map(*[part for k, v in values.items() for part in (F.lit(k), _variant(v))])


def _kb_rows(rows: DataFrame, document: Column, base: Column) -> DataFrame:
    """(business_id, document, metadata) in one pass over the rows.

    Metadata is the base map with the typed attributes laid over fields of
    the same name, as JSON text with sorted keys. Each step is a column that
    the next one mentions twice, which keeps the optimizer from folding it
    into a lambda.
    """
    over = F.map_from_entries(
        F.transform("entries", lambda e: F.struct(e["name"], typed_variant(e["kind"], e["value"])))
    )
    taken = F.transform("entries", lambda e: e["name"])
    free = F.array_except(F.map_keys("base"), taken)
    kept = F.map_filter("base", lambda k, v: F.array_contains(F.col("free"), k) & v.isNotNull())
    keep = ("business_id", "document")
    merged = (
        rows.withColumn("entries", typed_entries(F.col("attributes")))
        .select("business_id", document.alias("document"), "entries", base.alias("base"))
        .select(*keep, "base", over.alias("over"), free.alias("free"))
        .select(*keep, F.map_concat(kept, F.col("over")).alias("merged"))
    )
    keys = F.array_sort(F.map_keys("merged"))
    pairs = F.transform(keys, lambda k: F.struct(k, F.col("merged")[k]))
    return merged.select(*keep, F.to_json(F.map_from_entries(pairs)).alias("metadata"))


def kb_v1(category_attributes: DataFrame) -> DataFrame:
    """Knowledge-base rows from categories and attributes alone."""
    return _kb_rows(category_attributes, document_v1(), base_v1())


def kb_v2(engineered: DataFrame) -> DataFrame:
    """Knowledge-base rows from the engineered businesses."""
    return _kb_rows(engineered, document_v2(), base_v2())
