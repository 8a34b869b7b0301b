"""Nested business attributes: flatten, repair, clean, regroup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import semistructured as S
from waymark.operators.scope import STATES, in_scope

EAV = ("business_id", "attribute_name", "attribute_value")


def _members(text: Column, strict: bool) -> Column:
    """Members of a JSON object as an array of (key, value text).

    A JSON null has a NULL value; NULL text, an empty object and anything but
    an object have no members. ``strict`` ends the job on malformed JSON,
    which otherwise has no members either.
    """
    parse = F.parse_json if strict else F.try_parse_json
    members = F.map_entries(F.try_variant_get(parse(text), "$", "map<string,variant>"))
    return F.transform(
        members,
        lambda m: F.struct(m["key"].alias("key"), m["value"].cast("string").alias("value")),
    )


def flatten(business: DataFrame, strict: bool = True, states=STATES) -> DataFrame:
    """In-scope attributes as (business_id, attribute_name, attribute_value)."""
    rows = in_scope(business, states)
    return rows.select("business_id", F.inline(_members(F.col("attributes"), strict))).toDF(*EAV)


def _nested_members(strict: bool, keep_words: bool, literal: bool) -> Column:
    """The opened dict of an attribute row as an array of (name, value).

    Members without a value and the text ``null`` are left out.
    """
    value = F.col("attribute_value")
    text = S.literal_json(value) if literal else S.repair_literal(value, keep_words)
    kept = F.filter(_members(text, strict), lambda m: m["value"] != "null")
    return F.transform(
        kept,
        lambda m: F.struct(
            F.concat_ws("_", F.col("attribute_name"), m["key"]).alias("attribute_name"),
            m["value"].alias("attribute_value"),
        ),
    )


def nested(
    eav: DataFrame, strict: bool = True, keep_words: bool = False, literal: bool = False
) -> DataFrame:
    """Members of the values that hold a Python dict, named ``parent_child``.

    A value is taken for a dict when it has a comma, so a dict with a single
    member is not opened. The text is repaired by replacements, quirks
    included; ``literal`` reads it as Python does.
    """
    dicts = eav.filter(F.col("attribute_value").contains(","))
    return dicts.select("business_id", F.inline(_nested_members(strict, keep_words, literal)))


def final(eav: DataFrame, strict: bool = True, keep_words: bool = False) -> DataFrame:
    """Plain values and opened dicts together, cleaned.

    One pass: a row turns into its dict's members or into itself, so the
    attributes are read and parsed once. The check for ``none`` sees the
    value before its quotes are stripped, so a quoted ``'none'`` survives to
    :func:`truthful`.
    """
    value = F.col("attribute_value")
    tidy = F.replace(F.replace(value, F.lit('""'), F.lit("")), F.lit("u'none'"), F.lit("Invalid"))
    plain = F.array(F.struct("attribute_name", tidy.alias("attribute_value")))
    rows = F.when(value.contains(","), _nested_members(strict, keep_words, False)).when(
        tidy != "Invalid", plain
    )
    bare = F.replace(F.replace(value, F.lit("u'"), F.lit("")), F.lit("'"), F.lit(""))
    return (
        eav.select("business_id", F.inline(rows))
        .filter(~value.ilike("none"))
        .withColumn("attribute_value", bare)
    )


# Fixed values here and in truthful(): the texts that mean "nothing said".


def truthful(eav: DataFrame) -> DataFrame:
    """Attributes that say something: no false, none, no, empty dict, price range."""
    value, name = F.upper("attribute_value"), F.lower("attribute_name")
    return eav.filter(
        ~value.like("%FALSE%")
        & (value != "NONE")
        & (value != "NO")
        & (F.col("attribute_value") != "{}")
        & ~name.like("%restaurantspricerange%")
    )


def regroup(eav: DataFrame) -> DataFrame:
    """One map per business, names sorted; a repeated name keeps its largest value.

    The first grouping folds repeated rows before the shuffle, so a business
    with very many rows reaches the second one with one row per name.
    """
    folded = (
        eav.filter(F.col("business_id").isNotNull() & F.col("attribute_name").isNotNull())
        .groupBy("business_id", "attribute_name")
        .agg(F.max("attribute_value").alias("attribute_value"))
    )
    entries = F.array_sort(F.collect_list(F.struct("attribute_name", "attribute_value")))
    return folded.groupBy("business_id").agg(F.map_from_entries(entries).alias("attributes"))


def attribute_objects(business: DataFrame, strict: bool = True) -> DataFrame:
    """The whole chain: business rows to one cleaned attribute map each."""
    return regroup(truthful(final(flatten(business, strict), strict)))


# Attributes that hold a dict, with the suffix of their columns.
NESTED_SUFFIX = {
    "BusinessParking": "_BusinessParking",
    "Ambience": "_Ambience",
    "GoodForMeal": "_GoodForMeal",
    "Music": "_Music_expanded",
}


def _families(business: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """business_id and one map column per family of wide columns, by suffix."""
    parsed = business.select(
        "business_id",
        S.literal_object(F.col("attributes")).alias("m__Attr"),
        S.literal_object(F.col("hours")).alias("m__Hour"),
    )
    families = {"_Attr": "m__Attr", "_Hour": "m__Hour"}
    for name, suffix in NESTED_SUFFIX.items():
        families[suffix] = f"m_{suffix}"
        parsed = parsed.withColumn(f"m_{suffix}", S.literal_object(F.col("m__Attr")[name]))
    return parsed, families


def wide_names(business: DataFrame) -> DataFrame:
    """(suffix, name) of every column the rows could fill, as a table: what to
    declare for :func:`widen` is looked up here."""
    parsed, families = _families(business)

    def tag(suffix: str):
        return lambda key: F.struct(F.lit(suffix).alias("suffix"), key.alias("name"))

    tagged = F.flatten(
        F.array(*[F.transform(F.map_keys(column), tag(suffix)) for suffix, column in families.items()])
    )
    return parsed.select(F.inline(tagged)).distinct()


def widen(business: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Attributes, opening hours and nested attributes as columns.

    ``names``: the declared names per suffix (``_Attr``, ``_Hour`` and those
    of NESTED_SUFFIX). One pass, no job before it; a declared name that a row
    lacks is NULL, undeclared ones stay in the long form (:func:`flatten`).
    """
    parsed, families = _families(business)
    columns = [
        F.col(families[suffix])[name].alias(name + suffix) for suffix in sorted(names) for name in sorted(names[suffix])
    ]
    return parsed.select("business_id", *columns)
