"""Text clean-up and row-to-prose expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a closed day is written, and, in the two prose functions,
# the words around keys and values.
CLOSED_ALL_DAY = "0:0-0:0"


def default_text(col: Column, default: str = "") -> Column:
    """NULL or empty text becomes ``default``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def single_line(col: Column) -> Column:
    """Line breaks become blanks. Quotes are left alone: a DataFrame write
    needs no SQL literal escaping."""
    return F.translate(col, "\n\r", "  ")


def bare_words(col: Column) -> Column:
    """Lower-case text with everything but word characters and blanks removed."""
    return F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", "")


def word_list(col: Column) -> Column:
    """The words of already cleaned text."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def comma_list(col: Column) -> Column:
    """Comma list to trimmed tokens; empty tokens stay, NULL stays NULL."""
    return F.transform(F.split(col, ","), lambda t: F.trim(t))


def preference_set(col: Column) -> Column:
    """Comma list to a sorted set of lower-case trimmed tokens."""
    tokens = F.transform(comma_list(col), lambda t: F.lower(t))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != "")))


def last_part(col: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(col, sep), -1)


def attribute_prose(attributes: Column) -> Column:
    """Attribute map to sentences, in map order.

    A true-ish value names the feature, a false-ish one is silent and any
    other value is spelled out. NULL values are silent too.
    """

    def sentence(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        spoken = F.replace(key, F.lit("_"), F.lit(" "))
        low = F.lower(value)
        return (
            F.when(
                low.isin("true", "yes"),
                F.when(key.contains("Ambience_"), F.concat(F.lit("Ambience is "), last_part(key)))
                .when(
                    key.contains("BusinessParking"),
                    F.concat(F.lit("Has "), last_part(key), F.lit(" parking")),
                )
                .otherwise(F.concat(spoken, F.lit(" available"))),
            )
            .when(~low.isin("false", "no", "null"), F.concat(spoken, F.lit(" is "), value))
        )

    lines = F.transform(F.map_entries(attributes), sentence)
    # array_join skips the NULL left by a silent entry
    return F.coalesce(F.array_join(lines, ". "), F.lit(""))


def hours_prose(hours: Column, fix_minutes: bool = False) -> Column:
    """Opening-hours map to sentences; a day that never opens is skipped.

    By default ``:0`` is widened to ``:00`` wherever it occurs, so ``8:05``
    reads ``8:005``. ``fix_minutes`` only widens a lone zero.
    """

    def widen(text: Column) -> Column:
        if fix_minutes:
            return F.regexp_replace(text, ":0(?![0-9])", ":00")
        return F.replace(text, F.lit(":0"), F.lit(":00"))

    def sentence(entry: Column) -> Column:
        return F.when(
            entry["value"] != CLOSED_ALL_DAY,
            F.concat(F.lit("Open on "), entry["key"], F.lit(" from "), widen(entry["value"])),
        )

    lines = F.transform(F.map_entries(hours), sentence)
    return F.coalesce(F.array_join(lines, ". "), F.lit(""))


def pairs_text(pairs: Column, sep: str) -> Column:
    """Map to ``k<sep>v`` items joined by a comma and a blank, in map order."""
    items = F.transform(
        F.map_entries(pairs),
        lambda e: F.concat(e["key"], F.lit(sep), F.coalesce(e["value"], F.lit("None"))),
    )
    return F.coalesce(F.array_join(items, ", "), F.lit(""))
