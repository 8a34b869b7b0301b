"""Text values that carry a bool, an integer, a float or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that reads as a float once lower-cased; keeps Java's `1d` and `0x1p3` out.
FLOAT_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)\s*$"


def number_text(col: Column) -> Column:
    """A double as plain decimal text (``4.0``, ``12345678.5``), without the
    exponent Spark's own cast uses outside 0.001 to 10 million."""
    size = F.abs(col)

    def plain(scale: int) -> Column:
        digits = F.regexp_replace(col.cast(f"decimal(38,{scale})").cast("string"), "0+$", "")
        return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    return (
        F.when((size >= 1e7) & (size < 1e16), plain(10))
        .when((size >= 1e-4) & (size < 1e-3), plain(22))
        .otherwise(col.cast("string"))
    )


def bare_text(col: Column) -> Column:
    """Double quotes and then single quotes stripped from both ends."""
    return F.btrim(F.btrim(col, F.lit('"')), F.lit("'"))


def value_kind(bare: Column) -> Column:
    """``bool``, ``int`` (digits only), ``float`` (anything that reads as a
    number, ``nan`` and ``inf`` included) or ``text``; NULL stays NULL."""
    low = F.lower(bare)
    return (
        F.when(low.isin("true", "false"), "bool")
        .when(bare.rlike("^[0-9]+$"), "int")
        .when(low.rlike(FLOAT_PATTERN), "float")
        .when(bare.isNotNull(), "text")
    )


def printed_value(bare: Column, kind: Column) -> Column:
    """The printed form of a typed value, so that two engines can compare it."""
    return (
        F.when(kind == "bool", F.initcap(F.lower(bare)))
        .when(kind == "int", F.regexp_replace(bare, "^0+(?=[0-9])", ""))
        .when(kind == "float", number_text(F.trim(bare).try_cast("double")))
        .otherwise(bare)
    )


def typed_value(col: Column) -> Column:
    """Text to ``struct<kind, value>``."""
    bare = bare_text(col)
    kind = value_kind(bare)
    return F.struct(kind.alias("kind"), printed_value(bare, kind).alias("value"))


def typed_variant(kind: Column, value: Column) -> Column:
    """The same value as a VARIANT, so JSON output keeps numbers and bools bare."""
    return (
        F.when(kind == "bool", F.lower(value).try_cast("boolean").cast("variant"))
        .when(
            (kind == "int") & value.try_cast("bigint").isNotNull(),
            value.try_cast("bigint").cast("variant"),
        )
        .when(kind == "float", value.try_cast("double").cast("variant"))
        .otherwise(value.cast("variant"))
    )
