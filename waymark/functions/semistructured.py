"""JSON, map and vector-text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_TYPE = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP_TYPE)


def json_object(col: Column) -> Column:
    """JSON object text to a string map; anything else to an empty map."""
    return F.coalesce(F.from_json(col, MAP_TYPE), empty_map())


def hours_object(col: Column) -> Column:
    """Opening hours to a map; NULL, '', 'None' and invalid text are empty."""
    return json_object(F.nullif(F.nullif(col, F.lit("")), F.lit("None")))


def repair_literal(col: Column, keep_words: bool = False) -> Column:
    """Python dict text to JSON text.

    The plain form replaces, in this order, single quotes by double quotes,
    ``None`` by ``null`` and ``u"`` by ``"``; a word that ends in ``u`` loses
    it. ``keep_words`` touches the ``u`` and ``None`` only where a token
    starts. Both lower the bare truth words, which Spark's parser rejects.
    """
    # The replacements and their order.
    if keep_words:
        text = F.regexp_replace(col, r"(?<=[{\[,:]\s{0,4})u(?=['\"])", "")
        text = F.replace(text, F.lit("'"), F.lit('"'))
        text = F.regexp_replace(text, r"(?<=[\[,:]\s{0,4})None(?=\s*[,}\]])", "null")
    else:
        text = F.replace(col, F.lit("'"), F.lit('"'))
        text = F.replace(text, F.lit("None"), F.lit("null"))
        text = F.replace(text, F.lit('u"'), F.lit('"'))
    text = F.regexp_replace(text, r": *True", ": true")
    return F.regexp_replace(text, r": *False", ": false")


STRING_TOKEN = r"""[uU]?(?:'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+")"""
NUMBER_TOKEN = r"[-+]?(?:\d[\d_]*+(?:\.\d*+)?+|\.\d++)(?:[eE][-+]?\d++)?+"
# Text in runs, escapes and characters that JSON wants escaped.
STRING_PART = r"""\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[\s\S]|[^\\"\x00-\x1f]++|["\x00-\x1f]"""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _json_escape(part: Column) -> Column:
    """A part of a Python string as it stands in a JSON string."""

    def unicode(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, "0"))

    second = F.substring(part, 2, 1)
    return (
        F.when(part == "\\'", F.lit("'"))
        .when(part == "\\\n", F.lit(""))
        .when(part == "\\a", F.lit("\\u0007"))
        .when(part == "\\v", F.lit("\\u000b"))
        .when(part.startswith("\\x") & (F.length(part) == 4), F.concat(F.lit("\\u00"), F.substring(part, 3, 2)))
        .when(part.rlike(r"^\\[0-7]"), unicode(F.conv(F.substring(part, 2, 3), 8, 10).cast("long")))
        # What JSON has as well; a name or eight digits it lacks, so that the whole is no JSON.
        .when(part.startswith("\\") & (second.isin(*'\\"nrtbfNU') | part.rlike(r"^\\u[0-9a-fA-F]{4}$")), part)
        .when(part.startswith("\\") & second.isin("x", "u"), F.lit("\\U"))
        .when(part.startswith("\\"), F.concat(F.lit("\\"), part))
        .when(part == '"', F.lit('\\"'))
        .when(part.rlike(r"^[\x00-\x1f]$"), unicode(F.ascii(part).cast("long")))
        .otherwise(part)
    )


def _json_string(token: Column) -> Column:
    """The inside of a JSON string for a Python string."""

    def escaped(body: Column) -> Column:
        parts = F.regexp_extract_all(body, F.lit(STRING_PART), F.lit(0))
        return F.when(body.rlike(r'[\\"\x00-\x1f]'), F.array_join(F.transform(parts, _json_escape), "")).otherwise(body)

    return _let(F.regexp_extract(token, r"""^[uU]?['"]([\s\S]*)['"]$""", 1), escaped)


def literal_json(col: Column) -> Column:
    """Python literal text to JSON text, read token by token.

    Apostrophes and words inside strings stay as they are. Strings take either
    quote, a ``u`` prefix and Python's escapes, and join where they stand side
    by side; ``True``, ``False`` and ``None`` become JSON's words, which are
    taken as well; tuples become arrays; a comma before a closing bracket
    goes; keys that are numbers or words become strings. Text that is no
    such literal becomes no JSON. NULL stays NULL.

    Not read, so no JSON: sets, bytes, raw and triple-quoted strings, complex
    and hexadecimal numbers, ``\\N`` and ``\\U`` escapes. A single value in
    round brackets becomes an array of one.
    """
    tokens = F.regexp_extract_all(col, F.lit(rf"{STRING_TOKEN}|{NUMBER_TOKEN}|\w++|\S"), F.lit(0))
    # The words of both languages.
    words = {"True": "true", "False": "false", "None": "null", "true": "true", "false": "false", "null": "null"}

    def is_string(token: Column) -> Column:
        return F.coalesce(token.rlike(r"""^[uU]?['"].*"""), F.lit(False))

    def number(token: Column) -> Column:
        plain = F.translate(token, "+_", "")
        plain = F.when(token.rlike("[eE]"), F.replace(token, F.lit("_"), F.lit(""))).otherwise(plain)
        plain = F.regexp_replace(plain, r"^\+", "")
        plain = F.regexp_replace(plain, r"^(-?)\.", "$10.")
        return F.regexp_replace(plain, r"\.(?!\d)", ".0")

    def said(token: Column, before: Column, after: Column) -> Column:
        quoted = F.when(after == ":", F.lit('"')).otherwise(F.lit(""))
        word = F.coalesce(*[F.when(token == python, F.lit(json)) for python, json in words.items()])
        word = F.when(after == ":", token).otherwise(word)
        closes = token.isin(",") & after.isin(")", "]", "}") & ~before.isin("(", "[", "{", ",")
        return (
            F.when(
                is_string(token),
                F.concat(
                    F.when(is_string(before), F.lit("")).otherwise(F.lit(' "')),
                    _json_string(token),
                    F.when(is_string(after), F.lit("")).otherwise(F.lit('"')),
                ),
            )
            .when(F.coalesce(closes, F.lit(False)), F.lit(""))
            .when(token == "(", F.lit(" ["))
            .when(token == ")", F.lit(" ]"))
            .when(token.isin(*"[]{},:"), token)
            .when(token.isin(*words), F.concat(F.lit(" "), quoted, word, quoted))
            .when(token.rlike(r"^[-+]?\.?\d"), F.concat(F.lit(" "), quoted, number(token), quoted))
            .otherwise(F.lit(" !"))
        )

    def joined(all_tokens: Column) -> Column:
        said_tokens = F.transform(
            all_tokens, lambda token, at: said(token, F.get(all_tokens, at - 1), F.get(all_tokens, at + 1))
        )
        return F.array_join(said_tokens, "")

    return _let(tokens, joined)


def literal_object(col: Column) -> Column:
    """JSON object or Python dict text to a string map, empty on any error.

    Text that is JSON as it stands is not touched; what is not is read as a
    Python literal (:func:`literal_json`). Values that are objects or arrays
    themselves are JSON text.
    """
    # In an array, so that anything behind the object is an error too.
    several = F.from_json(F.concat(F.lit("["), literal_json(col), F.lit("]")), f"array<{MAP_TYPE}>")
    literal = _let(several, lambda found: F.when(F.size(found) == 1, found[0]))
    strict = {"allowSingleQuotes": "false"}
    return F.coalesce(F.from_json(col, MAP_TYPE, strict), literal, empty_map())


def sorted_map(col: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(col)))


def vector_to_text(col: Column) -> Column:
    return F.to_json(col)


def text_to_vector(col: Column, dim: int | None = None) -> Column:
    """JSON array text to a vector; a wrong length is an error, not a NULL."""
    vec = F.from_json(col, "array<float>")
    if dim is None:
        return vec
    return F.when(F.size(vec) == dim, vec).otherwise(
        F.when(
            vec.isNotNull(),
            F.raise_error(F.lit(f"vector is not {dim} wide")).cast("array<float>"),
        )
    )
