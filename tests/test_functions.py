"""Column expressions on literal rows."""

import ast
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, semistructured as S, text as T, vectors as V
from waymark.functions.typed import number_text, typed_value
from waymark.operators import attributes
from waymark.operators.scope import supported_region
from waymark.operators.search import seeded_between


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("True", "bool", "True"),
        ("'false'", "bool", "False"),
        ('"12"', "int", "12"),
        ("007", "int", "7"),
        ("-5", "float", "-5.0"),
        ("4.50", "float", "4.5"),
        ("1e3", "float", "1000.0"),
        ("12345678.5", "float", "12345678.5"),
        ("0.0005", "float", "0.0005"),
        ("nan", "float", "NaN"),
        ("u'free'", "text", "u'free"),
        ("1d", "text", "1d"),
        ("", "text", ""),
        (None, None, None),
    ],
)
def test_typed_value(spark, text, kind, value):
    assert tuple(one(spark, typed_value(F.col("x")), text)) == (kind, value)


def test_number_text(spark):
    assert one(spark, number_text(F.col("x")), 4.0, "double") == "4.0"
    assert one(spark, number_text(F.col("x")), 1e7, "double") == "10000000.0"


@pytest.mark.parametrize(
    "text, plain, careful",
    [
        ("{'a': True, u'b': None}", '{"a": true, "b": null}', '{"a": true, "b": null}'),
        ("{'menu': 'menu', 'x': False}", '{"men": "men", "x": false}', '{"menu": "menu", "x": false}'),
        ("{'x': 'None left', 'y': None}", '{"x": "null left", "y": null}', '{"x": "None left", "y": null}'),
    ],
)
def test_repair_literal(spark, text, plain, careful):
    assert one(spark, S.repair_literal(F.col("x")), text) == plain
    assert one(spark, S.repair_literal(F.col("x"), keep_words=True), text) == careful


@pytest.mark.parametrize(
    "text, want",
    [
        (None, {}),
        ("", {}),
        ("None", {}),
        ("{}", {}),
        ("[1, 2]", {}),
        ("{'a': 'it', 'b': None, 'c': True}", {"a": "it", "b": None, "c": "true"}),
        ('{"a": "Note: True, yes"}', {"a": "Note: True, yes"}),
        ("{\"WiFi\": \"u'free'\"}", {"WiFi": "u'free'"}),
    ],
)
def test_literal_object(spark, text, want):
    assert one(spark, S.literal_object(F.col("x")), text) == want

# Literals and what is no literal, as Python's own reader takes them.
LITERALS = [
    "{'a': \"it's\"}",
    r"{'a': 'it\'s', 'b': 'say \"x\"'}",
    "{'a': {'b': (1, 2,), 'c': [True, None]}, }",
    "{u'x': u'menu', 'y': .5, 'z': 5., 'q': +7, 'n': -1_000}",
    r"{'a': 'x\x41é\101\n\\'}",
    "{'a': 'b' \"c\"}",
    "{'a': 1} x",
    "{'a': 1} {'b': 2}",
    "{'a': 1},{'b': 2}",
    "{'a': None, 'b': 'None, True, u'}",
    "{'a' 1}",
    "{'a': 'tab\there'}",
    "{'a': 1, , 'b': 2}",
    "{,}",
    "{'a': 1 2}",
    "{'a': 'no end}",
    "{'a': ''}",
    "{'k': '" + "y" * 50_000 + "'}",
    r"{'a': '{\'b\': \'c\'}'}",
]


def _as_literal(text):
    try:
        found = ast.literal_eval(text)
    except (SyntaxError, ValueError):
        return None
    return json.loads(json.dumps(found)) if isinstance(found, dict) else None


@pytest.mark.parametrize("text", LITERALS)
def test_literal_json_reads_as_python(spark, text):
    got = one(spark, S.literal_json(F.col("x")), text)
    try:
        got = json.loads(got)
    except ValueError:
        got = None
    assert got == _as_literal(text)
    members = one(spark, S.literal_object(F.col("x")), text)
    assert members.keys() == (_as_literal(text) or {}).keys()


def test_literal_json_on_many_literals(spark):
    """Whatever strings, numbers and nestings Python writes are read back."""
    draw = random.Random(5)
    letters = "ab '\"\\\n\t{}[]():,uéN"

    def value(depth):
        kind = draw.randrange(7 if depth else 5)
        if kind == 0:
            return draw.choice([True, False, None])
        if kind == 1:
            return draw.choice([0, -3, 12, 2.5, -0.25])
        if kind == 5:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        if kind == 6:
            return {word(): value(depth - 1) for _ in range(draw.randrange(4))}
        return word()

    def word():
        return "".join(draw.choice(letters) for _ in range(draw.randrange(8)))

    wanted = [{word(): value(2) for _ in range(3)} for _ in range(300)]
    rows = spark.createDataFrame([(at, repr(one)) for at, one in enumerate(wanted)], "i int, x string")
    for row in rows.select("i", S.literal_json(F.col("x")).alias("j")).collect():
        assert json.loads(row["j"]) == wanted[row["i"]]


def test_nested_attributes_by_literal(spark):
    eav = spark.createDataFrame(
        [("b", "Ambience", "{'owner\\'s': True, u'menu': 'None left', 'y': None}")],
        "business_id string, attribute_name string, attribute_value string",
    )
    got = {r["attribute_name"]: r["attribute_value"] for r in attributes.nested(eav, literal=True).collect()}
    assert got == {"Ambience_owner's": "true", "Ambience_menu": "None left"}


@pytest.mark.parametrize("text", [None, "", "None", "[]", "{bad", "7"])
def test_hours_object_empty(spark, text):
    assert one(spark, S.hours_object(F.col("x")), text) == {}


def test_vector_text_round_trip(spark):
    vec = [0.25, -1.5, 3.0]
    back = S.text_to_vector(S.vector_to_text(F.col("x")), 3)
    assert one(spark, back, vec, "array<float>") == vec
    with pytest.raises(Exception, match="vector is not 4 wide"):
        one(spark, S.text_to_vector(S.vector_to_text(F.col("x")), 4), vec, "array<float>")
    assert one(spark, S.text_to_vector(F.col("x"), 3), "[1, 2 ,3]") == [1.0, 2.0, 3.0]


def test_comma_list_keeps_empty_tokens(spark):
    assert one(spark, T.comma_list(F.col("x")), "a, ,b,,a ") == ["a", "", "b", "", "a"]
    assert one(spark, T.comma_list(F.col("x")), None) is None
    assert one(spark, T.preference_set(F.col("x")), " B,a, b,") == ["a", "b"]


def test_bare_words(spark):
    assert one(spark, T.bare_words(F.col("x")), "Café-Bar, d'Été!") == "cafébar dété"
    assert one(spark, T.word_list(T.bare_words(F.col("x"))), " A  b\nc. ") == ["a", "b", "c"]


def test_single_line_keeps_quotes(spark):
    assert one(spark, T.single_line(F.col("x")), "Joe's\nbar\r.") == "Joe's bar ."


def test_attribute_prose(spark):
    attributes = {
        "Ambience_casual": "true",
        "BusinessParking_lot": "Yes",
        "Dogs_Allowed": "True",
        "WiFi": "free",
        "Smoking": "no",
        "Noise_Level": "null",
        "Music": None,
    }
    got = one(spark, T.attribute_prose(F.col("x")), attributes, "map<string,string>")
    assert set(got.split(". ")) == {
        "Ambience is casual",
        "Has lot parking",
        "Dogs Allowed available",
        "WiFi is free",
    }
    assert one(spark, T.attribute_prose(F.col("x")), None, "map<string,string>") == ""


def test_hours_prose(spark):
    hours = {"Monday": "8:05-17:0"}
    assert one(spark, T.hours_prose(F.col("x")), hours, "map<string,string>") == "Open on Monday from 8:005-17:00"
    fixed = T.hours_prose(F.col("x"), fix_minutes=True)
    assert one(spark, fixed, hours, "map<string,string>") == "Open on Monday from 8:05-17:00"
    assert one(spark, T.hours_prose(F.col("x")), {"Sunday": "0:0-0:0"}, "map<string,string>") == ""


@pytest.mark.parametrize(
    "place, want",
    [("Tampa, FL", "FL"), ("philadelphia pa", "PA"), ("somewhere in Nevada", "IN"), ("Paris", None), (None, None)],
)
def test_supported_region(spark, place, want):
    assert one(spark, supported_region(F.col("x")), place) == want


def test_vector_arithmetic(spark):
    pairs = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>"
    )
    a, b = F.col("a"), F.col("b")
    rows = pairs.select(V.dot(a, b), V.squared_l2(a, b), V.cosine(a, b), V.unit(a)).collect()
    assert tuple(rows[0]) == (24.0, 2.0, 0.96, [0.6, 0.8])
    assert tuple(rows[1]) == (0.0, 1.0, 0.0, None)


# Distances published for well known city pairs, by geodesic on WGS-84 (km).
def test_geodesic_known_lengths(spark):
    points = spark.createDataFrame(
        [
            (0.0, 0.0, 0.0, 1.0, 111.319491),
            (0.0, 0.0, 1.0, 0.0, 110.574389),
            (41.49008, -71.312796, 41.499498, -81.695391, 866.455433),
            (10.0, 179.5, 10.0, -179.5, 109.639322),
            (27.9, -82.5, 27.9, -82.5, 0.0),
        ],
        "a double, b double, c double, d double, want double",
    )
    km = geo.geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    for row in points.select("want", km.alias("km")).collect():
        assert math.isclose(row["km"], row["want"], abs_tol=2e-5)


def test_short_distance_agrees_with_geodesic(spark):
    grid = spark.range(2000).selectExpr(
        "rand(1) * 160 - 80 AS a", "rand(2) * 360 - 180 AS b", "rand(3) * 0.06 - 0.03 AS da", "rand(4) * 0.06 - 0.03 AS db"
    )
    a, b = F.col("a"), F.col("b")
    c, d = a + F.col("da"), b + F.col("db")
    worst = (
        grid.select(geo.short_distance_km(a, b, c, d).alias("s"), geo.geodesic_km(a, b, c, d).alias("g"))
        .filter("g > 0.01")
        .agg(F.max(F.abs(F.col("s") - F.col("g")) / F.col("g")))
        .first()[0]
    )
    assert worst < 2e-7


def test_seeded_fill_is_repeatable(spark):
    rows = spark.range(200).select(
        seeded_between(F.col("id").cast("string"), 1, 3.5, 5.0, 1).alias("a"),
        seeded_between(F.col("id").cast("string"), 1, 3.5, 5.0, 1).alias("b"),
    )
    values = rows.collect()
    assert all(r["a"] == r["b"] and 3.5 <= r["a"] <= 5.0 for r in values)
    assert len({r["a"] for r in values}) > 5
