"""Attribute flattening, clean-up and regrouping on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import attributes as A
from waymark.operators import cohort, dedupe, documents, quality, scope

AMBIENCE = "{'romantic': False, 'casual': True, u'hipster': None}"


def business(spark, *attributes, **more):
    rows = [
        (f"b{i}", a, more.get("is_open", True), more.get("state", "PA")) for i, a in enumerate(attributes)
    ]
    return spark.createDataFrame(rows, "business_id string, attributes string, is_open boolean, state string")


def eav(spark, *pairs):
    return spark.createDataFrame(
        [("b", n, v) for n, v in pairs], "business_id string, attribute_name string, attribute_value string"
    )


def pairs(df):
    return sorted((r["attribute_name"], r["attribute_value"]) for r in df.collect())


def test_flatten_shapes(spark):
    rows = business(spark, json.dumps({"WiFi": "u'free'", "Bike": "True", "x": None, "n": 3}), None, "{}")
    got = {(r[0], r[1], r[2]) for r in A.flatten(rows).collect()}
    assert got == {("b0", "WiFi", "u'free'"), ("b0", "Bike", "True"), ("b0", "x", None), ("b0", "n", "3")}


def test_flatten_scope(spark):
    assert A.flatten(business(spark, '{"a": "b"}', is_open=False)).count() == 0
    assert A.flatten(business(spark, '{"a": "b"}', state="CA")).count() == 0


def test_flatten_malformed(spark):
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        A.flatten(business(spark, "{bad")).collect()
    assert A.flatten(business(spark, "{bad", '{"a": "b"}'), strict=False).count() == 1


def test_nested(spark):
    rows = eav(spark, ("Ambience", AMBIENCE), ("Music", "{'dj': True}"), ("WiFi", "u'free'"), ("x", None))
    assert pairs(A.nested(rows)) == [("Ambience_casual", "true"), ("Ambience_romantic", "false")]


def test_nested_apostrophe_in_value(spark):
    rows = eav(spark, ("Owner", "{'name': \"Joe's\", 'x': True}"))
    with pytest.raises(Exception):
        A.nested(rows).collect()
    assert A.nested(rows, strict=False).count() == 0


def test_nested_keeps_words_on_request(spark):
    rows = eav(spark, ("Has", "{'menu': 'menu', 'b': True}"))
    assert pairs(A.nested(rows)) == [("Has_b", "true"), ("Has_men", "men")]
    assert pairs(A.nested(rows, keep_words=True)) == [("Has_b", "true"), ("Has_menu", "menu")]


def test_final_cleans_and_keeps_quoted_none(spark):
    rows = eav(
        spark,
        ("a", "u'free'"),
        ("b", "u'none'"),
        ("c", "'none'"),
        ("d", "None"),
        ("e", '""'),
        ("f", "True"),
        ("g", None),
        ("Ambience", AMBIENCE),
        ("h", "'dou'ble'"),
    )
    assert pairs(A.final(rows)) == [
        ("Ambience_casual", "true"),
        ("Ambience_romantic", "false"),
        ("a", "free"),
        ("c", "none"),
        ("e", ""),
        ("f", "True"),
        ("h", "doble"),
    ]


def test_truthful(spark):
    rows = eav(
        spark,
        ("a", "True"),
        ("b", "false"),
        ("c", "none"),
        ("d", "No"),
        ("e", "{}"),
        ("RestaurantsPriceRange2", "2"),
        ("f", None),
        ("g", "no idea"),
    )
    assert pairs(A.truthful(rows)) == [("a", "True"), ("g", "no idea")]


def test_regroup_is_deterministic_on_duplicates(spark):
    rows = eav(spark, ("b", "2"), ("a", "1"), ("b", "3"), (None, "x"))
    got = A.regroup(rows.repartition(4)).first()["attributes"]
    assert list(got.items()) == [("a", "1"), ("b", "3")]


def test_regroup_undoes_flatten(spark):
    want = {"a": "x", "b": "y", "c": "z"}
    assert A.regroup(A.flatten(business(spark, json.dumps(want)))).first()["attributes"] == want


def test_widen(spark):
    rows = spark.createDataFrame(
        [
            ("b0", json.dumps({"WiFi": "u'no'", "Ambience": AMBIENCE, "Music": "{'dj': True}"}), '{"Monday": "8:0-9:0"}'),
            ("b1", "{'WiFi': 'free', 'BikeParking': True}", None),
            ("b2", None, "None"),
        ],
        "business_id string, attributes string, hours string",
    )
    names = {}
    for row in A.wide_names(rows).collect():
        names.setdefault(row["suffix"], []).append(row["name"])
    wide = A.widen(rows, names)
    got = {r["business_id"]: r.asDict() for r in wide.collect()}
    assert set(wide.columns) == {
        "business_id", "WiFi_Attr", "Ambience_Attr", "Music_Attr", "BikeParking_Attr", "Monday_Hour",
        "romantic_Ambience", "casual_Ambience", "hipster_Ambience", "dj_Music_expanded",
    }
    assert got["b0"]["casual_Ambience"] == "true" and got["b0"]["hipster_Ambience"] is None
    assert got["b0"]["Monday_Hour"] == "8:0-9:0" and got["b0"]["dj_Music_expanded"] == "true"
    assert got["b1"]["WiFi_Attr"] == "free" and got["b1"]["BikeParking_Attr"] == "true"
    assert all(v is None for k, v in got["b2"].items() if k != "business_id")


def full_business(spark, rows):
    return spark.createDataFrame(
        rows,
        "business_id string, name string, address string, city string, state string, postal_code string, "
        "latitude double, longitude double, stars double, review_count int, is_open boolean, "
        "attributes string, categories string, hours string",
    )


ROW = ("b", "N", "A", "C", "PA", "1", 1.0, 2.0, 3.0, 4, True, None, "x, ,y,x", '{"Monday": "8:0-9:0"}')


def test_curated_boundaries(spark):
    rows = [
        ROW,
        ("low", *ROW[1:8], 2.5, *ROW[9:]),
        ("shut", *ROW[1:10], False, *ROW[11:]),
        ("far", *ROW[1:4], "CA", *ROW[5:]),
    ]
    table = full_business(spark, rows)
    got = scope.curated(table).collect()
    assert [r["business_id"] for r in got] == ["b"]
    assert got[0]["monday"] == "8:0-9:0" and got[0]["sunday"] is None
    assert scope.in_scope(table).count() == 2
    assert "is_open" not in scope.filtered(table).columns


def test_categories_and_vocabulary(spark):
    table = full_business(spark, [ROW, ("none", *ROW[1:12], None, ROW[13])])
    assert sorted(r["categories"] for r in cohort.categories(table).collect()) == ["", "x", "x", "y"]
    terms = {(r["kind"], r["term"]) for r in cohort.vocabulary(table).collect()}
    assert terms == {("city", "c"), ("category", "x"), ("category", ""), ("category", "y")}


def test_review_cutoff_is_strict(spark):
    reviews = spark.createDataFrame(
        [("b", "u1", "2018-01-01 23:00:00"), ("b", "u2", "2018-01-02 00:00:00"), ("z", "u3", "2020-01-01")],
        "business_id string, user_id string, date string",
    )
    kept = cohort.relevant_reviews(reviews, full_business(spark, [ROW, ROW]), "2018-01-01")
    assert [r["user_id"] for r in kept.collect()] == ["u2"]
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    twice = kept.unionByName(kept)
    assert [r["user_id"] for r in cohort.relevant_users(users, twice).collect()] == ["u2"]


def test_keep_first_and_quality(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 7), (None, 8)], "k string, v int")
    kept = dedupe.keep_first(rows.filter("k IS NOT NULL"), "k", F.asc("v"))
    assert sorted((r["k"], r["v"]) for r in kept.collect()) == [("a", 1), ("b", 5)]
    assert [(r["k"], r["row_count"]) for r in quality.not_unique(rows, "k").collect()] == [("a", 2)]
    assert quality.null_keys(rows, "k").count() == 2
    parent = spark.createDataFrame([("a",)], "k string")
    assert [r["k"] for r in quality.orphans(rows, parent, "k").collect()] == ["b"]


def engineered(spark, attributes, **more):
    row = {**dict(zip(["business_id", "name", "address", "city", "state", "postal_code", "latitude", "longitude",
                       "stars", "review_count", "is_open", "attributes", "categories", "hours"], ROW)), **more}
    table = full_business(spark, [tuple(row.values())]).drop("attributes")
    literal = F.from_json(F.lit(json.dumps(attributes)), "map<string,string>")
    return table.withColumn("attributes", literal)


def test_prose_leaves_out_price_range(spark):
    assert documents.prose(engineered(spark, {"RestaurantsPriceRange2": "2"})).count() == 0
    got = documents.prose(engineered(spark, {"WiFi": "free"}, categories=None)).first()
    assert got["combined_text"] == (
        "Categories: . WiFi is free. Open on Monday from 8:00-9:00. Rated 3.0 stars."
    )


def test_kb_document_defaults(spark):
    rows = engineered(spark, {"a": "True", "b": None, "n": "4"}, name=None, categories=None, hours=None, city=None)
    assert documents.kb_v2(rows).first()["document"] == (
        "Business Name: Unknown Business\nAddress: A, , PA 1\nCategories: \n"
        "Rating: 3.0 stars (4 reviews)\nAttributes: a=True, n=4\nHours: \n"
    )


def test_metadata_overlay(spark):
    rows = engineered(spark, {"city": "other", "Bike": "True", "n": "4", "f": "2.5", "t": "u'x'"})
    meta = json.loads(documents.kb_v2(rows).first()["metadata"])
    assert meta == {
        "name": "N", "city": "other", "state": "PA", "stars": 3.0, "review_count": 4, "latitude": 1.0,
        "longitude": 2.0, "categories": "x, ,y,x", "Bike": True, "n": 4, "f": 2.5, "t": "u'x",
    }
    v1 = json.loads(documents.kb_v1(rows.select("business_id", "categories", "attributes")).first()["metadata"])
    assert v1["attribute_text"].startswith("city=other, Bike=True") and v1["Bike"] is True
