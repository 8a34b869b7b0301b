"""Exact quartiles against numpy on awkward distributions."""

import numpy as np
import pytest

from waymark.operators import profile


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [3.0] * 50 + [9.0],
        list(np.random.default_rng(1).normal(0, 1, 500)),
        list(np.random.default_rng(2).lognormal(0, 8, 501)),
        [-1e300, 1e300, 0.0, 1e-300, -5.0, 7.0],
        [27.9 + i * 1e-9 for i in range(400)],
    ],
)
def test_numeric(spark, values):
    rows = spark.createDataFrame([(float(v), None) for v in values] + [(None, None), (float("nan"), None)], "a double, b double")
    got = profile.numeric(rows.repartition(4), ["a", "b"]).collect()
    assert [r["column_name"] for r in got] == ["a"]
    row = got[0]
    assert row["count"] == len(values) and row["min"] == min(values) and row["max"] == max(values)
    for name, q in (("p25", 25), ("p50", 50), ("p75", 75)):
        assert row[name] == pytest.approx(np.percentile(values, q), rel=1e-12, abs=1e-12)


def test_counts(spark):
    rows = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {tuple(r) for r in profile.null_counts(rows).collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in profile.value_counts(rows).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in profile.row_counts({"t": rows, "e": rows.filter("false")}).collect()} == {
        ("t", 3),
        ("e", 0),
    }
