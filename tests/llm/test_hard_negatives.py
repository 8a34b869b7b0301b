"""Hard negatives against scores worked out pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import hard_negatives as H


def expected(rows, every, positives=5, negatives=10, low=30, high=90):
    usable = [(i, label, v) for i, label, v in rows if None not in (i, label, v) and all(x is not None for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    out = []
    for anchor, label, v in usable:
        if anchor % every:
            continue
        same = [(-dot(v, w), i) for i, other, w in usable if other == label and i != anchor and len(w) == len(v)]
        for s, positive in sorted(same)[:positives]:
            band = [
                (-dot(v, w), i) for i, other, w in usable
                if other != label and len(w) == len(v) and low * -s <= 100 * dot(v, w) <= high * -s
            ]
            out += [(anchor, positive, rank, i, -s, -t) for rank, (t, i) in enumerate(sorted(band)[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    full = [(i, label, None if v is None else [None if x is None else float(x) for x in v], "clash", 3, 0.5) for i, label, v in rows]
    return spark.createDataFrame(full, "vec_id long, label int, vector array<double>, block string, rank int, score double")


def found(spark, rows, every, **more):
    result = H.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **more)
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize("size", [1, 50, 40_000, 1 << 20, 1 << 33, 1 << 80])
def test_packed_products(size):
    draw = np.random.default_rng(size % 1000)
    a, b = (
        np.array([[int(x * size) for x in row] for row in draw.uniform(-1, 1, (n, 7))], object) for n in (5, 131)
    )
    if size < 1 << 40:
        a, b = a.astype(np.int64), b.astype(np.int64)
    plain = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
    assert [[int(x) for x in row] for row in H.packed_products(a, b)] == plain


def test_packed_products_of_far_away_values():
    a = np.full((2, 3), 10**14) + np.arange(6).reshape(2, 3)
    b = -np.full((4, 3), 10**13) + np.arange(12).reshape(4, 3)
    plain = a.astype(object) @ b.astype(object).T
    assert (H.packed_products(a, b) == plain).all()
    assert H.packed_products(a[:0], b).shape == (0, 4) and H.packed_products(a[:, :0], b[:, :0]).tolist() == [[0] * 4] * 2


def test_both_paths_agree():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 200, (4, 16)), draw.integers(0, 200, (150, 16))
    assert (H._in_doubles(a, b, 20) == H._in_integers(a, b, 20)).all()
    assert (H._in_doubles(a, b, 20) == a @ b.T).all()


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    # Few values, so scores tie a lot; a third of all rows in one label.
    out = [(i, int(i % 5 if i % 3 else 1), draw.integers(-3, 6, 6).tolist()) for i in range(400)]
    out += [(401, None, [1] * 6), (402, 1, None), (None, 1, [1] * 6), (404, 2, [1, None, 1, 1, 1, 1]), (405, 3, [0] * 6)]
    out += [(406, 7, [9, 9]), (500, 7, [9, 8]), (501, 8, [5, 5]), (410, 9, []), (420, 8, [])]
    return out


@pytest.mark.parametrize("more", [{}, {"item_block": 16, "anchor_block": 4}, {"item_block": 90, "anchor_block": 3}])
def test_equal_to_all_pairs(spark, rows, more):
    assert found(spark, rows, 10, **more) == expected(rows, 10)


def test_parameters(spark, rows):
    got = found(spark, rows, 7, positives=2, negatives=3, low=50, high=70, item_block=64)
    assert got == expected(rows, 7, 2, 3, 50, 70)


def test_huge_components(spark):
    rows = [(i, i % 2, [(-1) ** i * 2**60, i * 2**45, 3]) for i in range(0, 40)]
    got = found(spark, rows, 4)
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == [(*r[:4], clip(r[4]), clip(r[5])) for r in expected(rows, 4)]


def test_odd_tables(spark, rows):
    assert found(spark, [], 10) == []
    assert found(spark, [r for r in rows if r[0] is not None and r[0] % 10], 10) == []
    doubled = [*rows, *rows[:120]]
    assert found(spark, doubled, 10, item_block=32) == expected(rows, 10)
    infinite = [*rows, (430, 2, [float("inf")] * 6), (440, 2, [float("nan")] * 6)]
    assert found(spark, infinite, 10) == expected(rows, 10)


def test_steps(spark):
    values = [0.5, -0.001, 1e300, None, float("nan")]
    row = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", H.steps).alias("v")).first().v
    assert row[:4] == [128.0, -1.0, 256e300, None] and row[4] != row[4]
