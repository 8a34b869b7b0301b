import pytest

from tests.llm.conftest import documents
from waymark.llm import mixing


def mixed(rows):
    return {(r.doc_id, r.source): r for r in mixing.mix_amounts(rows).collect()}


def test_targets_stop_and_share_the_rest(spark):
    text = {n: " ".join(["w"] * n) for n in (1, 10, 100)}
    rows = [(1, text[10], "a"), (2, text[100], "b"), (3, text[1], "c")]
    rows += [(10 + n, text[10], "b") for n in range(20)]
    goal = {r.source: r for r in mixing.targets(mixing.sizes(documents(spark, rows))).collect()}
    total = 10 + 300 + 1
    assert goal["a"].target == 30.0 and goal["c"].target == 3.0
    assert goal["b"].target == pytest.approx(total - 33)


def test_taken_comes_near_the_target(spark):
    rows = [(n, " ".join(["w"] * (1 + n % 17)), "abcd"[n % 4]) for n in range(2_000)]
    got = mixed(documents(spark, rows))
    by_source = {}
    for row in got.values():
        by_source.setdefault(row.source, [0, row.target])[0] += row.taken
        assert row.taken % max(row.size, 1) == 0 and row.taken <= 3 * row.size
    for taken, target in by_source.values():
        assert abs(taken - target) <= 20
    assert sum(row.taken for row in got.values()) <= sum(row.size for row in got.values())


def test_reruns_and_partitions_agree(spark):
    rows = documents(spark, [(n, " ".join(["w"] * (1 + n % 5)), "ab"[n % 2]) for n in range(300)])
    assert mixed(rows) == mixed(rows.repartition(7, "n_chars"))


def test_mix_is_sorted_and_fits(spark):
    rows = documents(spark, [(n, "one two three", "ab"[n % 3 > 0]) for n in range(60)])
    order = mixing.mix(rows).collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    assert sum(r.size for r in order) <= 180
    amounts = {r.doc_id: r.taken for r in mixing.mix_amounts(rows).collect()}
    for doc, taken in amounts.items():
        assert sum(r.size for r in order if r.doc_id == doc) == taken


def test_odd_rows(spark, odd, none):
    rows = mixing.mix_amounts(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert mixing.mix_amounts(none).count() == 0
    only_empty = documents(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in mixing.mix_amounts(only_empty).collect()] == [0, 0]
