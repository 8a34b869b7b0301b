import zlib

import numpy as np
import pytest

from waymark.llm import toxicity
from waymark.llm.shared import table

LARGE = "/root/testdata/sf0.1"


def kernel(s, t):
    """The kernel from its definition."""

    def vector(string):
        codes = [0, *map(toxicity._symbol, string), 1]
        out = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + toxicity.SPAN)):
                    key = (codes[i], codes[j], codes[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        norm = np.sqrt(sum(
            toxicity.DECAY ** (2 * (k - i + 1))
            for i in range(len(codes)) for j in range(i + 1, len(codes)) for k in range(j + 1, min(len(codes), i + toxicity.SPAN))
        ))
        return {key: value / norm for key, value in out.items()}

    a, b = vector(s), vector(t)
    return sum(value * b.get(key, 0) for key, value in a.items())


def test_kernel_equals_its_definition():
    words = ["idiot", "idxiot", "stupid", "a", "abcabcabcabc", "éàü"]
    got = toxicity._kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(kernel(a, b), abs=1e-5)


def test_table_equals_the_kernel_expansion():
    machine = toxicity.fit_units(["idiot", "moron"], ["table", "chair", "window", "idea"])
    assert (machine.margins(["idiot", "moron"]) > 0).all()
    assert (machine.margins(["table", "chair", "window"]) < 0).all()


def test_gaps_and_inserted_characters():
    clean = [f"{a}{b}{c}" for a in ("ta", "wi", "no") for b in ("ble", "ndo", "rma") for c in ("s", "w", "l", "ed", "ing")]
    machine = toxicity.fit_units(["idiot", "moron", "stupid"], clean)
    plain = machine.score("ab idiot cd")
    for text in ("an i.d.i.o.t there", "an i d i o t there", "an IDIOT!", "idioot", "stuupid"):
        assert machine.margin(text) > 0, text
    assert plain > machine.score("a table there")
    assert machine.margin("") < machine.margin("table")


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    return rows


def test_held_out_accuracy(scored):
    held = [r for r in scored if r.held_out]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in scored)
    toxic = [r for r in held if r.toxic]
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (1, None), (None, 1), (2, 0), (6, 0), (7, 1), (7, 0)], "doc_id long, toxic int"
    )
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.predicted == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
