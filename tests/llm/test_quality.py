import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import documents
from waymark.llm import quality
from waymark.llm.shared import table


def brute(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_counts_equal_brute_force(spark, small, odd):
    for docs in (table(spark, small, "documents"), odd):
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        got = sorted(
            ((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.measure(docs).collect()),
            key=repr,
        )
        assert got == sorted(((i, brute(text)) for i, text in texts), key=repr)


def test_repeats_of_few_words():
    draw = random.Random(1)
    for _ in range(300):
        words = [draw.choice("ab").encode() for _ in range(draw.randrange(40))]
        assert quality.repeated_words(words) == brute(b" ".join(words).decode())[4]


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (200, 7, 0.05), (5, 5, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_below(k, n, p) == pytest.approx(min(exact, 1.0))


CUTS = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
PLAIN = {
    "symbols": (lambda r: r.n_symbols / max(r.word_chars, 1), CUTS),
    "dup_lines": (lambda r: r.n_dup_lines / max(r.n_lines, 1), CUTS),
    "repeats": (lambda r: r.n_repeat_words / max(r.n_words, 1), CUTS),
    "upper": (lambda r: r.n_upper / max(r.word_chars, 1), CUTS),
    "marks": (lambda r: r.n_marks / max(r.n_words, 1), [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0]),
    "long_words": (lambda r: r.word_chars / max(r.n_words, 1), [8.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0]),
}


def plain_thresholds(rows, quality_of, half_of, risk=0.02, error=0.05, worth=10):
    """The same search, a document and a cutoff at a time."""
    rows = [r for r in rows if r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words and r.doc_id in quality_of]
    tests = [(name, cut, statistic) for name, (statistic, cuts) in PLAIN.items() for cut in cuts]
    orders = {}
    for stratum in {r.stratum for r in rows}:
        mine = [r for r in rows if r.stratum == stratum and half_of[r.doc_id] == 0]
        good, bad = ([r for r in mine if quality_of[r.doc_id] == q] for q in (1, 0))
        order = []
        for name, cut, statistic in tests:
            g, b = (sum(statistic(r) > cut for r in part) for part in (good, bad))
            if b and b * len(good) >= worth * g * len(bad):
                order.append(((g + 1) / (b + 1), -b, name, -cut, statistic))
        if order:
            orders[stratum] = sorted(order, key=lambda x: x[:4])
    found = {}
    for stratum, order in orders.items():
        held = [r for r in rows if r.stratum == stratum and half_of[r.doc_id] == 1 and quality_of[r.doc_id] == 1]
        for at in range(len(order)):
            k = sum(any(f(r) > -cut for *_, cut, f in order[: at + 1]) for r in held)
            n = len(held)
            tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
            if tail > error / len(orders):
                break
            _, _, name, cut, _ = order[at]
            found[stratum, name] = min(-cut, found.get((stratum, name), 1e9))
    return found


@pytest.fixture(scope="module")
def labelled(spark):
    """Bad documents with symbols, capitals or long words, some good ones with
    a few of each; every third document is left without a label."""
    draw = random.Random(2)
    rows, quality_of = [], {}
    for n in range(3_000):
        bad = n % 5 == 0
        kind = draw.randrange(3)
        share = draw.choice([0.5, 0.9]) if bad else draw.choice([0, 0, 0, 0.02, 0.1])
        mark = lambda w: (w + "#", w.upper(), w * 6)[kind] if draw.random() < share else w
        rows.append((n, " ".join(mark(f"w{draw.randrange(5000)}abc") for _ in range(30)), "s"))
        quality_of[n] = int(not bad)
    docs = documents(spark, rows)
    half = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"))
    return docs, quality_of, {r.doc_id: r.half for r in half.collect()}


def test_thresholds_equal_plain_search(spark, labelled):
    docs, quality_of, half_of = labelled
    given = {n: q for n, q in quality_of.items() if n % 3}
    labels = spark.createDataFrame(list(given.items()), "doc_id long, quality int")
    measured = quality.measure(docs)
    found = {(r.stratum, r.rule): r.cutoff for r in quality.thresholds(measured, labels).collect()}
    assert len(found) >= 2 and found == plain_thresholds(measured.collect(), given, half_of)


def test_good_documents_stay(spark, labelled):
    """On documents whose labels the operator never saw."""
    docs, quality_of, _ = labelled
    labels = spark.createDataFrame([(n, q) for n, q in quality_of.items() if n % 3], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect() if r.doc_id % 3 == 0}
    good = [kept[n] for n in kept if quality_of[n]]
    bad = [kept[n] for n in kept if not quality_of[n]]
    assert sum(not k for k in good) <= 0.02 * len(good)
    assert sum(not k for k in bad) > 0.9 * len(bad)


def test_cutoffs_are_certified_on_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    judged = quality.quality_rules(docs, labels).where("not base_failed").join(labels, "doc_id")
    rows = judged.groupBy("stratum").agg(
        F.count_if(F.expr("quality = 1")).alias("good"),
        F.count_if(F.expr("quality = 1 and not kept")).alias("lost"),
        F.count_if(F.expr("quality = 0 and not kept")).alias("caught"),
    ).collect()
    assert sum(r.caught for r in rows) > 200
    assert all(r.lost <= 0.02 * r.good for r in rows)


def test_few_labels_certify_nothing(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (6, None), (1, 1)], "doc_id long, quality int")
    rows = quality.quality_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality.quality_rules(none, labels).count() == 0
