"""Collocations against counts kept in dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from waymark.llm import collocations as C


def documents(spark, rows):
    full = [(i, text, lang, "clash", 1, 2) for i, (text, lang) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, phrase string, n long, rank int")


def expected(rows, least, longest=3, covered=50, top=2_000):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(found[i : i + n])) for i in range(len(found) - n + 1))
    out = []
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for (lang, phrase), a in candidates.items():
        score, _, l, r = min(
            (1_000_000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k, counts[lang, phrase[:k]], counts[lang, phrase[k:]])
            for k in range(1, len(phrase))
        )
        longer = [
            f for (other, p), f in candidates.items()
            if other == lang and len(p) > len(phrase) and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))
        ]
        if not any(100 * f >= covered * a for f in longer):
            out.append((lang, " ".join(phrase), a, l, r, words[lang], score))
    ranked = []
    for lang in {row[0] for row in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, rank, *row[1:]) for rank, row in enumerate(mine, 1)]
    return sorted(ranked)


def found(spark, rows, **more):
    return sorted(tuple(r) for r in C.collocations(documents(spark, rows), **more).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["The", "the", "naïve", "漢字", "x", "New", "york", "city", "a-b", "\U0001f600"]
    gaps = [" ", " ", " ", "  ", "\t", " , ", ". ", "\n", "\r\n", "\xa0"]
    out = [
        ("".join(w + draw.choice(gaps) for w in draw.choices(vocabulary, range(1, 11), k=draw.randint(0, 60))), draw.choice(["en", "de", None, "und"]))
        for _ in range(120)
    ]
    out += [out[0]] * 30 + [("new york city " * 400, "en"), (None, "en"), ("", None), (" .,\t", "de"), ("new\x0byork\x0ccity", "en")]
    return out


@pytest.mark.parametrize("more", [{}, {"bits": 5}, {"bits": 9, "size": 64}, {"size": 8}])
def test_equal_to_plain_counts(spark, rows, more):
    """Also with fingerprints so narrow that nearly all of them stand for
    several phrases, and with stretches far shorter than the texts."""
    assert found(spark, rows, **more) == expected(rows, C.LEAST)


def test_parameters(spark, rows):
    assert found(spark, rows, least=4, longest=4, covered=80, top=7) == expected(rows, 4, 4, 80, 7)


def test_odd_tables(spark):
    assert found(spark, [("a b", "en")]) == []
    assert C.collocations(documents(spark, [("x", "en")]).limit(0)).collect() == []


def test_prints_tell_words_apart_across_blocks():
    """Spans that cross the blocks of the prefix sums give what direct
    evaluation gives."""
    data = np.frombuffer(b"ab" * 100_000 + b" " + b"ab" * 100_000 + b" ba", np.uint8)
    words = C.Words(data, np.zeros(1, int))
    first, second, third = (int(h) for h in words.hashes[C._PRIME])
    assert first == second != third
    assert third == (ord("b") + 1 + (ord("a") + 1) * C._BASES[C._PRIME][0]) % C._PRIME
    first, second, third = (int(h) for h in words.hashes[C._WRAP])
    assert first == second != third


def test_sieve_holds_every_key(spark):
    keys = spark.range(1, 50_000, 7).selectExpr("xxhash64(id) key")
    sieve = C.Sieve(np.frombuffer(C._sieve(keys, keys.count()), np.uint8))
    mine = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    assert sieve.has(mine).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert sieve.has(others).mean() < 0.05
