import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import documents
from waymark.llm import licenses


def brute(text, threshold=licenses.THRESHOLD):
    """Labels of all blocks by plain set work."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for char in lowered + " ":
        if char.isascii() and not (char.isdigit() or "a" <= char <= "z"):
            words += [word] if word else []
            word = ""
        else:
            word += char
    found = set()
    for label, template in licenses.TEMPLATES:
        wanted = set(template.split())
        for start in range(0, max(len(words) - 64, 0) + 32, 32):
            if len(wanted & set(words[start : start + 64])) >= threshold * len(wanted) - 1e-9:
                found.add(label)
    for phrase, label in licenses.PHRASES.items():
        if f" {phrase} " in f" {' '.join(words)} ":
            found.add(label)
    return len(words), ",".join(sorted(found))


def test_random_texts_equal_brute_force(spark):
    draw = random.Random(3)
    pool = [word for _, text in licenses.TEMPLATES for word in text.split()]
    texts = []
    for _ in range(150):
        words = [draw.choice(pool) if draw.random() < 0.4 else f"x{draw.randrange(50)}" for _ in range(draw.randrange(150))]
        if draw.random() < 0.7:
            notice = draw.choice(licenses.TEMPLATES)[1].split()
            if draw.random() < 0.5:
                notice[draw.randrange(len(notice))] = "other"
            at = draw.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(draw.choice([" ", "\n", ", "]).join(words).title())
    rows = documents(spark, [(n, text, "s") for n, text in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.labels) for r in licenses.summary(licenses.scan(rows)).collect()}
    assert got == {n: brute(text) for n, text in enumerate(texts)}


def test_phrase_places(spark):
    text = "Under the MIT License, under THE mit-license! CC BY-NC ... cc by ncx"
    row = licenses.summary(licenses.scan(documents(spark, [(1, text, "s")]))).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (3, 0, 8, "cc-by-nc,mit")
    assert row.score == 1.0


def test_odd_rows(spark, odd, none):
    rows = licenses.summary(licenses.scan(odd)).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in empty)
    assert licenses.scan(none).count() == 0


@given(st.text(max_size=30))
@settings(max_examples=50, deadline=None)
def test_brute_force_counts_words_like_the_pattern(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert brute(text)[0] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))


def test_words_are_made_once_and_only_a_to_z_is_lowered(spark):
    """One pattern over all texts makes the words; a Kelvin sign or a dotted I is no letter of a phrase."""
    texts = ["UNDER THE MIT LICENSE", "under the MİT license", "CC BY NC é", "CC BY NK", "releasÉd under the mit license"]
    scanned = licenses.scan(documents(spark, [(n, text, "s") for n, text in enumerate(texts)]), phrases={"under the mit license": "mit", "cc by nc": "cc-by-nc", "by nk": "k"})
    got = {r.doc_id: (r.n_words, r.base_labels) for r in licenses.summary(scanned).collect()}
    assert got == {0: (4, "mit"), 1: (4, ""), 2: (4, "cc-by-nc"), 3: (3, ""), 4: (5, "mit")}
    assert "regexp_count" not in scanned._jdf.queryExecution().analyzed().toString()
