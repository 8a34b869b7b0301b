import random

from tests.llm.conftest import documents
from waymark.llm import ngram_join
from waymark.llm.components import connected_components


def grams(text, size):
    words = (text or "").lower().split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, num, den):
    sets = {i: grams(text, size) for i, text in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    """Chains and groups of near copies, shared passages, short texts."""
    draw = random.Random(seed)
    rows, n = [], 0
    passage = [f"p{k}" for k in range(40)]
    for _ in range(25):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([2, 4, 6, 30, 60, 120]))]
        if draw.random() < 0.4:
            base = passage + base
        for _ in range(draw.choice([1, 1, 2, 5, 9])):
            rows.append((n, " ".join(base)))
            n += 1
            for _ in range(draw.randrange(3)):
                base = list(base)
                base[draw.randrange(len(base))] = f"n{draw.randrange(10_000)}"
    return rows


def test_equal_to_all_pairs(spark):
    for seed, (size, num, den) in enumerate([(4, 85, 100), (5, 4, 5), (2, 1, 2)]):
        rows = corpus(seed)
        found = ngram_join.similar_documents(documents(spark, [(i, t, "s") for i, t in rows]), size, num, den)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, size, num, den)


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    for seed, (size, num, den), block in ((0, (4, 85, 100), 512), (1, (5, 4, 5), 3), (2, (2, 1, 2), 2)):
        monkeypatch.setattr(ngram_join, "LINK_CLASSES", block)
        monkeypatch.setattr(ngram_join, "LINK_COLUMNS", 64)
        rows = corpus(seed)
        sets = {i: grams(text, size) for i, text in rows}
        linked = {
            i: sum(j != i and den * len(a & b) >= num * len(a | b) for j, b in sets.items()) if a else 0 for i, a in sets.items()
        }
        found = ngram_join.similar_documents(documents(spark, [(i, t, "s") for i, t in rows]), size, num, den).collect()
        assert {r.doc_id: r.n_links for r in found} == linked


def test_links_of_a_large_group_and_odd_rows(spark, odd):
    base = [f"w{k}" for k in range(200)]
    rows = [(n, " ".join([*base[:20], f"n{n}", *base[21:]]), "s") for n in range(700)]
    found = ngram_join.similar_documents(documents(spark, rows), 4, 85, 100).collect()
    assert {r.n_links for r in found} == {699}
    odd_links = {r.doc_id: r.n_links for r in ngram_join.similar_documents(odd, 4, 85, 100).collect()}
    assert odd_links == {1: 1, 2: 1, **dict.fromkeys((None, 3, 4, 5, 6, 7, 8), 0)}
    assert "n_links" not in ngram_join.similar_documents(odd, links=False).columns


def test_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in ngram_join.similar_documents(odd, 4, 85, 100).collect()}
    assert set(rows) == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert (rows[2].component_id, rows[7].n_shingles, rows[7].component_id) == (1, 1, 7)
    assert [rows[i].n_shingles for i in (3, 4, 5)] == [0, 0, 0] and rows[3].component_id == 3
    assert rows[None].component_id is None
    assert ngram_join.similar_documents(none).count() == 0


def test_rows_with_one_id_and_rows_without(spark):
    """Every row is judged by its own text, whatever its id."""
    a, b = " ".join(f"a{n}" for n in range(60)), " ".join(f"b{n}" for n in range(60))
    near_a, near_b = a + " x", b + " y"
    rows = [(5, a, "s"), (5, b, "s"), (5, b, "s"), (3, near_a, "s"), (9, near_b, "s"), (None, near_b, "s"), (None, "c d e f g", "s"),
            (None, "c d e f g", "s"), (None, "c d e f g h i", "s"), (None, "", "s")]
    found = ngram_join.similar_documents(documents(spark, rows), 4, 85, 100, kept=True).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links, r.kept) for r in found), key=repr)
    assert got == sorted([
        (5, 57, 3, 1, False), (5, 57, 5, 2, True), (3, 58, 3, 1, True), (9, 58, 5, 2, False), (None, 58, 5, 2, False),
        (None, 2, None, 1, True), (None, 2, None, 1, True), (None, 4, None, 0, True), (None, 0, None, 0, True),
    ], key=repr)


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Pairs grow with the members, not with their square."""
    sizes = {}
    real = ngram_join.materialize

    def watch(frame, label):
        out = real(frame, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", watch)
    draw = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for n in range(400):
        words = list(base)
        words[draw.randrange(200)] = f"n{n}"
        rows.append((n, " ".join(words), "s"))
    found = ngram_join.similar_documents(documents(spark, rows), 4, 85, 100).collect()
    assert {r.component_id for r in found} == {0}
    assert sizes["ngram-stars"] + sizes["ngram-pairs"] < 400 * 20


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id * 7 % 201 as a", "(id + 1) * 7 % 201 as b")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert len(found) == 201 and set(found.values()) == {0}
