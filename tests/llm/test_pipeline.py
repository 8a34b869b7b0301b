import corpus_pipeline
from tests.llm.conftest import documents
from waymark.llm import ngram_join, pii, toxicity
from waymark.llm.shared import materialize, table


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "packing"]


def test_stages_equal_their_operators(spark, small):
    """Every stage against plain Python over its own input."""
    docs = table(spark, small, "documents")
    names = docs.columns
    labels = table(spark, small, "labels")

    kept = materialize(corpus_pipeline.drop_toxic(spark, docs, small), "test")
    machine = toxicity.fit(docs, labels)
    wanted = {r.doc_id for r in docs.collect() if machine.score(r.text or "") < 0.5}
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == wanted and kept.count() == len(wanted)

    single = materialize(corpus_pipeline.drop_near_duplicates(spark, kept, small), "test")
    groups = {r.doc_id: r.component_id for r in ngram_join.similar_documents(kept, 5, 4, 5).collect()}
    assert single.columns == names
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    private = materialize(corpus_pipeline.pseudonymise(spark, single, small), "test")
    feistel = pii.Feistel(pii.session_key(spark))
    before = {r.doc_id: r.text for r in single.collect()}
    assert private.columns == names
    for row in private.collect():
        assert row.text == pii.pseudonymise_text(before[row.doc_id], feistel)[0] and row.n_chars == len(row.text)

    mixed = materialize(corpus_pipeline.mix(spark, private, small), "test")
    assert mixed.columns == names
    words = {r.doc_id: len(r.text.split()) for r in private.collect()}
    assert 0.9 * sum(words.values()) <= sum(words[r.doc_id] for r in mixed.collect()) <= sum(words.values())

    packed = corpus_pipeline.pack(spark, mixed, small).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()


def test_odd_rows_pass_every_stage(spark, small, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, small), "test")
            assert docs.columns == odd.columns
        corpus_pipeline.pack(spark, docs, small).collect()


def test_rows_without_id_or_with_one_id(spark, small):
    rows = documents(spark, [(None, "a b c", "s"), (None, "a b c", "s"), (5, "d e f", "s"), (5, "d e f", "s")])
    left = corpus_pipeline.drop_near_duplicates(spark, rows, small).collect()
    assert sorted(repr(r.doc_id) for r in left) == ["5", "None", "None"]


def test_rows_that_repeat_an_id_with_another_text_stay(spark, small):
    base = " ".join(f"w{n}" for n in range(80))
    rows = documents(spark, [(5, "a b c", "s"), (5, "d e f", "s"), (5, base, "s"), (4, base + " x", "s"), (6, base, "s")])
    left = corpus_pipeline.drop_near_duplicates(spark, rows, small).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(4, base + " x"), (5, "a b c"), (5, "d e f")]
