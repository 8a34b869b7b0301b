import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from waymark.llm import packing, tokens
from waymark.llm.shared import table
from waymark.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def test_cached_ids_equal_the_tokenizer(whole):
    draw = random.Random(1)
    letters = "abcXYZ'st019 \t\n\x0b\r\x0c.,!éÉßÀñ́İΣσς\xa0\x85\x1c\x00ﬁǅªº½×漢字<|>🙂 ΩkK"
    encode = encoder(VOCABULARY)
    for _ in range(2_000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(16)))
        if draw.random() < 0.05:
            text += "<|endoftext|>"
        wanted = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == wanted, repr(text)


def test_remembered_chunks_are_bounded(whole, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 1_000)
    encode = encoder.__wrapped__(VOCABULARY)
    # Common words between rare ones, in one long text, then chunks of half a megabyte.
    many = " ".join(f"the {n:x}-ab{n} cat's" for n in range(30_000))
    assert np.frombuffer(encode(many), "<u4").tolist() == whole.encode(many, add_special_tokens=False).ids
    tracemalloc.start()
    for n in range(30_000, 60_000, 10_000):
        encode(" ".join(f"the {m:x}-ab{m} cat's" for m in range(n, n + 10_000)))
    for n in range(10):
        encode(f"{n}" * 500_000)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 5_000_000


def test_chunks_met_once_do_not_drive_out_common_ones(whole, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 1_000)
    made, pack = [], tokens.pack

    def counted(form, *ids):
        made.append(form)
        return pack(form, *ids)

    monkeypatch.setattr(tokens, "pack", counted)
    encode = encoder.__wrapped__(VOCABULARY)
    common = " ".join(f"q{chr(97 + n // 26)}{chr(97 + n % 26)}x" for n in range(200))
    ids = [encode(common), encode(common)]
    letters = "bcdfghjklm"
    encode(" ".join("z" + "".join(letters[int(d)] for d in str(n)) for n in range(5_000)))
    made.clear()
    ids.append(encode(common))
    assert len(made) < 20
    assert {i for i in ids} == {np.array(whole.encode(common, add_special_tokens=False).ids, "<u4").tobytes()}


def check(rows, docs, whole, capacity=4096):
    by_sequence = defaultdict(list)
    for row in rows:
        by_sequence[row.sequence_id].append((row.offset, row.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for doc in docs:
        ids = [*whole.encode(doc.text or "", add_special_tokens=False).ids, 1]
        for n, begin in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[begin : begin + capacity], "<u4")
            wanted[(doc.doc_id, n, begin, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_given_documents(spark, small, whole):
    docs = table(spark, small, "documents")
    used, least = check(packing.pack(docs, VOCABULARY).collect(), docs.collect(), whole)
    assert used <= least * 1.03 + 1


def test_odd_rows(spark, odd, none, whole):
    check(packing.pack(odd, VOCABULARY).collect(), odd.collect(), whole)
    assert packing.pack(none, VOCABULARY).count() == 0


def test_plans_hold_everything_and_waste_little():
    draw = random.Random(4)
    for shape in ("uniform", "large", "one", "two"):
        histogram = Counter()
        for _ in range(4_000):
            length = {
                "uniform": draw.randint(1, 4096),
                "large": draw.randint(1400, 2600),
                "one": 1500,
                "two": draw.choice([2500, 900]),
            }[shape]
            histogram[length] += 1
        bins = packing.plan(histogram)
        ranks = defaultdict(set)
        for each in bins:
            assert each.room == 4096 - sum(length * copies for length, _, copies in each.items) >= 0
            for length, rank, copies in each.items:
                new = set(range(rank, rank + copies * each.count))
                assert not new & ranks[length]
                ranks[length] |= new
        assert {length: len(r) for length, r in ranks.items()} == dict(histogram)
        assert all(r == set(range(len(r))) for r in ranks.values())
        used = sum(each.count for each in bins)
        least = -(-sum(length * n for length, n in histogram.items()) // 4096)
        if shape == "uniform":
            assert used <= least * 1.03
        if shape == "one":
            assert used == 2_000
