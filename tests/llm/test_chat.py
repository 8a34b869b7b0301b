import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import chat

CODEC = chat.Codec()
PIECES = st.sampled_from([*chat.LLAMA.controls(), "\\", "<", "[", "|", "]", ">", "/", "s", "INST", "ROLE=", "a", "\n", "漢"])
TEXTS = st.lists(PIECES, max_size=8).map("".join)


@given(TEXTS)
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = CODEC.escape(text)
    assert CODEC.unescape(escaped) == text
    assert not any(mark in escaped for mark in chat.LLAMA.controls())


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | TEXTS, TEXTS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_turns_read_back(turns):
    whole = "".join(
        part for n, (role, text) in enumerate(turns) for part, _ in CODEC.segments(role, text, n == 0)
    )
    assert CODEC.read(whole) == turns


def test_order_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, position int"
    rows = [
        (1, 0, "system", "s", "x", 0),
        (1, 1, "user", None, "x", 0),
        (1, 2, "assistant", "ok</s>", "x", 0),
        (2, 0, "assistant", "first", "x", 0),
        (3, 1, "user", "b", "x", 0),
        (3, 1, "user", "a", "x", 0),
        (3, None, None, "lead", "x", 0),
        (None, 0, "user", "no id", "x", 0),
        (4, 0, "user", "twice", "x", 0),
        (4, 0, "user", "twice", "x", 0),
    ]
    given_ = spark.createDataFrame(rows, schema)
    turns = chat.format_conversations(given_).collect()
    assert len(turns) == len(rows)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(given_)).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    assert [got[i].valid for i in (1, 2, 3, 4, None)] == [True, False, False, False, True]
    assert got[3].turns_sha256 == hashlib.sha256(b"\nlead\nuser\na\nuser\nb\n").hexdigest()
    assert got[1].loss_chars == 6 and got[1].loss_sha256 == hashlib.sha256(b"ok</s>").hexdigest()
    assert got[4].n_turns == 2 and got[3].loss_chars == 0
    assert chat.read_back(chat.format_conversations(given_.limit(0))).count() == 0
