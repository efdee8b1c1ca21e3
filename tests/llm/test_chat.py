"""Round trips of the template and the digests read back."""

import hashlib

import compare
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import chat, queries, registry

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", " ", "\n", "a", "é😀", "<\\s>", "[\\\\INST]"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "tool", "", "a b\n</s>", "Über"])


@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_conversation_comes_back(turns):
    whole = "".join(chat.render(role, text)[0] for role, text in turns)
    assert [(role, chat.unescape(text)) for role, text, _ in chat.parse(whole)] == turns


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_escapes_leave_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m[1] == "" for m in chat.CONTROL.finditer(chat.escape(text)))
    if not chat.CONTROL.search(text):
        assert chat.escape(text) == text


def test_loss_spans():
    out, at, n = chat.render("assistant", "say </s> twice")
    assert out[at : at + n] == "say <\\/s> twice"
    assert chat.render("user", "x") == ("<s>[INST] x [/INST]", 10, 0)


@pytest.mark.parametrize("bad", ["x", " a", "<s>[INST] a", "<s>[INST]a [/INST]", "[INST] a [/INST]", " a</s>", "<s><s>[INST] a [/INST]", "</s>"])
def test_parser_refuses(bad):
    with pytest.raises((ValueError, IndexError)):
        chat.parse(bad)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.compare(spark, compare.duck(sf), sf, queries.op9, registry.ORACLE["op9_chat_format"]) is None
    one = queries.op9(spark, sf).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert one["n_turns"] == 2 and one["loss_chars"] == len(text)
    assert one["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert one["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 1, "assistant", "c" * 10**6), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role AS formatted")
    made = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {None: (1, 0), 1: (4, 10**6), 2: (1, 0)}
    turns = "\n\n" + f"assistant\n{'c' * 10**6}\n" + "user\nb\n" * 2
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
