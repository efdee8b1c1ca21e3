"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [chr(c) for c in range(0x250)] + ["中", "文", "\u0085", "　", "😀", "ا", "²", "<|endoftext|>", "'s", "'ll", " the", "\n\n", "   "]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, texts):
    ids, first = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def check(vocabulary, tokenizer, texts):
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(bpe.Encoder(vocabulary), texts) == want


def test_random_texts(vocabulary, tokenizer):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abcdehinorst ") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    check(vocabulary, tokenizer, texts)


def test_long_words_and_empty_texts(vocabulary, tokenizer):
    check(vocabulary, tokenizer, ["a" * 5000, "ab" * 3000, "", " " * 3000, "-" * 700, "x", "the" * 50, "\n"])


@given(st.lists(st.text(), max_size=4))
@settings(max_examples=60, deadline=None)
def test_any_text(vocabulary, tokenizer, texts):
    check(vocabulary, tokenizer, texts)


def test_exact_in_step_is_exact(vocabulary):
    rnd = random.Random(4)
    words = [bytes(rnd.choice(b"abcdeinorst") for _ in range(rnd.randint(1, 20))) for _ in range(2000)]
    assert vocabulary.exact_many(words) == [vocabulary.exact(w) for w in words]


def test_every_token_stands_alone(vocabulary):
    assert vocabulary.alone.all()


def test_full_cache_is_emptied(vocabulary, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
    encoder = bpe.Encoder(vocabulary)
    for text in ("one two three", "four five", "one five <|endoftext|>"):
        assert ids_of(encoder, [text]) == [tokenizer.encode(text, add_special_tokens=False).ids]


def test_round_trip_keeps_other_columns(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "é <|endoftext|> b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(r["decoded"] for r in out.collect()) == ["", "", "", "é <|endoftext|> b"]
    empty = bpe.decode(bpe.encode(df.limit(0), vocabulary), vocabulary)
    assert empty.count() == 0


def test_decode_nulls_and_broken_text(spark, vocabulary, tokenizer):
    half = tokenizer.encode("é", add_special_tokens=False).ids
    single = tokenizer.encode("😀", add_special_tokens=False).ids[:1]
    df = spark.createDataFrame([(1, None), (2, half), (3, single)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, vocabulary).collect()}
    assert got == {1: "", 2: "é", 3: tokenizer.decode(single, skip_special_tokens=False)}


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect())
    got = {r["doc_id"]: r for r in queries.op1(spark, sf).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
