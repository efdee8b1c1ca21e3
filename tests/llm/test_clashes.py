"""Columns whose names the operators use inside stay as they are; odd rows pass through every operator."""

import public_tokenizers
import pytest

from panelspark.llm import bpe, decontaminate, html_extract, language_model, toxicity

ROWS = [(1, "one two", "a", "b", "c"), (1, "one two", "a", "b", "c"), (None, None, None, None, None), (2, "x " * 1000, "a", "b", "c")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, _text string, _ids string, _html string")


def check(df, out, added):
    assert out.columns == [*df.columns, *added]
    kept = sorted(map(str, (tuple(r)[: len(df.columns)] for r in out.collect())))
    assert kept == sorted(map(str, ROWS))


def test_bpe(spark, df):
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    check(df, bpe.decode(bpe.encode(df, vocabulary), vocabulary), ["ids", "decoded"])


def test_toxicity(spark, df):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    check(df, toxicity.score(df, toxicity.train(df, labels)), ["score"])


def test_language_model(spark, df):
    check(df, language_model.score(df, language_model.train(df)), ["n_tokens", "n_known", "base_score", "score"])


def test_decontamination(spark, df):
    bench = spark.createDataFrame([(1, "never met")], "item_id long, text string")
    check(df, decontaminate.find(df, bench), ["n_words", "spans", "items"])
    check(df, decontaminate.remove(df, bench), [])


def test_html(spark, df):
    out = html_extract.extract(df, "text", "main")
    assert out.columns == ["doc_id", "_text", "_ids", "_html", "main"] and out.count() == len(ROWS)
