"""Every stage of the pipeline against a plain reading of its input."""

import re

import pytest
from test_neardup_sizes import groups

import corpus_pipeline as P
from panelspark.llm import queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_toxicity(stages):
    before, after = map(rows, stages[0])
    assert list(stages[0][1].columns) == P.COLUMNS
    bad = set("trash pathetic idiot disgusting worthless stupid clown loser scum moron".split())
    for d in set(before) - set(after):
        assert bad & set(words(before[d]["text"])) or before[d]["lang"] != "en"
    assert all(after[d] == before[d] for d in after)


def test_near_duplicates(stages):
    before, after = map(rows, stages[1])
    want = groups([(d, r["text"]) for d, r in before.items()], P.NEAR_BAR, P.NEAR_WORDS)
    assert set(after) == {d for d, (_, c) in want.items() if c == d}
    assert all(after[d] == before[d] for d in after)


def test_decontamination(spark, stages):
    before, after = map(rows, stages[2])
    assert set(before) == set(after)
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(p) for p in phrases}
    hit = lambda w: any(tuple(w[i : i + n]) in phrases for n in sizes for i in range(len(w) - n + 1))
    assert any(hit(words(r["text"])) for r in before.values())
    for d, r in after.items():
        assert not hit(words(r["text"]))
        if hit(words(before[d]["text"])):
            assert r["n_chars"] == len(r["text"]) < len(before[d]["text"])
        else:
            assert r == before[d]


def test_bpe(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    before, after = map(rows, stages[3])
    assert set(before) == set(after)
    for d, r in after.items():
        assert r["ids"] == tokenizer.encode(before[d]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "no id here", "en", "a", 10),
    (3, "one two three four five six seven", "en", "a", 33),
    (3, "one two three four five six seven", "en", "a", 33),
    (4, "ONE two three four five six seven", "en", "a", 33),
    (5, "word " * 30000, "en", "a", 150000),
]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (3, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 2, 3, 5]
    assert P.run(spark, str(tmp_path)).count() >= 4
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
