"""The index on its own, and finds against a plain search."""

import random
import re

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, queries, registry
from panelspark.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, phrase in items:
        p = words(phrase)
        n = min(window, len(p))
        for i in range(len(p) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_suffixes_in_order():
    rnd = np.random.default_rng(1)
    for text in (rnd.integers(0, 3, 300), np.zeros(200, int), np.tile([1, 2, 0], 50), np.array([5])):
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want


def test_search_and_locate():
    rnd = np.random.default_rng(2)
    text = rnd.integers(0, 5, 2000)
    index = FMIndex(text, 4)
    for n in (1, 2, 4):
        phrases = rnd.integers(1, 5, (20, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_matches_sql(spark, sf):
    assert compare.compare(spark, compare.duck(sf), sf, queries.op10, registry.ORACLE["op10_fm_decontaminate"]) is None


ITEMS = [(1, "alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, None), (4, "..."), (5, "solo"), (None, "beta gamma"), (5, "É é É")]


def random_texts():
    rnd = random.Random(5)
    pool = "alpha beta gamma one two three four five six seven eight nine ten eleven twelve solo x é É".split()
    texts = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(40)))) for i in range(200)]
    line = ITEMS[1][1]
    texts += [(200, line.upper()), (201, f"a {line} b. {line}"), (202, None), (203, ""), (204, line.replace(" ", "--")), (204, line.replace(" ", "--"))]
    texts += [(205, "alpha"), (206, "beta gamma"), (207, f"alpha beta {line} gamma"), (208, "solo " * 20000), (None, "solo")]
    return texts


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_finds(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = random_texts()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in decontaminate.find(df, bench).collect())
    items = [("" if i is None else i, t) for i, t in ITEMS]
    assert got == sorted((str(i), *plain(t, items)) for i, t in texts)


def test_removal(spark):
    texts = random_texts()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(i, t, None) for i, t in texts], "doc_id long, text string, more string")
    got = decontaminate.remove(df, bench, changed="cut")
    again = decontaminate.find(got, bench).collect()
    assert len(again) == len(texts) and not any(r["spans"] for r in again)
    before = dict(texts)
    for r in again:
        touched = plain(before[r["doc_id"]], ITEMS)[1] > 0
        assert r["cut"] == touched
        if not touched:
            assert r["text"] == before[r["doc_id"]]
    assert decontaminate.remove(df.limit(0), bench).count() == 0
    whole = decontaminate.remove(df, bench.limit(0)).select("doc_id", "text")
    assert whole.exceptAll(df.select("doc_id", "text")).where(F.lit(True)).count() == 0
