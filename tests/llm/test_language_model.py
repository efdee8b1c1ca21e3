"""The model against a brute-force one, and its sums."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import language_model as L
from panelspark.llm import queries
from panelspark.llm import words as W

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END = None


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), END]


def brute(train_texts, texts):
    uni, pair = collections.Counter(), collections.Counter()
    for t in train_texts:
        seq = tokens(t)
        uni.update(seq)
        pair.update(zip(["<s>", *seq[:-1]], seq))
    total, v = sum(uni.values()), len(uni)
    context, by_count, before = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (a, b), c in pair.items():
        context[a] += c
        by_count[a][min(c, 3)] += 1
        before[b] += 1
    counts = lambda values: np.array([0] + [sum(1 for x in values if x == i) for i in (1, 2, 3, 4)])
    d = (0, *L.discounts(counts(pair.values())))
    e = (0, *L.discounts(counts(before.values())))
    kinds = len(pair)
    rest = sum(e[min(k, 3)] for k in before.values()) / kinds if kinds else 1

    def p(a, b):
        k = before[b]
        q = max(k - e[min(k, 3)], 0) / kinds + rest / (v + 1) if kinds else 1.0
        c = context[a]
        if not c:
            return q
        lam = sum(d[i] * n for i, n in by_count[a].items()) / c
        x = pair[a, b]
        return max(x - d[min(x, 3)], 0) / c + lam * q

    out = []
    for t in texts:
        seq = tokens(t)
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *seq[:-1]], seq))
        base = sum(math.log10((uni[w] + 1) / (total + v + 1)) for w in seq)
        out.append((len(seq), sum(uni[w] > 0 for w in seq), base, score))
    return total, out, (p, uni)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    total, want, _ = brute([t for d, t in docs if not held[d]], [t for _, t in docs])
    got = {r["doc_id"]: r for r in queries.op2(spark, sf).collect()}
    assert len(got) == len(docs)
    for (d, _), (n, known, base, score) in zip(docs, want):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


TEXTS = [None, "", "a b a b c", "A B é", "a b a b c", "c " * 300, "\t x \x0b y\x00z "]


@pytest.fixture(params=[0, 3])
def bits(request, monkeypatch):
    """Tables in one part and in several."""
    monkeypatch.setattr(L, "bits_for", lambda entries: request.param)


def frame(spark, texts):
    return spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")


def test_small_texts(spark, bits):
    df = frame(spark, TEXTS)
    trained = L.train(df)
    total, want, (p, uni) = brute(TEXTS, TEXTS + ["b new a"])
    assert trained.tokens == total and trained.vocabulary == len(uni)
    rows = L.score(frame(spark, TEXTS + ["b new a"]).withColumn("i", F.monotonically_increasing_id()).coalesce(1), trained).orderBy("i").collect()
    got = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows)
    assert got == sorted((n, k, round(b, 9), round(s, 9)) for n, k, b, s in want)
    for context in ("a", "c", "<s>", "never"):
        assert sum(p(context, w) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_large_counts_are_whole(spark, bits):
    """Counts beyond the short form, made small for the test, give the same scores."""
    df = frame(spark, TEXTS * 3)
    columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    want = sorted(map(tuple, L.score(df, L.train(df)).select(*columns).collect()))
    for most in (1, 2, 7):
        assert sorted(map(tuple, L.score(df, L.train(df, most=most)).select(*columns).collect())) == want


def test_no_training_texts(spark):
    df = frame(spark, TEXTS)
    trained = L.train(df.limit(0))
    assert (trained.tokens, trained.vocabulary) == (0, 0)
    assert {(r["score"], r["base_score"], r["n_known"]) for r in L.score(df, trained).collect()} == {(0.0, 0.0, 0)}
    assert L.score(df.limit(0), trained).count() == 0


def test_parts_and_keys():
    keys = np.sort(W.mix(np.arange(1000, dtype=np.uint64)))
    assert (L.unmix(W.mix(keys)) == keys).all()
    assert (L.unpack(L.pack(keys)) == keys).all()
    assert (L.from_planes(L.planes(keys)) == keys).all()
    assert (np.diff(L.part_of(keys, 3)) >= 0).all() and set(L.part_of(keys, 3)) == set(range(8))
    assert (L.part_of(keys, 0) == 0).all()
