"""Held-out accuracy, what scores may depend on, odd input."""

import zlib

import numpy as np

from panelspark.llm import queries, toxicity


def auc(score, label):
    rank = score.rank()
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    some = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert auc(some.score, some.toxic) > 0.93 and (some.predicted == some.toxic).mean() > 0.95


WORDS = "the of and to house water green over under light stone river cloud table paper".split()


def texts(n, seed):
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = rnd.choice(WORDS, 30).tolist()
        if i % 4 == 0:
            words[5], words[17] = "vile" + rnd.choice(list("abcdefgh")), "Vile" + rnd.choice(list("ijklmnop"))
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_an_unseen_ending_of_a_known_beginning(spark):
    rows = texts(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = [(1, "the house vilezzz over vileyyy"), (2, "the house green over paper"), (3, None), (4, ""), (5, "% $ "), (6, "the " * 50000), (None, "VILEX vilex2"), (6, "x" * 100000)]
    got = toxicity.score(spark.createDataFrame([(d, t, "a", 1) for d, t in odd], "doc_id long, text string, score string, label int"), model)
    score = {(r["doc_id"], (r["text"] or "")[:5]): r["score"] for r in got.collect()}
    assert got.columns == ["doc_id", "text", "label", "score"]
    assert score[1, "the h"] > 0.5 > score[2, "the h"] and score[None, "VILEX"] > 0.5
    assert score[3, ""] == score[4, ""] == score[5, "% $ "] < 0.5
    assert score[6, "the t"] < 0.5
    assert toxicity.score(got.limit(0), model).count() == 0


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows, want in (([(1, 0)], 0.0), ([], 0.0), ([(1, 1), (2, 1)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(abs(r["score"] - want) < 1e-6 for r in toxicity.score(docs, model).collect())


def test_logistic_fit():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 1))
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    assert np.allclose(toxicity.fit_logistic(x, y, np.ones(4000), 0.0), [2, -1], atol=0.25)
