"""Words spelled to their end, and runs without spaces."""

import numpy as np

from panelspark.llm import toxicity
from panelspark.llm import words as W


def trained(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def scores(spark, model, texts):
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_endings_of_long_words_and_expressions_inside_runs(spark):
    rnd = np.random.default_rng(3)
    signs = [chr(0x4E00 + i) for i in range(60)]
    run = lambda n: "".join(rnd.choice(signs, n))
    rows = []
    for i in range(300):
        bad = i % 2
        # alike in their first 20 bytes; a run whose beginning says nothing
        word = "counterrevolutionary" + ("vile" if bad else "kind")
        text = run(rnd.integers(6, 30)) + ("騴蛋" if bad else "") + run(rnd.integers(0, 20))
        rows.append((i, word if i % 4 < 2 else text, bad))
    model = trained(spark, rows)
    got = scores(spark, model, ["counterrevolutionaryvile", "counterrevolutionarykind", run(40) + "騴蛋" + run(9), run(50)])
    assert got[0] > 0.5 > got[1] and got[2] > 0.5 > got[3]


def test_pieces_cover_every_byte():
    texts = ["short", "x" * 47, "y" * 48, "abc" * 200, "你好世界" * 5, "слово", "ab你", ""]
    found = W.of_texts(texts, W.ALNUM)
    doc, start, stop, ended, hashes = toxicity.pieces(found)
    for d, text in enumerate(texts):
        met = {p for a, b in zip(start[doc == d], stop[doc == d]) for p in range(a - found.base[d], b - found.base[d])}
        assert met == set(range(len(text.encode())))
    assert [int((doc == d).sum()) for d in range(8)] == [1, 1, 48, 600, 20, 1, 3, 0]
    # equal bytes have equal hashes wherever they stand; the last piece of a run is like the word
    assert hashes[doc == 6][-1] == W.of_texts(["你"], W.ALNUM).hashes[0]
    spelled = toxicity.Spelling(found.data, start, stop, ended)
    assert len(spelled.word) == (stop - start + ended).sum() and len(np.unique(spelled.key[spelled.first[:-1]])) == 1
