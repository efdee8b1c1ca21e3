"""The pipeline's near-duplicates at five words and 0.8, against all pairs."""

from test_neardup_sizes import groups, near_copies

import corpus_pipeline as P


def test_the_stage_takes_five_words_and_eighty_hundredths(spark):
    # a replaced passage, between 0.80 and 0.85 by both sizes; changes far apart, above 0.85 by three words and below 0.8 by five
    block, far = [f"a{i}" for i in range(100)], [f"c{i}" for i in range(90)]
    texts = near_copies(6) + [(1000, " ".join(block)), (1001, " ".join(block[:93] + [f"b{i}" for i in range(13)]))]
    texts += [(1002, " ".join(far)), (1003, " ".join(f"d{i}" if i in (30, 60) else w for i, w in enumerate(far)))]
    want = groups(texts, 80, 5)
    kept = {d for d, (_, c) in want.items() if c == d}
    assert 1001 not in kept and 1003 in kept
    assert kept != {d for d, (_, c) in groups(texts, 85, 3).items() if c == d}
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, "").collect()} == kept
