"""Ids with many rows, against brute force."""

import numpy as np

from panelspark.llm import ann


def test_repeated_ids_hide_nobody(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(40)] * 3
    # many vectors of one id beside the query, and copies
    rows += [(99, (np.array(rows[0][1]) + rnd.normal(size=4) / 1000).tolist()) for _ in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, lambda i: i == 0).orderBy("rank").select("vec_id", "score").collect()]
    query, best = np.array(rows[0][1]), {}
    for i, v in rows:
        gap = float(np.linalg.norm(np.array(v) - query))
        best[i] = min(gap, best.get(i, gap))
    want = sorted((gap, i) for i, gap in best.items() if i)[:10]
    assert [i for i, _ in got] == [i for _, i in want]
    assert np.allclose([g for _, g in got], [g for g, _ in want])
