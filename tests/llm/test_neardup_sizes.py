"""Near-duplicates at another shingle size and bar, against all pairs."""

import random

from test_neardup import SCHEMA, sets_of

from panelspark.llm import neardup


def groups(texts, bar, size):
    """(set size, smallest id reachable) of each document, all pairs compared."""
    sets = sets_of(texts, size)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, d in enumerate(ids):
        for e in ids[:i]:
            n = len(sets[d] & sets[e])
            if 100 * n >= bar * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed):
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(90)]
    texts = [(900 + i, " ".join(base[:i])) for i in range(1, 8)]
    for d in range(200):
        at, n = rnd.randrange(80), rnd.choice([0, 1, 2, 3, 5, 8, 12, 15, 18])
        w = base[:at] + [f"x{rnd.randrange(10**6)}" for _ in range(n)] + base[at + rnd.choice([0, n]) :]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(10**6)}"
        texts.append((d, " ".join(w)))
    return texts


def test_five_words_and_eighty_hundredths(spark):
    texts = near_copies(5)
    found = neardup.dedup(spark.createDataFrame(texts, SCHEMA), bar=80, size=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups(texts, 80, 5)


def test_one_of_each_group_stays(spark):
    other = " ".join(f"z{i}" for i in range(40))
    texts = near_copies(8)
    want = groups(texts, 80, 5)
    kept = {d for d, (_, c) in want.items() if c == d}
    rows = [(d, t, "k", d) for d, t in texts]
    schema = "doc_id long, text string, _key string, _node long"
    got = neardup.keep_one(spark.createDataFrame(rows, schema), 80, 5)
    assert got.columns == ["doc_id", "text", "_key", "_node"]
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in kept)
    # a text without a copy stays, whatever else has its id; repeated rows are one document; rows without an id stay
    x = " ".join(f"x{i}" for i in range(40))
    odd = [(1, x), (3, x), (3, other), (3, other), (7, x + " more"), (7, None), (None, x), (None, x), (-2, ""), (9, "y " * 30)]
    got = neardup.keep_one(spark.createDataFrame([(d, t, "k", 0) for d, t in odd], schema), 80, 5).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    want = [(1, x), (3, other), (7, None), (None, x), (None, x), (-2, ""), (9, "y " * 30)]
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
    assert neardup.keep_one(spark.createDataFrame([], schema), 80, 5).count() == 0
