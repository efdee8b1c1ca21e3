"""Near-duplicates against sets of word tuples compared by their rare members."""

import collections
import random
import re

import numpy as np
import pytest

from panelspark.llm import components, neardup, queries
from panelspark.llm import words as W

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string"


def sets_of(texts, size=3):
    out = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[d] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def brute(texts, bar=85):
    """(set size, smallest id reachable) of each document, every pair compared."""
    sets = sets_of(texts)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by_member = collections.defaultdict(list)
    for d in ids:
        both = collections.Counter(e for g in sets[d] for e in by_member[g])
        for e, n in both.items():
            if 100 * n >= bar * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for g in sets[d]:
            by_member[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark, texts):
    got = {r["doc_id"]: r for r in neardup.dedup(spark.createDataFrame(texts, SCHEMA)).collect()}
    want = brute(texts)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4(spark, sf).collect()}
    assert got == brute(docs)


def test_chains_and_a_large_group(spark):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for d in range(400):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        texts.append((d, " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for d in range(400, 430):
        chain[(d * 7) % 60] = f"d{d}"
        texts.append((d, "\t".join(chain).upper() if d % 2 else " ".join(chain)))
    check(spark, texts)


def test_edges_at_the_bar(spark):
    words = [f"a{i}" for i in range(202)]
    near = [words[:102], words[:87] + ["q"], words[:88], words[:84]]
    check(spark, [(i, " ".join(w)) for i, w in enumerate(near)])


def test_odd_rows(spark):
    rows = [(7, None), (8, ""), (9, " \n\t"), (3, "one"), (5, "ONE"), (6, "one two"), (1, "one two"), (2, "é ß 中"), (None, "one two"), (None, None)]
    rows += [(10, "word " * 5000), (11, "word " * 4000), (1, "one two")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA + ", n long, sketch string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.dedup(df).collect())
    assert got == collections.Counter(
        [(7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (3, 1, 3, True), (5, 1, 3, False), (6, 1, 1, False), (1, 1, 1, True), (1, 1, 1, True)]
        + [(2, 1, 2, True), (None, 1, None, True), (None, 0, None, True), (10, 1, 10, True), (11, 1, 10, False)]
    )
    assert neardup.dedup(df.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(2)
    universe = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    one, two = universe[:2000], universe[500:2500]
    sketch = lambda s: neardup.registers(s, np.array([0, len(s)]))
    assert (sketch(universe[:2500]) == np.maximum(sketch(one), sketch(two))).all()
    j = neardup.likely_similarity(sketch(one), sketch(two), np.array([2000.0]), np.array([2000.0]))
    assert j[0] == pytest.approx(0.6, abs=0.15)


def test_distinct_shingles():
    found = W.of_texts(["a b c a b c a b c", "a b", "", "a b c"])
    hashes, first = neardup.shingle_hashes(found)
    assert np.diff(first).tolist() == [3, 1, 0, 1]
    assert hashes[first[3]] in hashes[: first[1]]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent if find(x) != x}
