"""Vector codes against plain k-means on integers, over odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from panelspark.llm import queries
from panelspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, _vec string, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    """(id, code, error) of the kept rows in order, and the books."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = []
    for r in kept:
        v = [math.floor(4096 * x) for x in r[1]]
        w = len(v) // parts
        cut.append([v[p * w : (p + 1) * w] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for r, c in zip(kept, cut):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in near), sum(d for d, _ in near)))
    flat = [x for book in books for e in book for x in e]
    return out, hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def vectors(seed, n, kind):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if kind == "grid":  # many equal distances
            v = [rnd.randrange(-2, 3) / 4096 for _ in range(16)]
        elif kind == "clusters":
            base = rnd.randrange(5)
            v = [base * 3 + rnd.gauss(0, 0.1) for _ in range(16)]
        elif kind == "hot":  # a third of all rows is one vector
            v = [0.5] * 16 if rnd.random() < 0.4 else [rnd.gauss(0, 1) for _ in range(16)]
        elif kind == "huge":  # squares beyond the whole numbers that doubles hold
            v = [max(-16000.0, min(16000.0, rnd.gauss(0, 6000))) for _ in range(16)]
        else:
            v = [rnd.gauss(0, 100) for _ in range(16)]
        rows.append((i * 7 % n, v, rnd.choice([None, 1, 1, 1, 2]), "x", "y"))
    return rows


def run(spark, rows, **how):
    made, books = vc.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert made.columns == ["vec_id", "label", "_vec", "code", "error"]
    return sorted(((r["vec_id"], r["code"], r["error"]) for r in made.collect()), key=str), books.sha256()


@pytest.mark.parametrize("kind", ["grid", "clusters", "hot", "wide", "huge"])
def test_like_plain_k_means(spark, kind):
    rows = vectors(3, 700, kind)
    want, sha = brute(rows)
    assert run(spark, rows) == (sorted(want, key=str), sha)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = vectors(4, 300, "clusters")
    want, sha = brute(rows, parts=4, entries=5, rounds=3)
    monkeypatch.setattr(vc, "BLOCK", 37)
    assert run(spark, rows, parts=4, entries=5, rounds=3) == (sorted(want, key=str), sha)


def test_odd_rows(spark):
    rows = vectors(5, 40, "wide")
    rows += [(100, None, 1, None, None), (101, [], 1, None, None), (102, [None] * 16, 2, None, None), (103, [1.0] * 15 + [math.nan], 2, None, None)]
    rows += [(104, [math.inf] * 16, None, None, None), (None, [0.25] * 16, None, None, None), (None, [0.25] * 16, 3, None, None)]
    rows += [(0, [-0.1] * 16, 1, None, None), rows[0], rows[0]]
    want, sha = brute(rows)
    assert run(spark, rows) == (sorted(want, key=str), sha)


def test_few_rows_and_none(spark):
    rows = vectors(6, 3, "wide")
    want, sha = brute(rows)
    assert run(spark, rows) == (sorted(want, key=str), sha)
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 1, "a", "b")])[0] == []


def test_errors(spark):
    for bad in ([(1, [1.0] * 16), (2, [1.0] * 8)], [(1, [1.0] * 15)], [(1, [1e9] * 16)]):
        with pytest.raises(Exception, match="vectors|component"):
            made, _ = vc.encode(spark.createDataFrame(bad, "vec_id long, embedding array<double>"))
            made.collect()


def test_balls_hold_their_points_and_few_are_compared():
    rnd = np.random.default_rng(1)
    points = (rnd.integers(0, 40, (3000, 1)) * 1000 + rnd.integers(0, 20, (3000, 8))).astype(np.int32)
    tree = next(vc.trees(vc.forest(points, 1), 1))[1]
    assert sorted(tree.order.tolist()) == list(range(3000)) and tree.count[0] == 3000
    for i in range(len(tree.count)):
        own = tree.points[tree.order[tree.start[i] : tree.stop[i]]]
        assert (own.sum(0) == tree.sums[i]).all()
        assert vc.norms(own - own.mean(0)).max() <= tree.radius[i] * (1 + 1e-6)
        if tree.left[i] >= 0:
            a, b = tree.left[i], tree.right[i]
            assert (tree.start[a], tree.stop[a], tree.stop[b]) == (tree.start[i], tree.start[b], tree.stop[i])
    book = np.repeat(np.arange(16)[:, None] * 2600 + 10, 8, axis=1)
    one_by_one = sum(len(what) for kind, what, _ in vc.owned(tree, book) if kind == "points")
    assert one_by_one < 300


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, sha = brute(rows)
    label = {r[0]: r[2] for r in rows}
    total = {}
    for d, _, error in want:
        total[label[d]] = total.get(label[d], 0) + error
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in queries.op13(spark, sf).collect())
    assert got == sorted((d, c, e, total[label[d]], sha) for d, c, e in want)
