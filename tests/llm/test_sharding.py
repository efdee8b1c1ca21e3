"""The hash tree against the same draws in Python, and what moves."""

import collections
import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import queries, sharding


def spark_hash(key: str, child: str) -> int:
    first = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return xxhash.xxh64_intdigest(child.encode(), seed=first)


def brute(key, node):
    while node.children:
        draws = []
        for child in node.children:
            u = ((spark_hash(key, child.name) >> 11) + 0.5) / 2**53
            draws.append((-math.log(u) / child.weight, child))
        node = min(draws, key=lambda x: x[0])[1]
    return node.shard


def shards(spark, tree, n=4000):
    rows = sharding.assign(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()
    return {r["doc_id"]: r["shard"] for r in rows}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    slots = collections.defaultdict(list)
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert r["shard"] == brute(str(r["doc_id"]), queries.SHARDS)
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    assert any(r["grown_shard"] == 40 for r in got)


def test_shares_follow_the_weights(spark):
    tree = sharding.reweigh(sharding.uniform_tree(2, 2, 2), "r0", 12.0)
    count = collections.Counter(shards(spark, tree, 20000).values())
    assert sum(count[s] for s in range(4)) / 20000 == pytest.approx(12 / 16, abs=0.02)
    assert all(count[s] / 20000 == pytest.approx(3 / 16, abs=0.02) for s in range(4))


def test_moves_stay_where_weights_change(spark):
    tree = sharding.uniform_tree(3, 2, 4)
    before, after = shards(spark, tree), shards(spark, sharding.reweigh(tree, "r1/k0/s2", 3.0))
    moved = {d for d in before if before[d] != after[d]}
    assert moved and all(8 <= before[d] < 12 and after[d] == 10 for d in moved)
    grown = shards(spark, sharding.grow(sharding.grow(tree)))
    assert {grown[d] for d in before if grown[d] != before[d]} == {24, 25}
    assert 0 < sum(x == 24 for x in grown.values()) < 4000 / 12


def test_slots_of_odd_rows(spark):
    rows = [(None, 1), (None, 1), (1, 2), (1, 2), (1, 3), (2, None)] * 50
    df = sharding.assign(spark.createDataFrame(rows, "doc_id long, size long"), sharding.uniform_tree(1, 1, 3))
    for chunk in (200_000, 40):
        got = sharding.slots(df, ["doc_id", "size"], chunk=chunk).collect()
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter(rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.slots(df.limit(0), ["doc_id", "size"]).count() == 0
    again = df.withColumn("shard", F.lit("old"))
    assert sharding.assign(again, sharding.uniform_tree(1, 1, 1)).select("shard").distinct().collect()[0]["shard"] == 0


def test_slots_beside_columns_of_any_name(spark):
    names = ["_n", "_chunk", "_part", "_s", "_c", "_base", "_first", "_rows", "slot"]
    df = spark.range(300).selectExpr("id AS doc_id", *[f"id AS {n}" for n in names])
    df = sharding.assign(df, sharding.uniform_tree(1, 1, 3))
    got = sharding.slots(df, ["doc_id"], chunk=40)
    assert got.columns == ["doc_id", *names[:-1], "shard", "slot"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["shard"]].append(r["slot"])
        assert all(r[n] == r["doc_id"] for n in names[:-1])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 300
