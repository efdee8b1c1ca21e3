"""Packing: pieces against the tokenizers library, bins against their bounds and exhaustive search."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import bpe, packing, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(FILE)
    made.no_truncation()
    made.no_padding()
    return made


def plain_pieces(doc_id, text, tokenizer, capacity, end=2):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
    count = -(-len(ids) // capacity)
    first = len(ids) - (count - 1) * capacity
    bounds = [0, *[first + i * capacity for i in range(count)]]
    return [(doc_id, i, a, b - a, ids[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def check_bins(rows, capacity):
    """Every sequence is full from 0 without gaps and within the capacity; the number of sequences."""
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {}
    for doc_id, text in docs:
        for d, piece, start, length, ids in plain_pieces(doc_id, text, tokenizer, 1024):
            want[d, piece] = (start, length, zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = queries.op11(spark, sf).collect()
    assert len(got) == len(want)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    lengths = [n for _, n, _ in want.values()]
    assert check_bins(got, 1024) <= min(-(-sum(lengths) // 1024) + 1, best_fit_decreasing(lengths, 1024))


def test_ids_are_those_of_the_tokenizers_library(tokenizer):
    encode = packing.encoding(bpe.Vocabulary(FILE)).encode_to_numpy
    rnd = random.Random(9)
    signs = ["a", "e", "t", " ", "  ", "\n", "1", "'s", "'", "é", "日", "\U0001f600", ".", "ing", "<|endoftext|>", "\u3000", "\u0308"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, 25))) for _ in range(3000)]
    texts += ["a" * 50_000, " " * 50_000 + "x", "\n " * 20_000, "日本" * 20_000, "!?" * 20_000]
    for t in texts:
        assert encode(t, allowed_special="all").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_sequences_hold_the_documents(spark, tokenizer):
    rows = [(1, "a few words"), (2, None), (3, ""), (4, "long " * 100), (None, "no id"), (5, "<|endoftext|>x"), (5, "<|endoftext|>x")]
    df = spark.createDataFrame([(d, t, 7, "k") for d, t in rows], "doc_id long, text string, piece int, _text string")
    cut = packing.pieces(df, bpe.Vocabulary(FILE), capacity=16, end=9)
    assert cut.columns == ["doc_id", "_text", "piece", "start", "length", "ids"]
    packed = packing.pack(cut, capacity=16)
    found = packed.collect()
    check_bins(found, 16)
    want = [p for d, t in rows for p in plain_pieces(d, t, tokenizer, 16, 9)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids"])) for r in found)
    made = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in found:
        s = made[r["sequence_id"]]
        assert s["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"] and r["offset"] in s["offsets"]
    assert sum(len(s["ids"]) for s in made.values()) == sum(len(p[4]) for p in want)


@pytest.mark.parametrize("cell", [500, 3])
def test_hot_lengths(spark, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL", cell)
    rnd = random.Random(8)
    lengths = [300] * 4000 + [rnd.randint(1, 1024) for _ in range(4000)] + [1024] * 500
    df = spark.createDataFrame([(n, "s", 1) for n in lengths], "length long, _spread string, _number int").repartition(5)
    got = packing.pack(df)
    assert got.columns == ["length", "_spread", "_number", "sequence_id", "offset"]
    rows = got.collect()
    assert collections.Counter(r["length"] for r in rows) == collections.Counter(lengths)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert check_bins(rows, 1024) <= best_fit_decreasing(lengths, 1024)


def test_empty_and_errors(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(none, bpe.Vocabulary(FILE))).count() == 0
    for bad in (0, 1025, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length long"))


def test_fullest_is_the_fullest():
    rnd = random.Random(4)
    for _ in range(300):
        count = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(0, 60)
        got = packing.fullest(count, room)
        assert all(0 < n <= count[x] for x, n in got)
        sums = (sum(x * n for x, n in zip(count, take)) for take in itertools.product(*[range(n + 1) for n in count.values()]))
        assert sum(x * n for x, n in got) == max(s for s in sums if s <= room)


def test_plans_are_small_and_near_the_bound():
    rnd = random.Random(5)
    count = collections.Counter(min(1024, int(rnd.lognormvariate(5, 1)) + 1) for _ in range(50_000))
    for times in (1, 10**6):
        many = {x: n * times for x, n in count.items()}
        bins = packing.plan(many, 1024)
        used = collections.Counter()
        for n, parts in bins:
            assert sum(x * k for x, k in parts) <= 1024
            for x, k in parts:
                used[x] += n * k
        assert used == many and len(bins) < 1024 * 8
        bound = -(-sum(x * n for x, n in many.items()) // 1024)
        assert sum(n for n, _ in bins) <= bound * (1 + 1e-5) + 2
