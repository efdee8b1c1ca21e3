"""An interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by workers.

Tokens are words apart by white space (A-Z as lower case) and one end for each text.
Counting takes two passes over the training texts. The first counts tokens; sorted by a
64-bit hash they make the vocabulary, in parts of bounded size, and a token's place is
its number. The second packs each bigram of numbers into 64 bits, scrambles them by a
bijection and cuts the range of the scrambled keys into parts. A task adds up the
bigrams of a few million tokens before it sends a part's keys on (as differences, in
planes of bytes, which compress), so a frequent pair is one entry, and no key is hot.
Each part is sorted, written as arrays of keys and counts, and unpacked again for the
statistics of its contexts and continuations, which meet in blocks of token numbers.

Scoring maps the arrays; a worker holds no copy. With D1, D2, D3+ from the counts of
counts of each order,

    p(w | v) = (c(v w) - D) / c(v) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v) * q(w)
    q(w)     = (k(w) - E) / K + (E1 k1 + E2 k2 + E3 k3) / K / (V + 1)

where k(w) is the number of different tokens before w and K their sum. A text begins
with a mark that is context only. Unknown words share the (V + 1)th part of the last
term. An unknown context leaves q(w). For every context the chances of the V tokens and
of the unknown word sum to 1.

Null texts count as empty and have one token, the end. Without training texts V and N
are 0 and every token has the chance 1. Repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm import words as W
from panelspark.session import materialise, scratch_path

U64 = np.uint64
END_HASH = U64(0x0123456789ABCDEF)
#: The largest number of 32 bits stands for a count in the list of large ones.
MOST = 2**32 - 1
#: Tokens a task adds up before it sends counts on; entries of a part of the arrays; numbers of a block of statistics.
GATHER, PART, BLOCK = 1_000_000, 1_000_000, 1 << 18


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``words.mix``."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest needs, behind one byte that tells how many."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    return out.view("<u8").reshape(-1).astype(U64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=U64)


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def bits_for(entries: int, part: int = PART) -> int:
    return max(0, int(np.ceil(np.log2(max(1, entries) / part))))


def add_up(keys: Sequence[np.ndarray], counts: Sequence[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (of their occurrences)."""
    every = np.concatenate(keys) if keys else np.zeros(0, U64)
    if counts is None:
        return np.unique(every, return_counts=True)
    order = np.argsort(every)
    every, times = every[order], np.concatenate(counts)[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(times, first) if len(first) else times


def with_ends(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end behind each text, and the place of each text's first token."""
    n = len(found.first) - 1
    first = found.first + np.arange(n + 1)
    out = np.empty(len(found.hashes) + n, U64)
    end = np.zeros(len(out), bool)
    end[first[1:] - 1] = True
    out[end] = END_HASH
    out[~end] = found.hashes
    return out, first


def _in_parts(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row (part, keys, counts) for each part that has some of the sorted keys."""
    part = part_of(keys, bits)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(part))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[first], pa.int64()),
            pa.array([pack(keys[a:b]) for a, b in zip(first, last)], pa.binary()),
            pa.array([planes(counts[a:b]) for a, b in zip(first, last)], pa.binary()),
        ],
        ["part", "keys", "counts"],
    )


PARTS = "part long, keys binary, counts binary"


def _gather(texts: DataFrame, number, bits: int) -> DataFrame:
    """Counts of the keys that ``number()`` makes of the words of a slice, in parts."""

    def run(batches):
        keys_of = number()
        held, n = [], 0
        for batch in batches:
            for _, _, raw, offsets in W.slices(batch["text"]):
                held.append(keys_of(W.split(raw, offsets)))
                n += len(held[-1])
                if n >= GATHER:
                    yield _in_parts(*add_up(held), bits)
                    held, n = [], 0
        if n:
            yield _in_parts(*add_up(held), bits)

    return texts.mapInArrow(W.tidy(run), PARTS)


def _by_part(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.repartition(max(1, n), column).sortWithinPartitions(column)


def _groups(batches):
    """(value, rows) for each run of rows with one value in the first column; rows come one at a time."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(column[i].as_py() for column in batch.columns)

    return groupby(rows(), key=itemgetter(0))


@dataclass(frozen=True)
class Trained:
    """What workers need to map the model: folder, sizes of the vocabulary's parts, bits of both tables, totals, discounts."""

    folder: str
    word_bits: int
    word_sizes: tuple[int, ...]
    pair_bits: int
    tokens: int
    pairs: int
    discounts: tuple[tuple[float, ...], tuple[float, ...]]
    low_rest: float
    most: int = MOST

    @property
    def vocabulary(self) -> int:
        return sum(self.word_sizes)


class Numbers:
    """Tokens to numbers by the mapped vocabulary; the mark before a text is number V, an unknown word V + 1."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...]):
        self.bits, self.total = bits, sum(sizes)
        self.base = np.append(0, np.cumsum(sizes))
        self.keys = [arrays.load(folder, f"words-{p}", U64) if n else np.zeros(0, U64) for p, n in enumerate(sizes)]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), self.total + 1, np.int64)
        part = part_of(distinct, self.bits)
        bounds = np.searchsorted(part, np.arange(len(self.keys) + 1))
        for p, keys in enumerate(self.keys):
            a, b = bounds[p], bounds[p + 1]
            if a < b:
                at = arrays.find(keys, distinct[a:b])
                out[a:b] = np.where(at >= 0, at + self.base[p], self.total + 1)
        return out[back.reshape(-1)]


def pairs_of(numbers: np.ndarray, first: np.ndarray, mark: int) -> np.ndarray:
    """The packed pair of each token and the one before it."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[first[:-1]] = mark
    return before.astype(U64) << U64(32) | numbers.astype(U64)


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2 and D3+ of the counts of counts n[1] to n[4]; between 0 and the count where they don't say."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return float(np.clip(d1, 0.05, 0.95)), float(np.clip(d2, 0.05, 1.95)), float(np.clip(d3, 0.05, 2.95))


def train(texts: DataFrame, text_col: str = "text", most: int = MOST) -> Trained:
    """Counts the model of ``texts`` and writes its arrays to the shared folder.

    Counts of pairs have 32 bits; those of ``most`` and more are listed beside them in 64.
    """
    spark = texts.sparkSession
    folder = scratch_path(spark, "ngrams")
    source = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text") + 2), F.lit(0))).first()[0]
    # a guess of one new token for 32 bytes; it only sets how many parts the vocabulary has
    word_bits = bits_for(size // 32)

    # first pass: the vocabulary
    gathered = _gather(source, lambda: lambda found: with_ends(found)[0], word_bits)

    def store_words(batches):
        for part, rows in _groups(batches):
            keys, counts = add_up(*zip(*((unpack(r[1]), from_planes(r[2])) for r in rows)))
            arrays.save(folder, f"words-{part}", keys)
            arrays.save(folder, f"word-counts-{part}", counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["part", "n", "tokens"])

    parts = _by_part(gathered, "part", 1 << word_bits).mapInArrow(W.tidy(store_words), "part long, n long, tokens long").collect()
    word_sizes = [0] * (1 << word_bits)
    for r in parts:
        word_sizes[r["part"]] = r["n"]
    tokens, vocabulary = sum(r["tokens"] for r in parts), sum(word_sizes)
    sizes = tuple(word_sizes)
    if vocabulary >= (1 << 32) - 2:
        raise ValueError("more than 2^32 different tokens")

    # second pass: pairs
    pair_bits = bits_for(tokens)

    def numbered():
        numbers = Numbers(folder, word_bits, sizes)

        def keys_of(found: W.Words) -> np.ndarray:
            hashes, first = with_ends(found)
            return W.mix(pairs_of(numbers.of(hashes), first, numbers.total))

        return keys_of

    def store_pairs(batches):
        for part, rows in _groups(batches):
            keys, counts = add_up(*zip(*((unpack(r[1]), from_planes(r[2])) for r in rows)))
            arrays.save(folder, f"pairs-{part}", keys)
            arrays.save(folder, f"pair-counts-{part}", np.minimum(counts, most).astype(np.uint32))
            large = np.flatnonzero(counts >= most)
            if len(large):
                arrays.save(folder, f"pair-large-{part}", np.stack([large, counts[large]], 1).astype(np.int64))
            packed = unmix(keys)
            of_counts = np.bincount(np.minimum(counts, 5), minlength=6)
            for side, ids in (("v", packed >> U64(32)), ("w", packed & U64(0xFFFFFFFF))):
                # statistics by token: occurrences, then those with a count of 1, 2, and 3 or more
                order = np.argsort(ids, kind="stable")
                ids, times = ids[order], counts[order]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                sums = [np.add.reduceat(x, first) for x in (times, times == 1, times == 2, times >= 3)] if side == "v" else [np.diff(np.append(first, len(ids)))]
                ids = ids[first]
                cut = np.append(np.flatnonzero(np.append(True, (ids[1:] // BLOCK) != (ids[:-1] // BLOCK))), len(ids))
                for a, b in zip(cut, cut[1:]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(ids[a] // BLOCK)]),
                            pa.array([side]),
                            pa.array([pack(ids[a:b])], pa.binary()),
                            pa.array([[planes(s[a:b]) for s in sums]], pa.list_(pa.binary())),
                            pa.array([of_counts.tolist()], pa.list_(pa.int64())),
                        ],
                        ["block", "side", "ids", "sums", "n"],
                    )
                of_counts = np.zeros(6, np.int64)

    schema = "block long, side string, ids binary, sums array<binary>, n array<long>"
    gathered = _gather(source, numbered, pair_bits)
    statistics = materialise(_by_part(gathered, "part", 1 << pair_bits).mapInArrow(W.tidy(store_pairs), schema), "statistics")
    blocks = (vocabulary + 2) // BLOCK + 1

    def store_blocks(batches):
        for block, rows in _groups(batches):
            found = np.zeros((5, BLOCK), np.int64)
            for _, side, ids, sums in rows:
                at = (unpack(ids) - U64(block * BLOCK)).astype(np.int64)
                for k, values in enumerate(sums, 0 if side == "v" else 4):
                    found[k, at] += from_planes(values).astype(np.int64)
            arrays.save(folder, f"tokens-{block}", found.T.astype(np.int64))
            of_counts = np.bincount(np.minimum(found[4], 5), minlength=6)
            of_counts[0] = 0
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([of_counts.tolist()], pa.list_(pa.int64()))], ["block", "k"])

    kept = _by_part(statistics.select("block", "side", "ids", "sums"), "block", blocks).mapInArrow(W.tidy(store_blocks), "block long, k array<long>").collect()
    first_of_part = statistics.select(F.posexplode("n").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    n, k = np.zeros(6), np.zeros(6)
    for r in first_of_part:
        n[r["i"]] = r["x"]
    for r in kept:
        k += np.array(r["k"], float)
    pairs = int(n[1:].sum())
    d, e = discounts(n), discounts(k)
    rest = (e[0] * k[1] + e[1] * k[2] + e[2] * k[3:].sum()) / pairs if pairs else 1.0
    return Trained(folder, word_bits, sizes, pair_bits, tokens, pairs, ((0.0, *d), (0.0, *e)), rest, most)


class Model:
    """The mapped arrays of a trained model."""

    def __init__(self, t: Trained):
        self.t, self.numbers = t, Numbers(t.folder, t.word_bits, t.word_sizes)
        v = t.vocabulary
        self.counts = [arrays.load(t.folder, f"word-counts-{p}", np.int64) if n else np.zeros(0, np.int64) for p, n in enumerate(t.word_sizes)]
        self.pairs = [self._pair(p, "pairs", U64) for p in range(1 << t.pair_bits)]
        self.pair_counts = [self._pair(p, "pair-counts", np.uint32) for p in range(1 << t.pair_bits)]
        self.large: dict[int, np.ndarray] = {}
        self.blocks = [self._block(b) for b in range((v + 2) // BLOCK + 1)]
        self.d, self.e = (np.array(x) for x in t.discounts)

    def _pair(self, part: int, name: str, dtype) -> np.ndarray:
        try:
            return arrays.load(self.t.folder, f"{name}-{part}", dtype)
        except FileNotFoundError:  # no pair fell into this part
            return np.zeros(0, dtype)

    def _block(self, block: int) -> np.ndarray:
        try:
            return arrays.load(self.t.folder, f"tokens-{block}", np.int64).reshape(-1, 5)
        except FileNotFoundError:
            return np.zeros((BLOCK, 5), np.int64)

    def _gather(self, tables: list[np.ndarray], size, at: np.ndarray, shape: tuple = ()) -> np.ndarray:
        out = np.zeros((len(at), *shape), np.int64)
        which = np.searchsorted(size, at, side="right") - 1
        for p in np.unique(which).tolist():
            own = which == p
            out[own] = tables[p][at[own] - size[p]]
        return out

    def pair_count(self, packed: np.ndarray) -> np.ndarray:
        keys = W.mix(packed)
        order = np.argsort(keys)
        ordered = keys[order]
        bounds = np.searchsorted(part_of(ordered, self.t.pair_bits), np.arange(len(self.pairs) + 1))
        found = np.zeros(len(keys), np.int64)
        for p, (table, counts) in enumerate(zip(self.pairs, self.pair_counts)):
            a, b = bounds[p], bounds[p + 1]
            if a < b and len(table):
                at = arrays.find(table, ordered[a:b])
                found[a:b] = np.where(at >= 0, counts[np.maximum(at, 0)], 0)
                large = np.flatnonzero(found[a:b] == self.t.most)
                if len(large):
                    if p not in self.large:
                        self.large[p] = arrays.load(self.t.folder, f"pair-large-{p}", np.int64).reshape(-1, 2)
                    place, count = self.large[p].T
                    found[a + large] = count[np.searchsorted(place, at[large])]
        out = np.empty_like(found)
        out[order] = found
        return out

    def logs(self, found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 p of each token, log10 of its base chance, whether it is known, and the first token of each text."""
        hashes, first = with_ends(found)
        numbers = self.numbers.of(hashes)
        v = self.t.vocabulary
        known = numbers < v
        count = np.zeros(len(numbers), np.int64)
        count[known] = self._gather(self.counts, np.append(0, np.cumsum(self.t.word_sizes))[:-1], numbers[known])
        base = np.log10((count + 1) / (self.t.tokens + v + 1))
        packed = pairs_of(numbers, first, v)
        before = (packed >> U64(32)).astype(np.int64)
        starts = np.arange(len(self.blocks)) * BLOCK
        of_context = self._gather(self.blocks, starts, before, (5,))
        k = self._gather(self.blocks, starts, numbers, (5,))[:, 4]
        if self.t.pairs:
            q = np.maximum(k - self.e[np.minimum(k, 3)], 0) / self.t.pairs + self.t.low_rest / (v + 1)
        else:
            q = np.ones(len(numbers))
        c, total = self.pair_count(packed), of_context[:, 0]
        rest = of_context[:, 1:4] @ self.d[1:]
        some = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(c - self.d[np.minimum(c, 3)], 0) / some + rest / some * q, q)
        return np.log10(p), base, known, first


def score(df: DataFrame, trained: Trained, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, n_known, base_score and score of its texts; columns of these names are replaced.

    10 ** (-score / n_tokens) is the perplexity.
    """
    made = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in df.columns if c not in made]
    held_text = W.fresh(df.columns)
    source = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(held_text))

    def run(batches):
        model = Model(trained)
        for batch in batches:
            rest = batch.drop_columns([held_text])
            for a, b, raw, offsets in W.slices(batch[held_text]):
                logs, base, known, first = model.logs(W.split(raw, offsets))
                cols = [
                    pa.array(np.diff(first)),
                    pa.array(np.add.reduceat(known.astype(np.int64), first[:-1])),
                    pa.array(np.add.reduceat(base, first[:-1])),
                    pa.array(np.add.reduceat(logs, first[:-1])),
                ]
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *cols], [*rest.schema.names, *made])

    schema = source.drop(held_text).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    return source.mapInArrow(W.tidy(run), schema)

