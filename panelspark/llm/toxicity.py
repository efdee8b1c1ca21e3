"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

A model spells words (letters, digits and signs beyond ASCII; A-Z as lower case) byte
by byte to its end. It counts in how many texts of a class each beginning of a word
occurs. A word of more than ``WHOLE`` bytes, or with characters of three bytes and more,
as in scripts that set no spaces, has more pieces: one that begins at each of its
characters and overlaps those before. The first piece reaches ``WHOLE`` bytes, the others
``PIECE``; each counts as a word, so every byte is counted and scored, and an expression
is found wherever it stands in a run. The chance of the next byte after a beginning is the class's share,
interpolated with what both classes share: an absolutely discounted count of the same
beginning over all texts, which backs off to the number of beginnings that the last
``TAIL`` bytes continue (the Kneser-Ney continuation count), and that to one in 256.
So an expression that a class hardly knows is judged by its better known beginning,
and one that neither knows tells nothing.

The ratio of both likelihoods of a word, toxic over ordinary, is its weight. Whole texts
hold mostly words that say little, in numbers that drown the few that matter, so the
ratio is normalised over the strongest ``TOP`` different words: their mean weights,
one by one, go into a logistic curve fitted on the labelled texts, each with its own
words taken out of the counts. Texts without words have weights of 0.

Labels are taken from a sample: ``SAMPLE`` texts of each class are expected, picked by a
hash of the id. This bounds the model and the fit; counts of the classes are of all
labelled rows. Without texts of both classes every score is the share of toxic ones,
or 0. Null ids are never in the sample; ids with two labels count as toxic if one is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import arrays
from panelspark.llm import words as W
from panelspark.session import materialise, scratch_path

SAMPLE = 10_000
WHOLE, PIECE, TAIL, TOP = 48, 16, 3, 3
#: Words whose weights a task keeps.
KEPT = 200_000
#: The counts are kept in this many parts, as a power of 2.
PART_BITS = 4
PRIOR, DISCOUNT = 30.0, 0.75
U64 = np.uint64
END = 0x00


class Spelling:
    """The beginnings of distinct pieces, one piece behind another.

    ``key[first[w] + k]`` hashes the first k bytes of piece w. ``word``, ``at``, ``tail`` and ``tail_next`` are of
    each step from a beginning to the next: its piece, the place of its first key, the TAIL bytes before, and with the next.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, ended: np.ndarray):
        size = stop - start + ended
        n, total = len(size), int(size.sum())
        self.first = np.append(0, np.cumsum(size + 1))
        begin = np.cumsum(size) - size
        self.word = np.repeat(np.arange(n), size)
        place = np.arange(total) - begin[self.word]
        self.at = self.first[self.word] + place
        pos = start[self.word] + place
        byte = np.where(pos < stop[self.word], data[np.minimum(pos, len(data) - 1)], END).astype(U64)
        self.key = np.full(total + n, U64(0x51ED270B3A1F4C55))
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        at = self.key[: len(order)]
        for k in range(int(size.max()) if n else 0):
            # the longest come first; those that have ended drop out
            some = order[: np.searchsorted(falling, -k)]
            at = W.mix(at[: len(some)] * U64(0x9E3779B97F4A7C15) + byte[begin[some] + k] + U64(1))
            self.key[self.first[some] + k + 1] = at
        tail = np.zeros(total, U64)
        for back in range(TAIL, 0, -1):
            before = np.where(place >= back, byte[np.maximum(np.arange(total) - back, 0)], U64(1)) if total else byte
            tail = tail * U64(257) + before + U64(1)
        self.tail = W.mix(tail)
        self.tail_next = W.mix(tail * U64(257) + byte + U64(1) + (U64(1) << U64(60)))


def hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """A hash of each piece; a whole word's is that of words."""
    total, size = np.zeros(len(start), U64), stop - start
    up, _ = W.powers(W.PIECE)
    for k in range(int(size.max()) if len(size) else 0):
        total += np.where(k < size, W.BYTE_NUMBERS[data[np.minimum(start + k, len(data) - 1)]] * up[k], U64(0))
    total = W.mix(total)
    return np.where(ended, total, W.mix(total + U64(1)))


def pieces(found: W.Words) -> tuple[np.ndarray, ...]:
    """(text, start, stop, whether the end is spelled, hash) of the pieces of all words."""
    data, start, end = found.data, found.start, found.end
    doc = np.repeat(np.arange(len(found.first) - 1), found.counts())
    stop, ended = np.minimum(end, start + WHOLE), end - start < WHOLE
    hashes = found.hashes
    wide = np.append(0, np.cumsum(data >= 0xE0))
    cut = np.flatnonzero(~ended | (wide[end] > wide[start]))
    if not len(cut):
        return doc, start, stop, ended, hashes
    long = np.flatnonzero(~ended)
    hashes = hashes.copy()
    hashes[long] = hashed(data, start[long], stop[long], ended[long])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[cut] + 1] += 1
    inside[end[cut]] -= 1
    more = np.flatnonzero((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80))
    word = np.searchsorted(start, more, side="right") - 1
    more_stop = np.minimum(end[word], more + PIECE)
    more_ended = end[word] - more < PIECE
    more_hashes = np.concatenate([hashed(data, more[i], more_stop[i], more_ended[i]) for i in np.array_split(np.arange(len(more)), len(more) // 65536 + 1)])
    return (
        np.append(doc, doc[word]),
        np.append(start, more),
        np.append(stop, more_stop),
        np.append(ended, more_ended),
        np.append(hashes, more_hashes),
    )


def distinct_words(found: W.Words) -> tuple[np.ndarray, ...]:
    """(text, word) pairs without repeats; span, whether the end is spelled, and hash of each distinct word or piece."""
    doc, start, stop, ended, hashes = pieces(found)
    hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    pair = np.unique(doc * max(1, len(hashes)) + back.reshape(-1))
    doc, word = np.divmod(pair, max(1, len(hashes)))
    return doc, word, start[first], stop[first], ended[first], hashes


class Model:
    """Maps the counted beginnings and tails; gives the weight of every word."""

    def __init__(self, folder: str):
        self.tables = {
            name: [(arrays.load(folder, f"{name}-{p}", U64), arrays.load(folder, f"{name}-counts-{p}", np.uint32).reshape(-1, width)) for p in range(1 << PART_BITS)]
            for name, width in (("keys", 3), ("tails", 2))
        }

    def counts(self, name: str, keys: np.ndarray) -> np.ndarray:
        """The counts of each key, zeros where it is unknown."""
        flat = keys.reshape(-1)
        part = flat >> U64(64 - PART_BITS)
        out = np.zeros((len(flat), self.tables[name][0][1].shape[1]))
        for p, (known, counts) in enumerate(self.tables[name]):
            own = np.flatnonzero(part == p)
            at = arrays.find(known, flat[own])
            hit = at >= 0
            out[own[hit]] = counts[at[hit]]
        return out.reshape(*keys.shape, -1)

    def weights(self, spelled: Spelling, own: np.ndarray | None = None, label: int = 0) -> np.ndarray:
        """log of toxic over ordinary likelihood of each word.

        ``own`` takes out what one text of class ``label`` added to the counts of each beginning.
        """
        n = len(spelled.first) - 1
        if n == 0:
            return np.zeros(0)
        counts = self.counts("keys", spelled.key)
        if own is not None:
            counts[:, label] = np.maximum(counts[:, label] - own, 0)
        before, after = counts[spelled.at], counts[spelled.at + 1]
        total, kinds = self.counts("tails", spelled.tail).T
        times = self.counts("tails", spelled.tail_next)[:, 0]
        low = np.where(total > 0, (np.maximum(times - DISCOUNT, 0) + DISCOUNT * kinds / 256) / np.maximum(total, 1), 1 / 256)
        all_before, all_after = before[:, :2].sum(1), after[:, :2].sum(1)
        shared = (np.maximum(all_after - DISCOUNT, 0) + DISCOUNT * np.maximum(before[:, 2], 1) * low) / np.maximum(all_before, DISCOUNT)
        shared = np.where(all_before > 0, np.maximum(shared, 1e-12), low)
        chance = (after[:, :2] + PRIOR * shared[:, None]) / (before[:, :2] + PRIOR)
        return np.bincount(spelled.word, np.log(chance[:, 1]) - np.log(chance[:, 0]), n)


class Kept:
    """Weights of the words a task has met, by hash; emptied when there are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.old = self.new = (np.zeros(0, U64), np.zeros(0))

    def weights(self, found: W.Words, start: np.ndarray, stop: np.ndarray, ended: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(hashes)), np.ones(len(hashes), bool)
        for keys, values in (self.old, self.new):
            at = arrays.find(keys, hashes)
            hit = at >= 0
            out[hit], open_[hit] = values[at[hit]], False
        todo = np.flatnonzero(open_)
        if len(todo):
            made = [self.model.weights(Spelling(found.data, start[i], stop[i], ended[i])) for i in np.array_split(todo, -(-len(todo) // 4096))]
            out[todo] = np.concatenate(made)
            self.new = self._joined(self.new, (hashes[todo], out[todo]))
            if 4 * len(self.new[0]) > len(self.old[0]):
                full = len(self.old[0]) > KEPT
                self.old = self.new if full else self._joined(self.old, self.new)
                self.new = (np.zeros(0, U64), np.zeros(0))
        return out

    @staticmethod
    def _joined(a, b):
        keys, values = np.append(a[0], b[0]), np.append(a[1], b[1])
        order = np.argsort(keys)
        return keys[order], values[order]


def strongest(doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The TOP largest weights of each of n texts, the largest first; 0 where there are fewer words."""
    out = np.zeros((n, TOP))
    order = np.lexsort((-weight, doc))
    doc, weight = doc[order], weight[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    some = place < TOP
    out[doc[some], place[some]] = weight[some]
    return out


def features(weights: np.ndarray) -> np.ndarray:
    """Length-normalised ratios: the means of the strongest 1, 2 ... TOP words."""
    return np.cumsum(weights, 1) / np.arange(1, TOP + 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _beginnings(sample: DataFrame) -> DataFrame:
    """(kind, key, c0, c1): texts of each class with a beginning, added up within each batch before the shuffle."""

    def run(batches):
        for batch in batches:
            label = np.asarray(batch["label"])
            for a, b, raw, offsets in W.slices(batch["text"]):
                found = W.split(raw, offsets, W.ALNUM)
                doc, word, start, stop, ended, _ = distinct_words(found)
                spelled = Spelling(found.data, start, stop, ended)
                times = np.stack([np.bincount(word[label[a:b][doc] == y], minlength=len(start)) for y in (0, 1)])
                keys, back = np.unique(spelled.key, return_inverse=True)
                w = np.repeat(np.arange(len(start)), np.diff(spelled.first))
                c = [np.bincount(back.reshape(-1), t[w], len(keys)).astype(np.int64) for t in times]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c[0]), pa.array(c[1])], ["key", "c0", "c1"])

    added = sample.mapInArrow(W.tidy(run), "key long, c0 long, c1 long")
    return added.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _steps(sample: DataFrame) -> DataFrame:
    """Distinct (key before, key after, tail, tail and next byte) of all words of the sample."""

    def run(batches):
        for batch in batches:
            for _, _, raw, offsets in W.slices(batch["text"]):
                found = W.split(raw, offsets, W.ALNUM)
                _, _, start, stop, ended, _ = distinct_words(found)
                s = Spelling(found.data, start, stop, ended)
                rows = np.unique(np.stack([s.key[s.at], s.key[s.at + 1], s.tail, s.tail_next], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in np.ascontiguousarray(rows.T)], ["before", "after", "tail", "next"])

    return sample.mapInArrow(W.tidy(run), "before long, after long, tail long, next long").distinct()


def _store(df: DataFrame, folder: str, name: str) -> None:
    """Writes a table of (key, values...) as arrays sorted by key, as unsigned numbers, in parts by the top bits."""
    cols = df.columns[1:]

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            table = np.stack([np.asarray(column) for column in batch.columns[1:]], 1)
            part = np.asarray(batch["_part"])
            for p in np.unique(part).tolist():
                found.setdefault(p, []).append(table[part == p])
        for p, tables in found.items():
            table = np.concatenate(tables)
            keys = table[:, 0].view(U64) if table.flags["F_CONTIGUOUS"] else np.ascontiguousarray(table[:, 0]).view(U64)
            by = np.argsort(keys)
            arrays.save(folder, f"{name}-{p}", keys[by])
            arrays.save(folder, f"{name}-counts-{p}", table[by, 1:].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64())], ["part"])

    part = F.shiftrightunsigned("key", 64 - PART_BITS).alias("_part")
    parted = df.select(part, "key", *cols).repartition(1 << PART_BITS, "_part")
    written = {r["part"] for r in parted.mapInArrow(W.tidy(run), "part long").collect()}
    for p in set(range(1 << PART_BITS)) - written:
        arrays.save(folder, f"{name}-{p}", np.zeros(0, U64))
        arrays.save(folder, f"{name}-counts-{p}", np.zeros(0, np.uint32))


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> tuple[str, list[float]]:
    """Fits on labelled ``docs`` (doc_id, text) that aren't held out; the folder of the model and the curve."""
    spark = docs.sparkSession
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if held_out is not None:
        marked = marked.where(~held_out)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    folder = scratch_path(spark, "toxicity")
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        nothing = spark.createDataFrame([], "key long, a long, b long, c long")
        _store(nothing, folder, "keys")
        _store(nothing.drop("c"), folder, "tails")
        return folder, [0.0] * TOP + [float(np.log((share + 1e-9) / (1 - share + 1e-9)))]
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(2**53))
    picked = marked.where(draw < F.when(F.col("label") == 1, sample / n1).otherwise(sample / n0))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("label", "text")
    chosen = materialise(chosen, "toxicity-sample")
    counts, steps = _beginnings(chosen), materialise(_steps(chosen), "toxicity-steps")
    kinds = steps.groupBy("before").agg(F.count_distinct("after").alias("kinds"))
    _store(counts.join(kinds, counts["key"] == kinds["before"], "left").select("key", "c0", "c1", F.coalesce("kinds", F.lit(0)).alias("kinds")), folder, "keys")
    grams = steps.groupBy("tail", "next").agg(F.count_distinct("before").alias("n"))
    tails = grams.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).select(F.col("tail").alias("key"), "n", "kinds")
    follows = grams.groupBy("next").agg(F.sum("n").alias("n")).select(F.col("next").alias("key"), "n", F.lit(0).cast("long").alias("kinds"))
    _store(tails.union(follows), folder, "tails")

    def own(batches):
        model = Model(folder)
        for batch in batches:
            out, label = [], np.asarray(batch["label"])
            for i in range(batch.num_rows):
                found = W.split(*W.buffers(batch["text"].slice(i, 1)), W.ALNUM)
                _, _, start, stop, ended, _ = distinct_words(found)
                spelled = Spelling(found.data, start, stop, ended)
                _, back, times = np.unique(spelled.key, return_inverse=True, return_counts=True)
                weight = model.weights(spelled, times[back.reshape(-1)], int(label[i]))
                out.append(features(strongest(np.zeros(len(weight), np.int64), weight, 1))[0])
            cols = np.array(out).reshape(-1, TOP).T
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(c) for c in cols)], ["label", *(f"x{k}" for k in range(TOP))])

    rows = chosen.mapInArrow(W.tidy(own), "label int, " + ", ".join(f"x{k} double" for k in range(TOP))).toPandas()
    y = rows["label"].to_numpy(float)
    m1, m0 = y.sum(), len(y) - y.sum()
    if not m0 or not m1:
        return folder, [0.0] * TOP + [float(np.log(n1 / n0))]
    # as many of each class as there are in all
    weight = np.where(y == 1, n1 / m1, n0 / m0)
    weight *= len(y) / weight.sum()
    return folder, fit_logistic(rows[[f"x{k}" for k in range(TOP)]].to_numpy(float), y, weight).tolist()


def score(df: DataFrame, model: tuple[str, list[float]], text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of its texts; an existing column ``out`` is replaced. Null texts count as empty."""
    folder, curve = model
    kept = [c for c in df.columns if c != out]
    held_text = W.fresh(df.columns)
    source = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(held_text))

    def run(batches):
        kept_weights = Kept(Model(folder))
        beta = np.array(curve)
        for batch in batches:
            rest = batch.drop_columns([held_text])
            for a, b, raw, offsets in W.slices(batch[held_text]):
                found = W.split(raw, offsets, W.ALNUM)
                doc, word, start, stop, ended, hashes = distinct_words(found)
                weight = kept_weights.weights(found, start, stop, ended, hashes)
                x = features(strongest(doc, weight[word], b - a))
                p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, pa.array(p)], [*rest.schema.names, out])

    return source.mapInArrow(W.tidy(run), source.drop(held_text).schema.add(out, "double"))
