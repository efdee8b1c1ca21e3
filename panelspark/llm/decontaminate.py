r"""Benchmark passages in training texts, found with an FM-index for each shard of texts.

Words are runs of letters, digits and all signs beyond ASCII, with A-Z as lower case.
The test phrases are the windows of ``WINDOW`` consecutive words of the items; an item
of fewer words is one phrase, an item without words none. Every task indexes the texts
it reads, in shards of bounded size: words that no phrase holds become separators, and
runs of words shorter than the shortest phrase are left out, as neither can be part of
an occurrence. All phrases are searched backwards through the wavelet matrix, occurrences
are located by sampled suffix positions, and the spans of a text are merged.

Items are taken in blocks of bounded bytes, each sent to the tasks once; a block adds
its finds to those before it in the same pass over the texts. Words are compared by
64-bit hashes.

Null texts have no words; repeated rows are searched each on its own; items with equal
ids count as one, and a null item id counts as an empty one. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from panelspark.llm import words as W
from panelspark.llm.fm_index import FMIndex

WINDOW = 10
#: Bytes of item texts in a block, and bytes of training texts and indexed words in a shard.
BLOCK_BYTES, SHARD_BYTES, SHARD_WORDS = 8 << 20, 32 << 20, 2_000_000


class Phrases:
    """The windows of a block of items: words by number, phrases of each length, the items of each phrase."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        found = W.of_texts(texts, W.ALNUM)
        self.vocabulary, numbers = np.unique(found.hashes, return_inverse=True)
        numbers = numbers.reshape(-1) + 1
        self.ids, owner = np.unique(np.array([i or "" for i in ids], dtype=object), return_inverse=True)
        owner = owner.reshape(-1)
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item in range(len(texts)):
            own = numbers[found.first[item] : found.first[item + 1]]
            size = min(window, len(own))
            if size:
                rows = np.lib.stride_tricks.sliding_window_view(own, size)
                parts.setdefault(size, []).append((rows, np.full(len(rows), owner[item])))
        self.by_size = []
        for size, found_rows in sorted(parts.items()):
            rows, owners = (np.concatenate(x) for x in zip(*found_rows))
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), owners], 1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
            self.by_size.append((size, rows, first, pairs[:, 1]))
        self.shortest = self.by_size[0][0] if self.by_size else 0

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 if no phrase holds it."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def runs(numbers: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Places of the words that stand in runs of at least ``least`` known words of one text, and -1 behind each run."""
    known = np.zeros(len(numbers) + 2, np.int8)
    known[1:-1] = numbers > 0
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a text's end cuts a run
    cuts = first[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(numbers))]
    cuts = np.unique(cuts[(known[cuts] == 1) & (known[cuts + 1] == 1)]) if len(cuts) else cuts
    start, end = np.sort(np.append(start, cuts)), np.sort(np.append(end, cuts))
    long = end - start >= least
    start, size = start[long], (end - start)[long]
    if not len(start):
        return np.zeros(0, np.int64)
    out = np.repeat(start - np.append(0, np.cumsum(size + 1)[:-1]), size + 1) + np.arange(int((size + 1).sum()))
    out[np.cumsum(size + 1) - 1] = -1
    return out


class Shard:
    """Texts of one task: their words are added slice by slice, then searched at once."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.counts, self.symbols, self.places = [], [], []
        self.words = self.bytes = self.indexed = 0

    def add(self, found: W.Words) -> None:
        if self.phrases.by_size:
            numbers = self.phrases.number(found.hashes)
            at = runs(numbers, found.first, self.phrases.shortest)
            self.symbols.append(np.where(at >= 0, numbers[at], 0) if len(at) else at)
            self.places.append(np.where(at >= 0, at + self.words, -1))
            self.indexed += len(at)
        self.counts.append(found.counts())
        self.words += len(found.hashes)
        self.bytes += len(found.data)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.indexed >= SHARD_WORDS

    def find(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[list[str]]]:
        """Words of each text, its merged spans (first word, word behind the last) and the items found in it."""
        counts = np.concatenate(self.counts)
        bounds = np.append(0, np.cumsum(counts))
        n = len(counts)
        cover = np.zeros(self.words + 1, np.int64)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        if self.indexed:
            places = np.concatenate(self.places)
            index = FMIndex(np.concatenate(self.symbols), len(self.phrases.vocabulary))
            for size, rows, first, owners in self.phrases.by_size:
                low, high = index.search(rows)
                times = high - low
                which = np.repeat(np.arange(len(rows)), times)
                ends = np.cumsum(times)
                at = np.arange(int(times.sum())) - np.repeat(ends - times, times) + np.repeat(low, times)
                start = places[index.locate(at)]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
                doc = np.searchsorted(bounds, start, side="right") - 1
                pair = np.unique(doc * len(rows) + which)
                doc, which = np.divmod(pair, len(rows))
                many = (first[1:] - first[:-1])[which]
                owner = owners[np.repeat(first[which], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
                hits.append((np.repeat(doc, many), owner))
        spans = [(np.zeros(0, np.int64),) * 2] * n
        items: list[list[str]] = [[] for _ in range(n)]
        if hits:
            inside = np.append(0, (np.cumsum(cover) > 0).view(np.int8))
            inside = np.append(inside, 0)
            # a text's end cuts a span
            edge = np.diff(inside)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cuts = np.unique(bounds[1:-1])
            cuts = cuts[(cuts > 0) & (cuts < self.words)]
            cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            start, end = np.sort(np.append(start, cuts)), np.sort(np.append(end, cuts))
            doc = np.searchsorted(bounds, start, side="right") - 1
            for d in np.unique(doc).tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                spans[d] = (start[a:b] - bounds[d], end[a:b] - bounds[d])
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*hits)], 1), axis=0)
            for d, owner in pairs.tolist():
                items[d].append(str(self.phrases.ids[owner]))
        return counts, spans, items


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _merge(old: list[dict], start: np.ndarray, end: np.ndarray) -> list[dict]:
    both = sorted([(s["start"], s["end"]) for s in old] + list(zip(start.tolist(), end.tolist())))
    out: list[list[int]] = []
    for a, b in both:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _add_finds(df: DataFrame, phrases, held_text: str) -> DataFrame:
    """Adds the finds of one block of items (a broadcast variable) to the columns n_words, spans and items."""
    kinds = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string())}

    def flush(held, shard):
        counts, spans, items = shard.find()
        row = 0
        for batch in held:
            n = batch.num_rows
            mine = slice(row, row + n)
            old_spans, old_items = batch["spans"].to_pylist(), batch["items"].to_pylist()
            new = {
                "n_words": counts[mine],
                "spans": [_merge(o, *s) if len(s[0]) else o for o, s in zip(old_spans, spans[mine])],
                "items": [sorted({*o, *i}) if i else o for o, i in zip(old_items, items[mine])],
            }
            cols = [pa.array(new[c], kinds[c]) if c in kinds else batch[c] for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)
            row += n

    def run(batches):
        held, shard = [], Shard(phrases.value)
        for batch in batches:
            for a, b, raw, offsets in W.slices(batch[held_text]):
                held.append(batch.slice(a, b - a))
                shard.add(W.split(raw, offsets, W.ALNUM))
                if shard.full():
                    yield from flush(held, shard)
                    held, shard = [], Shard(phrases.value)
        if held:
            yield from flush(held, shard)

    return df.mapInArrow(W.tidy(run), df.schema)


def item_blocks(benchmark: DataFrame, window: int = WINDOW) -> list:
    """The items as broadcast phrases, each block of at most BLOCK_BYTES of text or one item."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + 2 * total // BLOCK_BYTES
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        out.append(spark.sparkContext.broadcast(Phrases([r["id"] for r in rows], [r["text"] for r in rows], window)))
    return out


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with n_words, spans (merged, in words) and items (ids as sorted strings) of each row's text.

    Columns of these names in ``df`` are replaced.
    """
    held_text = W.fresh(df.columns)
    kept = [c for c in df.columns if c not in ("n_words", "spans", "items")]
    at = df.select(
        *kept,
        F.coalesce(F.col(text_col), F.lit("")).alias(held_text),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for phrases in item_blocks(benchmark, window):
        at = _add_finds(at, phrases, held_text)
    return at.drop(held_text)


def sha256_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _cut(found: W.Words, row: int, text: bytes, spans) -> bytes:
    """The text without the words of the spans and what stands between them."""
    a, base = found.first[row], found.base[row]
    out, at = [], 0
    for start, end in zip(*spans):
        out.append(text[at : found.start[a + start] - base])
        at = int(found.end[a + end - 1] - base)
    out.append(text[at:])
    return b"".join(out)


def remove(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, changed: str | None = None) -> DataFrame:
    """``df`` with every occurrence of a test phrase cut out of its texts; other rows and columns stay as they are.

    Words that a cut brings together are searched again until no occurrence is left.
    ``changed`` names a boolean column that marks the rows with cuts.
    """
    blocks = item_blocks(benchmark, window)
    source = df.drop(changed) if changed in df.columns else df

    def clean(texts: list[bytes]) -> list[bytes]:
        todo = list(range(len(texts)))
        while todo:
            hit: set[int] = set()
            for phrases in blocks:
                some = pa.array([texts[i] for i in todo], pa.binary()).cast(pa.string())
                shard, found = Shard(phrases.value), None
                for a, b, raw, offsets in W.slices(some):
                    shard.add(W.split(raw, offsets, W.ALNUM))
                _, spans, _ = shard.find()
                for k, i in enumerate(todo):
                    if len(spans[k][0]):
                        found = W.of_texts([texts[i].decode()], W.ALNUM)
                        texts[i] = _cut(found, 0, texts[i], spans[k])
                        hit.add(i)
            todo = sorted(hit)
        return texts

    def run(batches):
        for batch in batches:
            place = batch.schema.names.index(text_col)
            filled = pa.compute.fill_null(batch[text_col], "")
            for a, b, _, _ in W.slices(filled, SHARD_BYTES // 2):
                part = batch.slice(a, b - a)
                before = [None if t is None else t.encode() for t in part[text_col].to_pylist()]
                after = clean([t or b"" for t in before])
                cols = list(part.columns)
                cols[place] = pa.array([t if b is not None else None for t, b in zip(after, before)], pa.binary()).cast(part.schema.types[place])
                names = part.schema.names
                if changed is not None:
                    cols.append(pa.array([b is not None and t != b for t, b in zip(after, before)], pa.bool_()))
                    names = [*names, changed]
                yield pa.RecordBatch.from_arrays(cols, names)

    more = [StructField(changed, BooleanType())] if changed is not None else []
    return source.mapInArrow(W.tidy(run), StructType([*source.schema.fields, *more]))
