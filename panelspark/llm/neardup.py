"""Near-duplicates by SetSketch registers, verified on whole shingle sets.

A text's set is that of its shingles of ``size`` words, ``SHINGLE`` if not said (A-Z as lower case, words apart
by white space; a text with fewer words has its whole sequence as the only one, a text
without words has none). Texts with equal sets are one class, and all further work is
on one representative of each class.

Every register of a sketch holds the smallest of exponential draws of the shingles, cut
to powers of ``BASE``: the number of the power, between 0 and 65535. Registers of a
union are the larger ones of two sketches, so sketches can be merged, and two registers
are equal about as often as the sets overlap. Registers are put into ``BANDS`` bands of
``ROWS``; texts that agree on a band share a bucket. At the similarity of 0.85 a pair
shares no bucket in 7 of 100 million cases, at 0.8 in 15 of a million.

Buckets give candidates without all their pairs as rows. Each one first tests its
members against the smallest, and what is found is joined into components. In buckets
that still hold several components, blocks of bounded size are compared inside tasks,
and every pair of different components is tested there. A pair is dropped without a
look at the texts if the set sizes rule it out, or if the likelihood of both sketches
and both sizes puts their similarity five standard deviations below the bar.

Null ids link with nothing; their component is null and they are kept. Null texts have no words.
In ``dedup`` rows that repeat an id have to hold texts with equal sets; where ids repeat with different texts,
``keep_one`` takes every id and text as a document of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import words as W
from panelspark.llm.components import components
from panelspark.operators.ordering import cumulative_counts
from panelspark.session import materialise

SHINGLE = 3
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: -ln of a draw lies between these for 32-bit draws; 65535 powers of BASE cover it.
LOWEST, HIGHEST = -3.2, 23.2
LOG_BASE = (HIGHEST - LOWEST) / 65535
SLACK = 5.0
#: Rows and shingles of a block of a bucket's members.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000
U64 = np.uint64

_random = W.mix(np.arange(1, 2 * REGISTERS + 1, dtype=U64) * U64(0xD1342543DE82EF95))
FACTORS = (_random[:REGISTERS] >> U64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_random[REGISTERS:] >> U64(32)).astype(np.uint32)


def shingle_hashes(found: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in one array, and where those of each text begin."""
    counts, h = found.counts(), found.hashes
    n = len(counts)
    windows = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    total = int(windows.sum())
    doc = np.repeat(np.arange(n), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(found.first[:-1], windows)
    whole = np.full(total, size)
    short = (counts > 0) & (counts < size)
    if short.any():
        whole = np.where(short[doc], counts[doc], size)
    out = W.mix(whole.astype(U64))
    for place in range(size):
        inside = place < whole
        word = h[np.minimum(at + place, max(0, len(h) - 1))] if len(h) else np.zeros(0, U64)
        out = np.where(inside, W.mix(out * U64(0x9E3779B97F4A7C15) + word), out)
    bits = U64(max(1, int(n).bit_length()))
    order = np.argsort((doc.astype(U64) << (U64(64) - bits)) | (out >> bits))
    doc, out = doc[order], out[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out = out[fresh]
    sizes = np.bincount(doc[fresh], minlength=n)
    return out, np.append(0, np.cumsum(sizes))


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The register values of each set, a row each; sets must not be empty."""
    low = (W.mix(hashes) >> U64(32)).astype(np.uint32)
    buffer = np.empty_like(low)
    least = np.empty((REGISTERS, len(first) - 1), np.uint32)
    for i in range(REGISTERS):
        np.multiply(low, FACTORS[i], out=buffer)
        np.add(buffer, SHIFTS[i], out=buffer)
        np.minimum.reduceat(buffer, first[:-1], out=least[i])
    draw = -np.log1p(-(least.T + 0.5) / 2.0**32)
    return np.clip((-np.log(draw) - LOWEST) / LOG_BASE, 0, 65535).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """The bucket of each band, a row for each sketch."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(W.mix(np.arange(1, BANDS + 1, dtype=U64)), parts.shape[:2])
    for i in range(ROWS):
        key = W.mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64) if key.flags["C_CONTIGUOUS"] else np.ascontiguousarray(key).view(np.int64)


def likely_similarity(one: np.ndarray, two: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The similarity that makes the registers of two sets of known sizes likeliest (golden-section search)."""
    above, below = (one > two).sum(1), (one < two).sum(1)
    equal = one.shape[1] - above - below
    u = n1 / (n1 + n2)
    v = 1.0 - u
    step = np.expm1(LOG_BASE)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * step / (1 + step)) / LOG_BASE

    def loss(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return -(above * np.log(up + tiny) + below * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny))

    low, high = np.zeros(len(u)), np.minimum(n1, n2) / np.maximum(n1, n2)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = loss(a) < loss(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def signatures(df: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, k1, k2, sketch) of every row, of shingles of ``size`` words: the set's size, a 128-bit hash of it and its registers (null if empty)."""
    source = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in W.slices(batch["text"]):
                hashes, first = shingle_hashes(W.split(raw, offsets), size)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                starts = first[:-1][full]
                keys = np.zeros((2, b - a), U64)
                sketch = np.full(b - a, None, object)
                if len(full):
                    for i in range(2):
                        keys[i, full] = np.add.reduceat(W.mix(hashes ^ U64(0x5851F42D4C957F2D * (i + 1) & (2**64 - 1))), starts)
                    for place, row in zip(full.tolist(), registers(hashes, np.append(starts, len(hashes)))):
                        sketch[place] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"].slice(a, b - a), pa.array(sizes, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), pa.array(sketch, pa.binary())],
                    ["doc", "n", "k1", "k2", "sketch"],
                )

    return source.mapInArrow(W.tidy(run), "doc long, n long, k1 long, k2 long, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, doc) for every band of every class."""

    def run(batches):
        for batch in batches:
            keys = band_keys(_sketches(batch["sketch"]))
            docs = np.repeat(np.asarray(batch["doc"]), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(docs)], ["bucket", "doc"])

    return classes.select("doc", "sketch").mapInArrow(W.tidy(run), "bucket long, doc long")


def likely(pairs: DataFrame, bar: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible; brings n1, n2, s1, s2 in and takes them away."""
    deviation = (bar / 100 * (1 - bar / 100) / REGISTERS) ** 0.5
    least = bar / 100 - SLACK * deviation

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            one, two = _sketches(batch["s1"]), _sketches(batch["s2"])
            j = likely_similarity(one, two, np.asarray(batch["n1"], float), np.asarray(batch["n2"], float))
            yield batch.filter(pa.array(j >= least)).select(["a", "b"])

    possible = pairs.where(F.lit(100) * F.least("n1", "n2") >= F.lit(bar) * F.greatest("n1", "n2"))
    return possible.select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(W.tidy(run), "a long, b long")


def linked(pairs: DataFrame, bar: int, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b, t1, t2) whose whole sets overlap enough."""

    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            keep = []
            for b, t1, t2 in zip(batch["b"].to_pylist(), batch["t1"].to_pylist(), batch["t2"].to_pylist()):
                if known[0] != b:
                    known = (b, shingle_hashes(W.of_texts([t2]), size)[0])
                mine, other = shingle_hashes(W.of_texts([t1]), size)[0], known[1]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= bar * (len(mine) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "t1", "t2").mapInArrow(W.tidy(run), "a long, b long")


def _with_ends(pairs: DataFrame, members: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Brings columns of ``members`` to both ends of the pairs, as col1 and col2."""
    for end, number in (("a", 1), ("b", 2)):
        side = members.select(F.col("doc").alias("_end"), *[F.col(c).alias(f"{short}{number}") for c, short in cols.items()])
        pairs = pairs.join(side, pairs[end] == side["_end"]).drop("_end")
    return pairs


def link_classes(classes: DataFrame, texts: DataFrame, bar: int, size: int = SHINGLE) -> DataFrame:
    """(node, component) of the classes (doc, n, sketch) that are linked to a smaller one; ``texts`` holds (doc, text)."""
    rows = materialise(buckets(classes), "buckets")
    shared = rows.groupBy("bucket").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("many")).where("many > 1")
    members = materialise(rows.join(shared.select("bucket", "low"), "bucket").select("bucket", "doc", "low"), "members")
    inside = members.select("doc").distinct()
    held = materialise(classes.join(inside, "doc", "left_semi").select("doc", "n", "sketch"), "sketches")
    pages = materialise(texts.join(inside, "doc", "left_semi"), "texts")

    def test(pairs: DataFrame) -> DataFrame:
        hopeful = materialise(likely(_with_ends(pairs, held, {"n": "n", "sketch": "s"}), bar), "pairs")
        return linked(_with_ends(hopeful, pages, {"text": "t"}), bar, size)

    star = members.where("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct()
    links = materialise(test(star), "links")
    labels = materialise(components(links), "labels")
    more = settle(members.select("bucket", "doc"), labels, held.join(pages, "doc"), bar, size)
    return components(links.union(more))


def settle(members: DataFrame, labels: DataFrame, docs: DataFrame, bar: int, size: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket; all their pairs are tested.

    The members of a bucket, ordered by component, are cut into blocks of bounded rows
    and shingles. A task holds two blocks, or one with itself, and is left out if both
    hold the same component only. It compares sketches as matrices, whole sets where
    the sketches leave a chance, and gives no more links than join its members.
    """
    named = members.join(labels, members["doc"] == labels["node"], "left").select(
        "bucket", "doc", F.coalesce("component", "doc").alias("component")
    )
    split = named.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one <> two")
    left = named.join(split.select("bucket"), "bucket", "left_semi").join(docs.select("doc", "n"), "doc")
    over = Window.partitionBy("bucket").orderBy("component", "doc")
    place = F.floor((F.row_number().over(over) - 1) / BLOCK_ROWS) + F.floor(F.sum("n").over(over) / BLOCK_SHINGLES)
    left = materialise(left.withColumn("block", place), "blocks")
    blocks = left.groupBy("bucket", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = blocks.select("bucket", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    jobs = blocks.join(other, "bucket").where("block <= block2 AND NOT (low = high AND low2 = high2 AND low = low2)")
    jobs = jobs.select("bucket", F.col("block").alias("one"), F.col("block2").alias("two"))
    ends = jobs.select("bucket", F.col("one").alias("block"), "one", "two", F.lit(0).alias("side")).union(
        jobs.where("one < two").select("bucket", "two", "one", "two", F.lit(1))
    )
    rows = left.drop("n").join(ends, ["bucket", "block"]).select("bucket", "one", "two", "side", "doc", "component").join(docs, "doc")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = find_links(table, key[0].as_py(), bar, size)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("bucket", "one", "two").applyInArrow(run, "a long, b long").distinct()


def find_links(table: pa.Table, bucket: int, bar: int, size: int) -> list[tuple[int, int]]:
    """Links between the components of two blocks (side 0 and 1), or within one block, that join what isn't yet.

    A pair that shares the bucket of an earlier band as well is left to that bucket.
    """
    side = np.asarray(table["side"])
    docs, names = np.asarray(table["doc"]), np.asarray(table["component"])
    sizes, sketch = np.asarray(table["n"]), _sketches(table["sketch"].combine_chunks())
    least = bar / 100 - SLACK * (bar / 100 * (1 - bar / 100) / REGISTERS) ** 0.5
    keys = band_keys(sketch)
    earlier = keys[:, : int(np.flatnonzero(keys[0] == bucket)[0])]
    texts = table["text"].combine_chunks()
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_hashes(W.of_texts([texts[i].as_py()]), size)[0]
        return sets[i]

    _, label = np.unique(names, return_inverse=True)
    label = label.reshape(-1).copy()
    mine = np.flatnonzero(side == 0)
    theirs = np.flatnonzero(side == 1)
    if len(theirs) == 0:
        theirs = mine
    elif len(theirs) < len(mine):
        mine, theirs = theirs, mine
    found = []
    for i in mine.tolist():
        near = theirs[label[theirs] != label[i]]
        near = near[100 * np.minimum(sizes[near], sizes[i]) >= bar * np.maximum(sizes[near], sizes[i])]
        if len(near) and earlier.shape[1]:
            near = near[~(earlier[near] == earlier[i]).any(1)]
        if not len(near):
            continue
        # equal registers are at most a little rarer than the similarity; the likelihood decides closer
        same = (sketch[near] == sketch[i]).mean(1)
        near, same = near[same >= least - 0.02], same[same >= least - 0.02]
        if not len(near):
            continue
        j = likely_similarity(np.broadcast_to(sketch[i], (len(near), REGISTERS)), sketch[near], np.full(len(near), float(sizes[i])), sizes[near])
        for k in near[np.argsort(-j, kind="stable")][: int((j >= least).sum())].tolist():
            if label[k] == label[i]:
                continue
            both = len(np.intersect1d(shingles(i), shingles(k), assume_unique=True))
            if 100 * both >= bar * (len(shingles(i)) + len(shingles(k)) - both):
                found.append((int(docs[i]), int(docs[k])))
                label[label == label[k]] = label[i]
    return found


def dedup(df: DataFrame, bar: int = 85, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``df``.

    ``bar`` is the least similarity in hundredths, ``size`` the words of a shingle. ``component_id`` is the smallest id
    reachable by links, ``kept`` whether it is the document's own.
    """
    signed = materialise(signatures(df, size, id_col, text_col), "signatures")
    some = signed.where("doc IS NOT NULL AND n > 0")
    classes = some.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc", "sketch")).alias("one"))
    classes = materialise(classes.select("k1", "k2", "n", "one.doc", "one.sketch"), "classes")
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels = link_classes(classes.select("doc", "n", "sketch"), texts, bar, size)
    rep = classes.select("k1", "k2", "n", F.col("doc").alias("rep"))
    joined = signed.drop("sketch").join(rep, ["k1", "k2", "n"], "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    return joined.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def keep_one(df: DataFrame, bar: int = 85, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group of near-duplicates, the one with the smallest id; all columns.

    A document is an id with a text: rows that repeat both are one, and an id with several
    texts is as many documents, so a text without a copy stays whatever else has its id. Rows without an id stay.
    """
    key, node = W.fresh(df.columns, "_key"), W.fresh(df.columns, "_node")
    keyed = df.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    named = F.col(id_col).isNotNull()
    pairs = keyed.where(named).groupBy(id_col, key).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = materialise(pairs, "documents")
    if pairs.groupBy(id_col).count().where("count > 1").take(1):
        # numbers in the order of the ids stand for the documents
        struct = pairs.select(F.struct(id_col, key).alias("_pair"), F.lit(1).alias("_one"))
        numbered = cumulative_counts(struct, "_pair", "_one").select("_pair.*", F.col("cum").alias(node))
        rows = materialise(keyed.join(numbered, [id_col, key]).dropDuplicates([node]), "numbered")
        gone = dedup(rows.select(node, text_col), bar, size, node, text_col).where("NOT kept")
        left = rows.join(gone.select(F.col("doc_id").alias(node)), node, "left_anti").select(*df.columns)
        return left.unionByName(df.where(~named))
    found = materialise(dedup(df.select(id_col, text_col), bar, size, id_col, text_col), "near-duplicates")
    left = df.join(found.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti").select(*df.columns)
    again = pairs.where("_rows > 1").select(id_col)
    if not again.take(1):
        return left
    repeated = left.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(again, id_col, "left_anti").unionByName(repeated)
