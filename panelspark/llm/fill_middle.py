"""Fill-in-middle: texts cut at two unit borders and written prefix, suffix, middle or suffix, prefix, middle.

A unit is a run of ASCII letters or any other single code point. Units are never listed.
The UTF-8 bytes of a text are viewed as 64-bit words of eight bytes each, and arithmetic
on whole words marks, in the top bit of each byte, the bytes that end a unit: those not
followed by a continuation byte, unless a letter follows a letter. ``bitwise_count`` of
the marks gives the units of a word. The border behind unit k is found by a binary
search in the running counts for its word, then among the word's eight marks: a
multiplication makes running counts of the marks inside the word, and the bytes whose
count stays below the rest of k are counted.

The draw is a function of the id: the first four 8-digit groups h1 to h4 of the hex
SHA-256 of ``seed``, a colon and the id. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text stays plain if it is
empty, holds a marker, or h3 % 100 >= ``rate``; of the others those with
h4 % 100 < ``spm`` begin with the suffix.

Null texts count as empty and a null id as an empty one; equal ids with equal texts
are cut alike. Long texts are whole; beyond its bytes a text needs twice as many for
marks and counts. Existing columns named like a result are replaced, all others stay. Nothing is
shuffled or broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import words as W

ONES = np.uint64(0x0101010101010101)
HIGH = ONES * np.uint64(0x80)
#: Words marked at a time, so that intermediate arrays stay small for texts of any length.
RUN = 1 << 16


@dataclass(frozen=True)
class Markers:
    """Signs in front of the parts. None may hold ``<`` or ``>`` inside: then no mixture of text and sign reads as a sign."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if len(set(self.all)) < 3 or not all(re.fullmatch("<[^<>]+>", m) for m in self.all):
            raise ValueError("markers are three different names in < and >")

    @property
    def all(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]


class Units:
    """The unit borders of a run of texts ``raw[at[i]:at[i + 1]]``."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        sizes = np.diff(at)
        # at least one zero byte behind each text: what follows a text's last byte is neither letter nor continuation
        self.first = np.append(0, np.cumsum(sizes // 8 + 1))
        data = np.zeros(8 * int(self.first[-1]), np.uint8)
        for to, a, b in zip((8 * self.first[:-1]).tolist(), at[:-1].tolist(), at[1:].tolist()):
            data[to : to + b - a] = raw[a:b]
        self.marks = unit_ends(data.view("<u8"))
        last = self.first[1:] - 1
        self.marks[last] &= (np.uint64(1) << (sizes % 8 * 8).astype(np.uint64)) - np.uint64(1)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.marks), dtype=np.int64))
        self.counts = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def border(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bytes of these texts up to the end of their k-th units; 0 for k = 0."""
        first = self.first[text]
        wanted = self.before[first] + k
        word = np.searchsorted(self.before, wanted) - 1
        rest = (wanted - self.before[word]).clip(1).astype(np.uint64)
        running = (self.marks[word] >> np.uint64(7)) * ONES
        reached = (running + (np.uint64(0x80) - rest) * ONES) & HIGH
        byte = 8 - np.bitwise_count(reached).astype(np.int64)
        return np.where(k > 0, (word - first) * 8 + byte + 1, 0)


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that ends a unit."""
    marks = np.empty_like(words)
    for a in range(0, len(words), RUN):
        w = words[a : a + RUN + 1]
        # 0x61 to 0x7A after folding, found by carries into the top bit; bytes with their own top bit are no letters
        low = (w | ONES * np.uint64(0x20)) & ~HIGH
        letter = (low + ONES * np.uint64(0x1F)) & ~(low + ONES * np.uint64(0x05)) & ~w & HIGH
        inside = w & ~(w << np.uint64(1)) & HIGH
        ends = HIGH & ~ahead(inside) & ~(letter & ahead(letter))
        marks[a : a + RUN] = ends[:RUN]
    return marks


def ahead(marks: np.ndarray) -> np.ndarray:
    """The marks of the following bytes: in little-endian words these are the higher ones."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def draws(id_col: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    rate: int = 90,
    spm: int = 20,
    seed: int = 1,
    markers: Markers = Markers(),
) -> DataFrame:
    """``df`` with ``n`` (units), ``form`` (plain, psm, spm) and ``output``, the text in that form.

    ``rate`` and ``spm`` are hundredths.
    """
    taken: list[str] = [*df.columns]
    names = []
    for name in ("_text", "_one", "_two", "_form"):
        names.append(W.fresh(taken, name))
        taken.append(names[-1])
    text, one, two, form = names
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    plain = (whole == "") | (h3 % 100 >= rate)
    for marker in markers.all:
        plain |= F.contains(whole, F.lit(marker))
    kept = [c for c in df.columns if c not in ("n", "form", "output")]
    shape = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    source = df.select(*kept, whole.alias(text), h1.alias(one), h2.alias(two), shape.alias(form))
    signs = [m.encode() for m in markers.all]

    def outputs(raw, at, forms, cuts):
        """Values and offsets of the outputs."""
        view, parts, sizes = memoryview(raw), [], []
        for f, a, d, b, c in zip(forms, at[:-1].tolist(), at[1:].tolist(), cuts[0].tolist(), cuts[1].tolist()):
            if f == "plain":
                made = [view[a:d]]
            elif f == "psm":
                made = [signs[0], view[a : a + b], signs[1], view[a + c : d], signs[2], view[a + b : a + c]]
            else:
                made = [signs[1], view[a + c : d], signs[0], view[a : a + b], signs[2], view[a + b : a + c]]
            parts += made
            sizes.append(sum(map(len, made)))
        return pa.py_buffer(b"".join(parts)), np.append(0, np.cumsum(sizes))

    def run(batches):
        for batch in batches:
            rest = batch.select(kept)
            first, second = (batch[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in (one, two))
            forms = batch[form].to_pylist()
            for a, b, raw, at in W.slices(batch[text]):
                units = Units(raw, at)
                k = np.stack([first[a:b] % (units.counts + 1), second[a:b] % (units.counts + 1)])
                rows = np.arange(b - a)
                cuts = [units.border(rows, k.min(0)), units.border(rows, k.max(0))]
                data, ends = outputs(raw, at, forms[a:b], cuts)
                made = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int64)), data).cast(pa.string())
                columns = [*rest.slice(a, b - a).columns, pa.array(units.counts), batch[form].slice(a, b - a), made]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n", "form", "output"])

    schema = df.select(*kept).schema.add("n", "long").add("form", "string").add("output", "string")
    return source.mapInArrow(W.tidy(run), schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", markers: Markers = Markers()) -> DataFrame:
    """``df`` with ``prefix``, ``middle``, ``suffix`` (null where plain) and ``restored``, read from output and form only."""
    cut = F.split(F.col(output), "|".join(re.escape(m) for m in markers.all), -1)
    held = W.fresh(df.columns, "_parts")
    kept = [c for c in df.columns if c not in ("prefix", "middle", "suffix", "restored")]
    split = df.withColumn(held, F.when(F.col(form) != "plain", cut))
    psm = F.col(form) == "psm"
    prefix = F.when(psm, F.get(held, F.lit(1))).otherwise(F.get(held, F.lit(2)))
    suffix = F.when(psm, F.get(held, F.lit(2))).otherwise(F.get(held, F.lit(1)))
    middle = F.get(held, F.lit(3))
    whole = F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(prefix, middle, suffix))
    return split.select(*kept, prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), whole.alias("restored"))
