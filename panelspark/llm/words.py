"""Words of texts as numpy arrays, straight from the UTF-8 buffers of Arrow batches.

No Python object is made for a text or a word. Texts are taken in slices of bounded
bytes (a longer text is a slice of its own), and a word is known by a 64-bit hash of
its bytes: a sum of random numbers for the bytes, times powers of an odd number for
their places.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 5
U64 = np.uint64


def tidy(run):
    """A task's function that gives freed memory back when it ends: workers stay, and would keep it."""

    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # not every C library has it
        trim(0)


def fresh(columns: list[str], name: str = "_text") -> str:
    """A column name that isn't taken, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_NUMBERS = _numbers(256, 77)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that make words: all but white space, or letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.ones(n, U64), np.ones(n, U64)
    up[1:], down[1:] = U64(BASE), U64(inverse)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of a run of texts: ``hashes`` in order, ``first[i]:first[i + 1]`` for text i, byte spans."""

    __slots__ = ("data", "hashes", "first", "start", "end", "base")

    def __init__(self, data, hashes, first, start, end, base):
        self.data, self.hashes, self.first, self.start, self.end, self.base = data, hashes, first, start, end, base

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space in front of and behind each; where each text begins."""
    n = len(offsets) - 1
    begins = (offsets[:-1] - offsets[0]) + np.arange(1, n + 1)
    data = np.full(int(offsets[-1] - offsets[0]) + n + 1, 0x20, np.uint8)
    for a, b, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), begins.tolist()):
        data[to : to + b - a] = raw[a:b]
    return data, begins


def split(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``, with A-Z as lower case."""
    data, begins = padded(raw, offsets)
    data = LOWER[data]
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        # pieces end behind a byte that is in no word, so long texts need no more memory than their words
        upto = min(at + PIECE, len(data))
        while upto < len(data) and kind[data[upto - 1]]:
            upto += 1
        piece = data[at:upto]
        edge = np.diff(np.concatenate([[0], kind[piece].view(np.int8), [0]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(max(PIECE, 1 << int(len(piece)).bit_length()))
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(BYTE_NUMBERS[piece] * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * down[start]))
        starts.append(start + at)
        ends.append(end + at)
        at = upto
    start = np.concatenate(starts)
    first = np.append(np.searchsorted(start, begins), len(start))
    return Words(data, np.concatenate(hashes), first, start, np.concatenate(ends), begins)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column without nulls."""
    if pa.types.is_large_string(column.type):
        wide = np.int64
    elif pa.types.is_string(column.type):
        wide = np.int32
    else:
        column, wide = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for runs of rows of at most ``most`` bytes, or one row."""
    raw, at = buffers(column)
    n, row = len(at) - 1, 0
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        upto = min(upto, n)
        yield row, upto, raw, at[row : upto + 1]
        row = upto


def of_texts(texts: list[str | None], kind: np.ndarray = NOT_SPACE) -> Words:
    raw, at = buffers(pa.array(["" if t is None else t for t in texts], pa.string()))
    return split(raw, at, kind)
