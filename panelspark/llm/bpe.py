"""Byte-level BPE by speculation and verification.

Texts are cut into words by the public pattern. Words not seen lately are encoded
together: a greedy longest match proposes tokens for all of them in step, then every
adjacent pair of proposed tokens is tested. Two tokens fit together if undoing their
merges, the latest first, never meets a merge across their border that BPE would have
done earlier; a proposal whose pairs all fit is what BPE gives. Words with a pair that
doesn't fit, or with a token that BPE never gives on its own, are merged exactly.

Encoding follows the tokenizer file: special tokens are cut out first (they are
ordinary text only if ``specials`` is off), there is no truncation and no padding.
Null texts count as empty and give no ids. Decoding puts U+FFFD for broken UTF-8; null
ids give an empty text; ids outside the vocabulary are an error. Nothing is shuffled;
a task keeps the words it has seen up to a fixed number of bytes.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from panelspark.llm import words as W

#: Fixed: the pattern of the vocabulary's authors.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40
CACHE_BYTES = 20 << 20
SHORT = 128


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens in the order of their merges: single bytes, then a token for each merge. Small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, vocab = byte_signs(), spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        names = [*signs, *(a + b for a, b in merges)]
        if len(set(names)) != len(names):
            raise ValueError("two merges give one token")
        order = {name: i for i, name in enumerate(names)}
        self.bytes = [bytes(signs[c] for c in name) for name in names]
        self.ids = np.array([vocab[name] for name in names], np.int64)
        pairs = np.array([(order[a], order[b]) for a, b in merges], np.int64).reshape(-1, 2)
        base = len(signs)
        self.left = np.concatenate([np.arange(base), pairs[:, 0]])
        self.right = np.concatenate([np.arange(base), pairs[:, 1]])
        key = pairs[:, 0] << 32 | pairs[:, 1]
        by = np.argsort(key)
        self.pair_keys, self.pair_tokens = key[by], by + base
        self.merge = dict(zip(map(tuple, pairs.tolist()), range(base, len(names))))
        self.byte_token = np.empty(256, np.int64)
        for i in range(base):
            self.byte_token[self.bytes[i][0]] = i
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # by length, the hashes of the tokens
        self.lengths = {}
        sizes = np.array([len(t) for t in self.bytes])
        hashes = np.array([hash_bytes(t) for t in self.bytes], np.uint64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(hashes[own])]
            self.lengths[size] = (hashes[own], own)
        self.alone = np.array([self.exact(t) == [i] for i, t in enumerate(self.bytes)])
        # for decoding, by id
        top = max([*vocab.values(), *self.specials.values()]) + 1
        texts = [b""] * top
        for i, t in zip(self.ids.tolist(), self.bytes):
            texts[i] = t
        for content, i in self.specials.items():
            texts[i] = content.encode()
        self.known = np.zeros(top, bool)
        self.known[[*vocab.values(), *self.specials.values()]] = True
        self.text_start = np.append(0, np.cumsum([len(t) for t in texts]))
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, the leftmost first, with a heap of candidate pairs."""
        token = [int(self.byte_token[b]) for b in word]
        ahead, behind = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        heap = [(m, i) for i in range(len(token) - 1) if (m := self.merge.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = ahead[i]
            if token[i] < 0 or j >= len(token) or self.merge.get((token[i], token[j])) != made:
                continue
            token[i], token[j], ahead[i] = made, -1, ahead[j]
            if ahead[j] < len(token):
                behind[ahead[j]] = i
                if (m := self.merge.get((made, token[ahead[j]]))) is not None:
                    heapq.heappush(heap, (m, i))
            if behind[i] >= 0 and (m := self.merge.get((token[behind[i]], made))) is not None:
                heapq.heappush(heap, (m, behind[i]))
        return [t for t in token if t >= 0]

    def merged(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The token that two tokens merge into, NONE if they don't."""
        key = one << 32 | two
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_tokens[place], NONE)

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """``exact`` for many short words in step: every step does the first merge by rank in each of them."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(-1, size)
            # a column of -1 behind the tokens; no pair with it merges
            token = np.full((len(own), size + 1), -1, np.int64)
            token[:, :-1] = self.byte_token[data]
            made = np.where(token[:, 1:] >= 0, self.merged(token[:, :-1], token[:, 1:] & 0xFFFFFFFF), NONE)
            live, places = np.arange(len(own)), np.arange(size)
            while len(live):
                at = made[live].argmin(1)
                new = made[live, at]
                live, at, new = live[new < NONE], at[new < NONE], new[new < NONE]
                rows = np.arange(len(live))
                later = np.minimum(places + (places > at[:, None]), size)
                token[live, :-1] = token[live[:, None], later]
                made[live] = np.where(later < size, made[live[:, None], np.minimum(later, size - 1)], NONE)
                token[live, at] = new
                after = token[live, at + 1]
                made[live, at] = np.where(after >= 0, self.merged(new, after & 0xFFFFFFFF), NONE)
                left = rows[at > 0]
                made[live[left], at[left] - 1] = self.merged(token[live[left], at[left] - 1], new[left])
            for i, row in zip(own.tolist(), token.tolist()):
                out[i] = row[: row.index(-1)]
        return out

    def fits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which of these token pairs can stand side by side."""
        good = np.ones(len(one), bool)
        at, one, two = np.arange(len(one)), one.copy(), two.copy()
        limit = np.full(len(one), NONE)
        while len(at):
            made = self.merged(one, two)
            wrong = made < limit
            good[at[wrong]] = False
            # undo the later of the two merges; where that token is a byte, the other; two bytes end it
            later = one > two
            first, second = self.right[one], self.left[two]
            split_one = (later & (first != one)) | (~later & (second == two))
            limit = np.where(split_one, one, two + 1)
            ended = (first == one) & (second == two)
            one, two = np.where(split_one, first, one), np.where(split_one, two, second)
            live = ~(wrong | ended)
            at, one, two, limit = at[live], one[live], two[live], limit[live]
        return good

    def greedy(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of all words in step: (word, token) in the order of the text."""
        sums, down = hash_sums(data)
        cursor, end = first[:-1].copy(), first[1:]
        words, tokens, steps = [], [], []
        live, step = np.flatnonzero(cursor < end), 0
        while len(live):
            open_ = live
            for size in sorted(self.lengths, reverse=True):
                long = end[open_] - cursor[open_] >= size
                some = open_[long]
                if not len(some):
                    continue
                at = cursor[some]
                key = W.mix((sums[at + size] - sums[at]) * down[at])
                hashes, own = self.lengths[size]
                place = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
                hit = hashes[place] == key
                words.append(some[hit])
                tokens.append(own[place[hit]])
                steps.append(np.full(int(hit.sum()), step))
                cursor[some[hit]] += size
                long[long] = hit
                open_ = open_[~long]
                if not len(open_):
                    break
            live = live[cursor[live] < end[live]]
            step += 1
        word, token, step = np.concatenate(words), np.concatenate(tokens), np.concatenate(steps)
        by = np.lexsort((step, word))
        return word[by], token[by]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words that aren't empty, and where each word's ids begin."""
        sizes = np.array([len(w) for w in words])
        # a word beyond this many bytes takes as many steps; it is merged exactly at once
        short = np.flatnonzero(sizes <= SHORT)
        found: dict[int, list[int]] = {int(i): self.exact(words[i]) for i in np.flatnonzero(sizes > SHORT)}
        word = token = np.zeros(0, np.int64)
        if len(short):
            data = np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)
            word, token = self.greedy(data, np.append(0, np.cumsum(sizes[short])))
            beside = np.flatnonzero(word[1:] == word[:-1])
            pairs, back = np.unique(token[beside] << 32 | token[beside + 1], return_inverse=True)
            good = self.fits(pairs >> 32, pairs & 0xFFFFFFFF)[back.reshape(-1)]
            failed = np.unique(np.append(word[beside[~good]], word[~self.alone[token]]))
            keep = ~np.isin(word, failed)
            word, token = short[word[keep]], token[keep]
            some = short[failed].tolist()
            found |= dict(zip(some, self.exact_many([words[i] for i in some])))
        if found:
            word = np.append(word, np.repeat(list(found), [len(t) for t in found.values()]))
            token = np.append(token, np.fromiter(chain.from_iterable(found.values()), np.int64))
            by = np.argsort(word, kind="stable")
            word, token = word[by], token[by]
        return self.ids[token], np.searchsorted(word, np.arange(len(words) + 1))


def hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = W.powers(max(W.PIECE, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(W.BYTE_NUMBERS[data] * up[: len(data)], out=sums[1:])
    return sums, down


def hash_bytes(word: bytes) -> np.uint64:
    sums, _ = hash_sums(np.frombuffer(word, np.uint8))
    return W.mix(sums[-1:])[0]


class Encoder:
    """Encodes texts; keeps the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = True):
        self.vocabulary = vocabulary
        self.words = regex.compile(PATTERN).findall
        self.specials = vocabulary.specials if specials else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.reset()

    def reset(self) -> None:
        self.place = {content: i for i, content in enumerate(self.specials)}
        self.pool = [np.array(list(self.specials.values()), np.int64)]
        self.start, self.size = [np.arange(len(self.specials))], [np.ones(len(self.specials), np.int64)]
        self.used = self.bytes = len(self.specials)

    def pieces(self, text: str) -> list[str]:
        if any(s in text for s in self.specials):
            parts = self.cut.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words(part))]
        return self.words(text)

    def learn(self, fresh: list[str]) -> None:
        ids, first = self.vocabulary.encode_words([w.encode() for w in fresh])
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.pool.append(ids)
        self.start.append(first[:-1] + self.used)
        self.size.append(np.diff(first))
        self.used += len(ids)
        self.bytes += sum(map(len, fresh)) + 8 * len(ids) + 100 * len(fresh)
        if len(self.pool) > 1:
            self.pool, self.start, self.size = ([np.concatenate(x)] for x in (self.pool, self.start, self.size))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text begin."""
        if self.bytes > CACHE_BYTES:
            self.reset()
        lists = [self.pieces(t) for t in texts]
        fresh = set().union(*lists).difference(self.place) if lists else set()
        if fresh:
            self.learn(sorted(fresh))
        counts = np.array([len(x) for x in lists], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        size, start = self.size[0][at], self.start[0][at]
        ends = np.cumsum(size)
        ids = self.pool[0][np.arange(int(size.sum())) + np.repeat(start - ends + size, size)]
        return ids, np.append(0, ends)[np.append(0, np.cumsum(counts))]


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids", specials: bool = True) -> DataFrame:
    """``df`` with the token ids of its texts as array<int>; an existing column ``out`` is replaced."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    held_text = W.fresh(df.columns)
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(held_text))

    def run(batches):
        encoder = Encoder(held.value, specials)
        for batch in batches:
            rest = batch.drop_columns([held_text])
            for a, b, _, _ in W.slices(batch[held_text]):
                ids, first = encoder.encode(batch[held_text].slice(a, b - a).to_pylist())
                made = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, made], [*rest.schema.names, out])

    schema = source.drop(held_text).schema.add(out, ArrayType(IntegerType()))
    return source.mapInArrow(W.tidy(run), schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids, special tokens as their content; an existing column ``out`` is replaced."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    held_ids = W.fresh(df.columns, "_ids")
    source = df.select(*[c for c in df.columns if c != out], F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias(held_ids))

    def text_of(vocabulary: Vocabulary, ids: pa.ListArray) -> pa.Array:
        first = np.asarray(ids.offsets).astype(np.int64)
        flat = np.asarray(ids.values)[first[0] : first[-1]]
        if len(flat) and not (flat.min() >= 0 and flat.max() < len(vocabulary.known) and vocabulary.known[flat].all()):
            raise ValueError("an id outside the vocabulary")
        start = vocabulary.text_start[flat]
        size = vocabulary.text_start[flat + 1] - start
        ends = np.cumsum(size)
        data = vocabulary.text[np.arange(int(size.sum())) + np.repeat(start - ends + size, size)].tobytes()
        bounds = np.append(0, ends)[first - first[0]].tolist()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])], pa.string())

    def run(batches):
        for batch in batches:
            rest = batch.drop_columns([held_ids])
            for a in range(0, batch.num_rows, 256):
                part = batch[held_ids].slice(a, 256)
                made = text_of(held.value, part)
                yield pa.RecordBatch.from_arrays([*rest.slice(a, 256).columns, made], [*rest.schema.names, out])

    return source.mapInArrow(W.tidy(run), source.drop(held_ids).schema.add(out, "string"))
