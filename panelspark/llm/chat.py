r"""Chat templates checked by a grammar round trip.

A turn is rendered as

* user: ``<s>[INST] text [/INST]``
* assistant: `` text </s>`` (the loss mask covers the text)
* system: ``<s><<SYS>> text <</SYS>>``
* any other role: ``<s>[ROLE]name text [/ROLE]``, the name percent-encoded

and a conversation is its turns in order. A lexer cuts the control strings out of the
rendered text; the parser is deterministic, one token ahead. A turn is rendered as it
stands, parsed again and compared with the source. Where they differ, a backslash is
put behind the first sign of every control string in the text (one more where
backslashes stand there already); reading takes one away. So only texts in conflict
are altered, and every text comes back.

Null texts and roles count as empty. Turns order by turn (nulls first), then role and
text; repeated rows stay. A null conversation id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A control string, with the backslashes that escape it.
CONTROL = re.compile(r"[<\[](\\*)(?:/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\])")
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<s><<SYS>> ", " <</SYS>>")}


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[1] else m[0], text)


def wrap(role: str, text: str) -> str:
    if role in MARKS:
        before, after = MARKS[role]
        return before + text + after
    return f"<s>[ROLE]{quote(role, safe='')} {text} [/ROLE]"


class Parser:
    """Reads rendered text piece by piece and gives (role, text as written, its start) of every whole turn."""

    def __init__(self) -> None:
        self.rest, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int]]:
        self.rest += piece
        done = 0
        tokens = (m for m in CONTROL.finditer(self.rest) if not m[1])
        for first in tokens:
            head = first[0]
            if head == "</s>":  # an assistant's turn has no mark before it
                role, start, end = "assistant", done + 1, first.start() - 1
                fine = self.rest[done : done + 1] == " " and self.rest[end] == " " and start <= end
            else:
                second = next(tokens, None)
                last = second and next(tokens, None)
                if not last:
                    break
                start, end = second.end(), last.start() - 1
                kind = (head, second[0], last[0])
                fine = first.start() == done and second.start() == first.end() and self.rest[end] == " "
                if kind == ("<s>", "[ROLE]", "[/ROLE]"):
                    cut = self.rest.find(" ", start)
                    role, start = unquote(self.rest[start:cut]), cut + 1
                elif kind == ("<s>", "[INST]", "[/INST]"):
                    role, start, fine = "user", start + 1, fine and self.rest[start] == " "
                elif kind == ("<s>", "<<SYS>>", "<</SYS>>"):
                    role, start, fine = "system", start + 1, fine and self.rest[start] == " "
                else:
                    fine = False
                fine, first = fine and start <= end, last
            if not fine:
                raise ValueError(f"no turn at {self.at + done}")
            yield role, self.rest[start:end], self.at + start
            done = first.end()
        self.rest, self.at = self.rest[done:], self.at + done

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"text behind the last turn at {self.at}")


def parse(text: str) -> list[tuple[str, str, int]]:
    parser = Parser()
    turns = list(parser.feed(text))
    parser.close()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text and the span of what the loss covers, after the round trip held."""
    for written in (text, escape(text)):
        out = wrap(role, written)
        try:
            read = [(r, unescape(t), at) for r, t, at in parse(out)]
        except (ValueError, IndexError):
            continue
        if len(read) == 1 and read[0][:2] == (role, text):
            return out, read[0][2], len(written) if role == "assistant" else 0
    raise ValueError("a turn does not survive the round trip")


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_chars) for each row of ``df``.

    A conversation's text is its ``formatted`` pieces in order; the loss span counts
    code points from the start of the piece. Runs in the tasks that read, without a shuffle.
    """
    source = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        for batch in batches:
            made = [render(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.int64()),
                    pa.array([m[2] for m in made], pa.int64()),
                ],
                [*batch.schema.names, "formatted", "loss_start", "loss_chars"],
            )

    schema = "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_chars long"
    return source.mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the parser reads back from the formatted pieces, and nothing else.

    Pieces stream through in order, one conversation after the other; a task keeps one
    unfinished turn and three running sums, however long a conversation is.
    """
    ordered = (
        formatted.select("conv_id", "turn", "role", "text", "formatted")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
        .select("conv_id", "formatted")
    )

    def run(batches):
        here, state = None, None
        for batch in batches:
            done = []
            for conv, piece in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist()):
                if state is None or conv != here:
                    if state is not None:
                        done.append(state.row(here))
                    here, state = conv, _Running()
                state.add(piece)
            if done:
                yield _rows(done)
        if state is not None:
            yield _rows([state.row(here)])

    return ordered.mapInArrow(run, DIGEST)


class _Running:
    def __init__(self) -> None:
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str) -> None:
        self.chars += len(piece)
        for role, written, _ in self.parser.feed(piece):
            text = unescape(written)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv):
        self.parser.close()
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _rows(rows) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
