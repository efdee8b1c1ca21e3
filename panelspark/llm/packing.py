"""Best-fit packing by minimum bin slack.

``pieces`` encodes whole texts (by the tiktoken library with the tokens of the tokenizer file; the tests hold
its ids against the tokenizers library), ends each document with one id and cuts those beyond the
capacity into full pieces, the first of which may be shorter. ``pack`` puts pieces into
sequences of at most ``capacity`` tokens, as few as it can. ``sequences`` writes them out.

Packing depends on how many pieces there are of each length and on nothing else, and there are
at most ``capacity`` lengths. So the counts alone are planned on the driver: a bin takes the longest piece
left; a dynamic program over bitsets, whose bit s says that the available lengths reach the
sum s, finds the fullest combination for the rest; it is then removed. Lengths join longest first and the
program ends as soon as the bin is full, so short pieces are kept for the bins that need them. Filling every
bin to the last token still uses them up early, so plans are made for several allowed slacks (a bin
short of full by no more is full enough) and the one with the fewest bins is taken; no plan is
tried beyond one that meets the lower bound. A bin's combination stays the best one for as long as there
are pieces for it, so it is taken as many times as they last: a plan has at most
capacity * (1 + ln capacity) kinds of bins for any number of rows, a size bound that doesn't depend on the data.

Rows find their bin by their number within their length. Every length is cut at random
into cells of about max(500, sqrt(rows)) rows, rows are numbered within a cell, and
offsets of cells (at most sqrt(rows) of them a length) make gapless numbers. One length
may have all rows. The plan, by length, is joined by a broadcast within the bound above.

Null texts count as empty, and an empty text is a piece of its end id alone. Repeated rows
are packed as often as they stand there. Lengths outside 1 to ``capacity`` are an error in ``pack``. An empty table
gives no rows. Other columns stay but for the text; existing columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from panelspark.llm import bpe
from panelspark.llm import words as W
from panelspark.session import materialise

CELL = 500
#: Tokens by which a bin may stay short of full, tried in this order.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)


def encoding(vocabulary: bpe.Vocabulary) -> tiktoken.Encoding:
    """The vocabulary as ranks; that is the same encoding where ids ascend with the merges and every token is what its own bytes merge into."""
    if not (vocabulary.alone.all() and (np.diff(vocabulary.ids[256:]) > 0).all()):
        raise ValueError("the merges of this vocabulary are not ranks of its tokens")
    ranks = dict(zip(vocabulary.bytes, vocabulary.ids.tolist()))
    return tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.specials)


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, start, length) of every piece of documents of these sizes; only the first may be shorter."""
    count = -(-sizes // capacity)
    document = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    first = (sizes - (count - 1) * capacity)[document]
    start = np.where(number > 0, first + (number - 1) * capacity, 0)
    return document, number, start, np.where(number > 0, capacity, first)


def pieces(
    df: DataFrame,
    vocabulary: bpe.Vocabulary,
    text_col: str = "text",
    capacity: int = 1024,
    end: int = 2,
    ids: str | None = "ids",
    crc: str | None = None,
) -> DataFrame:
    """One row for each piece: ``piece``, ``start``, ``length`` and, where named, its ids and the CRC-32 of its little-endian 32-bit ids."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    held_text = W.fresh(df.columns)
    made_names = ["piece", "start", "length", *([ids] if ids else []), *([crc] if crc else [])]
    kept = [c for c in df.columns if c not in (text_col, *made_names)]
    source = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(held_text))

    def run(batches):
        encode, tail = encoding(held.value).encode_to_numpy, np.array([end], np.uint32)
        for batch in batches:
            for a, b, _, _ in W.slices(batch[held_text]):
                encoded = [encode(t, allowed_special="all") for t in batch[held_text].slice(a, b - a).to_pylist()]
                flat = np.concatenate([x for ids_of in encoded for x in (ids_of, tail)])
                sizes = np.array([len(x) + 1 for x in encoded])
                begin = np.cumsum(sizes) - sizes
                document, number, start, length = cuts(sizes, capacity)
                at = begin[document] + start
                columns = [c.take(pa.array(document + a)) for c in batch.select(kept).columns]
                columns += [pa.array(number.astype(np.int32)), pa.array(start), pa.array(length)]
                if ids:
                    # pieces follow each other without gaps, so their ids are runs of one array
                    bounds = np.append(at, len(flat)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32))))
                if crc:
                    data = memoryview(flat.astype("<u4").tobytes())
                    sums = [zlib.crc32(data[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist())]
                    columns.append(pa.array(sums, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made_names])

    schema = df.select(*kept).schema.add("piece", IntegerType()).add("start", "long").add("length", "long")
    if ids:
        schema = schema.add(ids, ArrayType(IntegerType()))
    if crc:
        schema = schema.add(crc, "long")
    return source.mapInArrow(W.tidy(run), schema)


def fullest(count: dict[int, int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """(length, copies) of the fullest combination within ``room``, with long pieces where several are as full.

    With a slack, the fullest one of the longest lengths that leave no more than it.
    """
    mask, enough = (1 << (room + 1)) - 1, max(room - slack, 0)
    reach, steps = 1, []
    for length in sorted((x for x, n in count.items() if n and x <= room), reverse=True):
        left = min(count[length], room // length)
        copies = 1
        # copies in powers of two and a rest reach every number of them
        while left and not reach >> enough:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
        if reach >> enough:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            used[length] += copies
            total -= length * copies
    return sorted(used.items(), reverse=True)


Plan = list[tuple[int, list[tuple[int, int]]]]


def plan(count: dict[int, int], capacity: int) -> Plan:
    """(bins, [(length, pieces a bin)]) that hold all pieces; the best over the allowed slacks, the smaller one where equal."""
    if any(not 1 <= length <= capacity for length, n in count.items() if n):
        raise ValueError(f"a length outside 1 to {capacity}")
    total = sum(length * n for length, n in count.items())
    bound = max(-(-total // capacity), sum(n for length, n in count.items() if 2 * length > capacity))
    best, fewest = [], None
    for slack in SLACKS:
        bins = plan_within(count, capacity, slack)
        made = sum(times for times, _ in bins)
        if fewest is None or made < fewest:
            best, fewest = bins, made
        if fewest == bound:
            break
    return best


def plan_within(count: dict[int, int], capacity: int, slack: int) -> Plan:
    left = {length: n for length, n in count.items() if n}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = dict(fullest(left, capacity - longest, slack))
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return bins


def runs_of(bins: Plan) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, in the order of its pieces' numbers: (first number, first bin, pieces a bin, place of the first in a bin)."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first_bin = 0
    for times, used in bins:
        place = 0
        for length, n in used:
            out[length].append((taken[length], first_bin, n, place))
            taken[length] += n * times
            place += n * length
        first_bin += times
    return out


def numbered(rows: DataFrame, length: str, count: dict[int, int], out: str, spread: str) -> DataFrame:
    """Rows with gapless numbers from 0 among those of their length; ``spread`` is a stable random number of the row."""
    size = max(CELL, int(sum(count.values()) ** 0.5))
    cells = {x: -(-n // size) for x, n in count.items()}
    cell, base, cell_length, of = (W.fresh(rows.columns, x) for x in ("_cell", "_base", "_of_length", "_of_cell"))
    by_length = F.create_map(*[F.lit(v).cast("long") for x in sorted(cells.items()) for v in x])
    celled = rows.withColumn(cell, F.pmod(F.col(spread), by_length[F.col(length).cast("long")]))
    before = Window.partitionBy(cell_length).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    sums = celled.groupBy(F.col(length).alias(cell_length), F.col(cell).alias(of)).agg(F.count(F.lit(1)).alias(base))
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(length, cell).orderBy(spread)) - 1
    placed = celled.withColumn(out, within).join(sums, (F.col(length) == F.col(cell_length)) & (F.col(cell) == F.col(of)))
    return placed.withColumn(out, F.col(out) + F.col(base)).drop(cell, base, cell_length, of)


def pack(df: DataFrame, length_col: str = "length", capacity: int = 1024) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``, the piece's place in its sequence; no gaps.

    ``df`` is written once; its rows are shuffled once by their length and cell.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("sequence_id", "offset")]
    spread, number, key = (W.fresh(kept, x) for x in ("_spread", "_number", "_plan_length"))
    at_first, at_bin, at_size, at_place = (W.fresh(kept, x) for x in ("_firsts", "_bins", "_sizes", "_places"))
    rows = materialise(df.select(*kept, F.xxhash64(F.monotonically_increasing_id()).alias(spread)), "pieces")
    found = rows.groupBy(F.col(length_col).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("c")).where(
        f"n IS NULL OR n NOT BETWEEN 1 AND {int(capacity)} OR c > 0"
    ).limit(capacity + 1).collect()
    if any(r["n"] is None for r in found):
        raise ValueError("a piece without a length")
    count = {r["n"]: r["c"] for r in found}
    by_length = runs_of(plan(count, capacity))
    if not count:
        return rows.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    lists = [(length, *map(list, zip(*runs))) for length, runs in sorted(by_length.items())]
    kind = ", ".join(f"{x} array<long>" for x in (at_first, at_bin, at_size, at_place))
    plans = F.broadcast(spark.createDataFrame(lists, f"{key} long, {kind}"))
    joined = numbered(rows, length_col, count, number, spread).join(plans, F.col(length_col) == F.col(key))
    # binary search for the last run that begins at or before the row's number
    width, at, steps = 1, "1", []
    while width < max(len(x) for x in by_length.values()):
        width *= 2
    while width:
        name = W.fresh([*joined.columns], f"_at{width}")
        steps.append(f"{at} + CASE WHEN coalesce(try_element_at(`{at_first}`, {at} + {width}) <= `{number}`, false) THEN {width} ELSE 0 END AS {name}")
        at, width = name, width // 2
    searched = joined.selectExpr("*", *steps)
    get = lambda name: F.element_at(F.col(name), F.col(at))
    behind = F.col(number) - get(at_first)
    nth = F.pmod(behind, get(at_size))
    return searched.select(
        *kept,
        (get(at_bin) + F.floor((behind - nth) / get(at_size))).alias("sequence_id"),
        (get(at_place) + nth * F.col(length_col)).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """One row for each sequence: ``sequence_id``, its ``ids`` and the ``offsets`` at which its pieces begin."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("offsets")
    )
