"""Codes for vectors: equal parts, a codebook for each part position, learnt by rounds of k-means on integers.

Every component x becomes floor(4096 x). The books begin as the parts of the vectors
with the smallest ids. A round gives every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves an entry to the componentwise floor of its
parts' mean; an entry without parts stays. All of it is exact integer work over all rows.

The rounds don't look at every part. Rows are gathered in blocks, and each block keeps, for
each part position, a metric tree made once, middle-out: about sqrt(n) anchors are
chosen, each the point furthest from its anchor so far, and take over points that are nearer
to them (a point closer to its anchor than half the gap between anchors is not looked at). Anchors
are merged, the two with the smallest ball around both first, into the upper tree, and
split in the same way below. A ball caches count, sum and radius. In a round the root starts
with all entries; a ball drops an entry when, even at the point of the ball that suits it
most, another entry is nearer, and hands what is left of its list to its children. A ball
left with one entry is wholly owned: its cached sum and count are added and nothing below
it is read. Only points of small balls at the end are compared one by one, with the entries
still listed. A ball of equal points is settled at once however many they are, so a vector that a
third of all rows repeat costs no more than others.

A round sends one row for each (part, entry, position) and task to the shuffle, and as
many as the books have numbers to the driver. Blocks are written once to the shared folder
and read in each round; lost tasks read them again.

Rows whose vector is null, empty, or holds a null or non-finite component are dropped. Null
ids come last, equal ids by vector; repeated rows count as often as they stand there. All vectors have one length, a multiple
of ``parts``; another length is an error, as are components beyond ``LIMIT`` (in absolute value), where sums
of squares would leave 64 bits. With fewer rows than entries the books are smaller. Other columns stay; existing
columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import words as W
from panelspark.session import scratch_path

SCALE = 4096
#: Components are at most this, so that a squared distance over 64 components fits in 64 bits.
LIMIT = 1 << 14
BLOCK = 4096
LEAF = 32


def grid(vectors: np.ndarray) -> np.ndarray:
    """Components as integers; scaling by a power of two is exact."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > SCALE * LIMIT:
        raise ValueError(f"a component beyond {LIMIT}")
    return scaled.astype(np.int32)


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


# --- trees ------------------------------------------------------------------------


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def anchors(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The points of at most ``most`` anchors."""
    owner, far = np.zeros(len(x), np.int64), norms(x - x[0])
    pivots = [0]
    while len(pivots) < most:
        new = int(far.argmax())
        if far[new] == 0:
            break
        gaps = norms(x[pivots] - x[new])
        able = np.flatnonzero(2 * far >= gaps[owner])
        to_new = norms(x[able] - x[new])
        won = to_new < far[able]
        owner[able[won]], far[able[won]] = len(pivots), to_new[won]
        pivots.append(new)
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.searchsorted(owner[order], np.arange(1, len(pivots))))


class Tree:
    """Balls in arrays, children behind their parents: ``left``, ``right`` (-1 in a leaf), and the run ``start:stop`` of ``order``."""

    FIELDS = ("left", "right", "start", "stop", "radius", "order")

    def __init__(self, left, right, start, stop, radius, order, points):
        self.left, self.right, self.start, self.stop, self.radius, self.order = left, right, start, stop, radius, order
        self.points = points
        running = np.zeros((len(order) + 1, points.shape[1]), np.int64)
        np.cumsum(points[order], axis=0, out=running[1:])
        self.count = stop - start
        self.sums = running[stop] - running[start]


def grow_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The fields of a tree over integer points."""
    x = points.astype(np.float64)
    left, right, start, stop, radius = [], [], [], [], []
    order: list[np.ndarray] = []
    placed = 0

    def reach(rows: np.ndarray) -> tuple[np.ndarray, float]:
        centre = x[rows].mean(0)
        return centre, float(norms(x[rows] - centre).max())

    def nest(rows: np.ndarray):
        """A nested tree of row arrays, middle-out."""
        if len(rows) <= LEAF:
            return rows
        groups = [rows[g] for g in anchors(x[rows], max(2, int(len(rows) ** 0.5)))]
        if len(groups) == 1:
            return rows
        balls = [reach(g) for g in groups]
        centres = np.array([c for c, _ in balls])
        radii, sizes = np.array([r for _, r in balls]), np.array([len(g) for g in groups])
        nodes = [nest(g) for g in groups]
        live = np.ones(len(groups), bool)

        def around(i: int) -> np.ndarray:
            gap = norms(centres - centres[i])
            both = np.maximum(np.maximum(radii, radii[i]), (gap + radii + radii[i]) / 2)
            both[~live] = np.inf
            both[i] = np.inf
            return both

        cost = np.array([around(i) for i in range(len(groups))])
        for _ in range(len(groups) - 1):
            i, j = divmod(int(cost.argmin()), len(groups))
            both, total = cost[i, j], sizes[i] + sizes[j]
            centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / total
            # a ball around the common mean may need more than the smallest one
            radii[i], sizes[i], nodes[i], live[j] = both, total, (nodes[i], nodes[j]), False
            cost[j, :] = cost[:, j] = np.inf
            cost[i, :] = around(i)
            cost[:, i] = cost[i, :]
        return nodes[int(np.flatnonzero(live)[0])]

    stack = [(nest(np.arange(len(x))), -1, False)]
    opened: list[int] = []
    # depth first, so that every ball is a run of the order; runs of inner balls are closed afterwards
    while stack:
        node, parent, is_right = stack.pop()
        own = len(left)
        if parent >= 0:
            (right if is_right else left)[parent] = own
        left.append(-1), right.append(-1), start.append(placed), stop.append(-1), radius.append(0.0)
        if isinstance(node, tuple):
            opened.append(own)
            stack += [(node[1], own, True), (node[0], own, False)]
        else:
            order.append(node)
            placed += len(node)
            stop[own] = placed
    for own in reversed(opened):
        stop[own] = stop[right[own]]
    flat = np.concatenate(order)
    ordered = x[flat]
    for own, (a, b) in enumerate(zip(start, stop)):
        run = ordered[a:b]
        radius[own] = 0.0 if (run == run[0]).all() else float(norms(run - run.mean(0)).max()) * (1 + 1e-9)
    made = [np.array(f, np.int32) for f in (left, right, start, stop)]
    return dict(zip(Tree.FIELDS, [*made, np.array(radius), flat.astype(np.int32)]))


def runs(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all runs ``start:stop`` in a row."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - ends + size, size)


def nearest_of(points: np.ndarray, book: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """The nearest listed entry of each point, by exact distances; the lower index wins ties."""
    top = max(int(np.abs(book).max()), int(np.abs(points).max()) if len(points) else 0)
    if 8 * book.shape[1] * top * top < 1 << 53:
        # every number on the way is a whole one that doubles hold, so the products are exact
        x, c = points.astype(np.float64), book.astype(np.float64)
        d = np.square(x).sum(1)[:, None] - 2 * (x @ c.T) + np.square(c).sum(1)
        return np.where(listed, d, np.inf).argmin(1)
    best, entry = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
    for e in range(len(book)):
        rows = np.flatnonzero(listed[:, e])
        d = np.square(points[rows] - book[e]).sum(1)
        nearer = d < best[rows]
        best[rows[nearer]], entry[rows[nearer]] = d[nearer], e
    return entry


def owned(tree: Tree, book: np.ndarray):
    """Yields (balls, entries) of wholly owned balls and (places in the order, entries) of single points, as (kind, what, entries)."""
    entries = book.astype(np.float64)
    between = norms((entries[:, None] - entries[None]).reshape(-1, book.shape[1])).reshape(len(book), -1)
    top = max(float(np.abs(entries).max()), float(np.abs(tree.points).max()), 1.0)
    # far above what rounding can do to a squared distance
    slack = 1e-12 * top * top
    ball, listed = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    while len(ball):
        centre = tree.sums[ball] / tree.count[ball, None]
        d = np.square(centre[:, None] - entries[None]).sum(2)
        d[~listed] = np.inf
        best = d.argmin(1)
        # at the point nearest to an entry's side, its lead over the best is less by 2 * radius * (gap between the two)
        lead = d - d[np.arange(len(ball)), best][:, None]
        listed &= lead <= 2 * tree.radius[ball, None] * between[best] * (1 + 1e-9) + slack
        equal = tree.radius[ball] == 0
        if equal.any():
            at = ball[equal]
            entry = nearest_of(tree.points[tree.order[tree.start[at]]], book, listed[equal])
            listed[equal] = False
            listed[np.flatnonzero(equal), entry] = True
        whole = listed.sum(1) == 1
        if whole.any():
            yield "balls", ball[whole], listed[whole].argmax(1)
        ball, listed = ball[~whole], listed[~whole]
        leaf = tree.left[ball] < 0
        if leaf.any():
            a, b = tree.start[ball[leaf]], tree.stop[ball[leaf]]
            place = runs(a, b)
            yield "points", place, nearest_of(tree.points[tree.order[place]], book, np.repeat(listed[leaf], b - a, axis=0))
        ball, listed = ball[~leaf], listed[~leaf]
        ball, listed = np.append(tree.left[ball], tree.right[ball]), np.concatenate([listed, listed])


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of each entry."""
    count, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    for kind, what, entry in owned(tree, book):
        if kind == "balls":
            np.add.at(count, entry, tree.count[what])
            np.add.at(sums, entry, tree.sums[what])
        else:
            count += np.bincount(entry, minlength=len(book))
            np.add.at(sums, entry, tree.points[tree.order[what]])
    return count, sums


def entries_of(tree: Tree, book: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    out = np.empty(len(tree.order), np.int64)
    for kind, what, entry in owned(tree, book):
        if kind == "balls":
            out[tree.order[runs(tree.start[what], tree.stop[what])]] = np.repeat(entry, tree.count[what])
        else:
            out[tree.order[what]] = entry
    return out


# --- jobs -------------------------------------------------------------------------


@dataclass
class Codebooks:
    """``books[part, entry, position]``."""

    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def forest(points: np.ndarray, parts: int) -> bytes:
    """A block's points and the trees of its parts."""
    arrays = {"points": points}
    for p, part in enumerate(np.split(points, parts, axis=1)):
        arrays |= {f"{name}{p}": field for name, field in grow_tree(part).items()}
    return pack_arrays(**arrays)


def trees(data: bytes, parts: int):
    """The trees of a block, one at a time."""
    arrays = np.load(io.BytesIO(data))
    cut = np.split(arrays["points"].astype(np.int64), parts, axis=1)
    for p in range(parts):
        yield p, Tree(*[arrays[f"{name}{p}"].astype(np.float64 if name == "radius" else np.int64) for name in Tree.FIELDS], cut[p])


def ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def blocks(df: DataFrame, vec_col: str, kept: list[str], dims: int, parts: int) -> DataFrame:
    """One row for each block of at most BLOCK rows of a task: the other columns and the forest, in the shared folder."""
    held = W.fresh(kept, "_vec")
    source = df.select(*kept, F.col(vec_col).cast("array<double>").alias(held))

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(waiting).combine_chunks()
            batch = table.to_batches()[0]
            lists = batch[held]
            sizes = np.diff(np.asarray(lists.offsets))
            if (sizes != dims).any():
                raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} components; all must have {dims}")
            points = grid(np.asarray(lists.flatten()).reshape(-1, dims))
            rest = batch.select(kept)
            made = [pa.array([ipc(rest)], pa.binary()), pa.array([forest(points, parts)], pa.binary())]
            return pa.RecordBatch.from_arrays(made, ["rest", "forest"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                room = BLOCK - sum(b.num_rows for b in waiting)
                piece = batch.slice(a, BLOCK)
                while piece.num_rows:
                    waiting.append(piece.slice(0, room))
                    piece = piece.slice(room)
                    if sum(b.num_rows for b in waiting) == BLOCK:
                        yield flush()
                        waiting.clear()
                    room = BLOCK - sum(b.num_rows for b in waiting)
        if waiting:
            yield flush()

    path = scratch_path(df.sparkSession, "vector-blocks")
    # a row is a megabyte or so; small row groups keep a reader's batch small
    source.mapInArrow(W.tidy(run), "rest binary, forest binary").write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema("rest binary, forest binary").parquet(path)


def kept_rows(df: DataFrame, vec_col: str) -> DataFrame:
    return df.where(usable(F.col(vec_col)))


def first_books(rows: DataFrame, vec_col: str, id_col: str, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids: (part, entry, position)."""
    first = rows.select(id_col, F.col(vec_col).cast("array<double>").alias("_vec")).orderBy(F.col(id_col).asc_nulls_last(), "_vec").limit(entries)
    found = [r["_vec"] for r in first.collect()]
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(v) for v in found}) > 1 or len(found[0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return grid(np.array(found)).astype(np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2)


def learn(held: DataFrame, books: np.ndarray, rounds: int) -> Codebooks:
    parts, entries, width = books.shape

    def step(books: np.ndarray):
        def run(batches):
            total = np.zeros((parts, entries, width + 1), np.int64)
            for batch in batches:
                for data in batch["forest"]:
                    for p, tree in trees(data.as_buffer(), parts):
                        count, sums = totals(tree, books[p])
                        total[p, :, 0] += count
                        total[p, :, 1:] += sums
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place])], ["place", "total"])

        return W.tidy(run)

    for _ in range(rounds):
        made = held.select("forest").mapInArrow(step(books), "place long, total long")
        total = np.zeros((parts, entries, width + 1), object)
        # sums in decimals: no number of rows overflows them
        for r in made.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            total.reshape(-1)[r["place"]] = int(r["total"])
        books = books.copy()
        for p, e in np.argwhere(total[:, :, 0] > 0).tolist():
            books[p, e] = [s // total[p, e, 0] for s in total[p, e, 1:]]
    return Codebooks(books)


def encode(
    df: DataFrame,
    vec_col: str = "embedding",
    id_col: str = "vec_id",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
) -> tuple[DataFrame, Codebooks]:
    """The kept rows without their vectors, with ``code`` (two hex digits for each part) and ``error`` (squared distances summed); the books."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = [c for c in df.columns if c not in (vec_col, "code", "error")]
    schema = df.select(*kept).schema.add("code", "string").add("error", "long")
    rows = kept_rows(df, vec_col)
    books = first_books(rows, vec_col, id_col, parts, entries)
    if not books.size:
        return df.sparkSession.createDataFrame([], schema), Codebooks(books)
    held = blocks(rows, vec_col, kept, books.shape[0] * books.shape[2], parts)
    made = learn(held, books, rounds)
    final = made.books

    def run(batches):
        for batch in batches:
            for data, other in zip(batch["forest"], batch["rest"]):
                codes, error = [], 0
                for p, tree in trees(data.as_buffer(), parts):
                    entry = entries_of(tree, final[p])
                    error = error + np.square(tree.points - final[p][entry]).sum(1)
                    codes.append(entry)
                digits = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
                made_codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                rest = pa.ipc.open_stream(other.as_buffer()).read_next_batch()
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(made_codes), pa.array(error)], [*kept, "code", "error"])

    return held.mapInArrow(W.tidy(run), schema), made
