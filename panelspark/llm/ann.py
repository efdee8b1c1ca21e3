"""Nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, cut in halves at the median along its widest
direction until the pieces are small, then moved to the means of their neighbourhoods.
Every worker has them in memory with a graph of near centroids, and finds those near a
vector by best-first steps along the graph. Every row is indexed: a vector goes to the
list of its nearest centroid and, near a boundary, to the lists of the next ``COPIES - 1``
centroids that are at most ``BOUNDARY`` times as far. A query reads the lists whose centroids are at most ``RATIO``
times as far as the nearest one, and more of the nearest until they hold ``ENOUGH``
rows for each neighbour wanted; where a table has no more than that, every row is read.

A list longer than ``PART`` rows is read in parts by hash of the id, and the queries of
a list in blocks, so a common vector or a crowded list is many small tasks. Each cell
gives the nearest rows of each of its queries, with exact distances in doubles; the
best of all cells are ranked once more, by distance and then id.

Vectors that are null, zero, of another length than most or hold null or non-finite
components take no part, nor do null ids. Rows that repeat an id count once, with the
nearest of their vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import words as W
from panelspark.session import materialise

#: Vectors of the sample, rows of the sample for a list, and the most bytes of all centroids.
SAMPLE, PER_LIST, CENTROID_BYTES = 20_000, 40, 32 << 20
#: Edges of a centroid; centroids kept while searching for a query and for a row of the index.
DEGREE, BEAM, INDEX_BEAM = 16, 112, 32
BOUNDARY, COPIES, RATIO, ENOUGH = 1.3, 3, 1.45, 200
PART, QUERY_BLOCK = 4096, 1024


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The distinct (id, vec) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, vec).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (sizes["d"] if sizes else 0)).distinct()


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def centroids(sample: np.ndarray, per_list: int = PER_LIST) -> np.ndarray:
    """Balanced halves of the sample, then three rounds of means in which crowded lists count as farther."""
    todo, leaves = [sample], []
    while todo:
        some = todo.pop()
        centre = some.mean(0)
        if len(some) <= per_list:
            leaves.append(centre)
            continue
        direction = some[((some - centre) ** 2).sum(1).argmax()] - centre
        for _ in range(5):
            direction = (some - centre).T @ ((some - centre) @ direction)
            norm = np.linalg.norm(direction)
            if not norm:
                break
            direction /= norm
        along = (some - centre) @ direction
        low = along <= np.median(along)
        if low.all() or not low.any():
            low = along < along.max()
        if low.all() or not low.any():
            leaves.append(centre)
            continue
        todo += [some[low], some[~low]]
    c = np.unique(np.array(leaves), axis=0)
    crowd = np.ones(len(c))
    for _ in range(3):
        own = np.concatenate([(squares(sample[i : i + 2048], c) * crowd).argmin(1) for i in range(0, len(sample), 2048)])
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        crowd = np.sqrt(np.maximum(size, 1) / max(1, size.mean())) ** 0.5
    return np.unique(c, axis=0)


class Graph:
    """Centroids with edges to near ones, searched for many vectors at once."""

    def __init__(self, c: np.ndarray):
        self.c, n = c, len(c)
        self.degree = min(DEGREE, n - 1)
        if self.degree:
            between = squares(c, c)
            np.fill_diagonal(between, np.inf)
            near = np.argsort(between, 1, kind="stable")[:, : self.degree]
            # one edge of each to a far centroid keeps the graph in one piece
            near[:, -1] = (np.arange(n) + 1) % n
            self.near = near
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each row, the nearest first, and their distances."""
        n, k = len(x), len(self.c)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        seen[:, self.entry] = True
        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        far = squares(x, self.c[self.entry])
        fresh = np.ones(ids.shape, bool)
        rows = np.arange(n)
        while True:
            order = np.argsort(far, 1, kind="stable")[:, :beam]
            ids, far, fresh = (np.take_along_axis(a, order, 1) for a in (ids, far, fresh))
            live = rows[fresh.any(1)]
            if not len(live) or not self.degree:
                break
            # the nearest four that weren't opened yet
            first = np.argsort(~fresh[live], 1, kind="stable")[:, :4]
            opened = np.take_along_axis(fresh[live], first, 1)
            at = np.take_along_axis(ids[live], first, 1)
            marks = fresh[live]
            np.put_along_axis(marks, first, False, 1)
            fresh[live] = marks
            more = np.where(opened[:, :, None], self.near[at], at[:, :, None]).reshape(len(live), -1)
            new = ~seen[live[:, None], more]
            # a centroid met twice in one step counts once
            sorted_ = np.sort(np.where(new, more, -1), 1)
            new = np.append(np.ones((len(live), 1), bool), sorted_[:, 1:] != sorted_[:, :-1], 1) & (sorted_ >= 0)
            more = np.maximum(sorted_, 0)
            seen[live[:, None], np.where(new, more, at[:, :1])] = True
            gap = ((self.c[more] - x[live][:, None, :]) ** 2).sum(2)
            add = np.full((n, more.shape[1]), np.inf)
            add[live] = np.where(new, gap, np.inf)
            add_ids = np.zeros((n, more.shape[1]), int)
            add_ids[live] = more
            ids, far = np.append(ids, add_ids, 1), np.append(far, add, 1)
            fresh = np.append(fresh, np.isfinite(add), 1)
        return ids, np.sqrt(far)


def lists_for_row(graph: Graph, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the found lists a row is put into."""
    keep = far <= BOUNDARY * far[:, :1]
    keep[:, 0], keep[:, COPIES:] = True, False
    return keep & np.isfinite(far)


def _assigned(rows: DataFrame, graph, keep, beam: int) -> DataFrame:
    """(list, id, vec) for each list that ``keep(graph, ids, far)`` picks."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, far = graph.value.search(matrix(part["vec"]), beam)
                picked = keep(graph.value, ids, far)
                row, place = np.nonzero(picked)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, place].astype(np.int64)), taken["id"], taken["vec"]], ["list", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(W.tidy(run), "list long, id long, vec array<double>")


def nearest(
    df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = RATIO, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each row for which ``is_query(id)`` holds."""
    spark = df.sparkSession
    rows = materialise(usable(df, id_col, vec_col), "vectors")
    total = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    draw = F.shiftrightunsigned(F.xxhash64("id", "vec", F.lit("sample")), 11) / F.lit(float(2**53))
    # the expected number is the bound; a fifth more is never met by chance
    picked = rows.where(draw < sample / total).select("vec").limit(sample * 6 // 5).toArrow()
    points = matrix(picked["vec"])
    if not len(points):
        points = matrix(rows.select("vec").limit(1).toArrow()["vec"])
    width = points.shape[1]
    per_list = max(PER_LIST, int(np.ceil(len(points) * width * 8 / CENTROID_BYTES)))
    graph = spark.sparkContext.broadcast(Graph(centroids(points, per_list)))
    index = materialise(_assigned(rows, graph, lists_for_row, INDEX_BEAM), "lists")
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(graph.value.c))])
    enough = ENOUGH * k

    def probe(graph: Graph, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        if held.sum() <= enough:
            return np.isfinite(far) if ids.shape[1] == len(held) else far <= np.inf
        before = np.cumsum(held[ids], 1) - held[ids]
        return np.isfinite(far) & ((far <= ratio * far[:, :1]) | (before < enough))

    queries = materialise(_assigned(rows.where(is_query(F.col("id"))), graph, probe, BEAM), "probes")
    parts = F.create_map(*[x for i, n in sizes.items() if n > PART for x in (F.lit(i), F.lit(-(-n // PART)))]) if max(sizes.values()) > PART else None
    count_of = lambda: F.coalesce(parts[F.col("list")], F.lit(1)) if parts is not None else F.lit(1)
    asked = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], empty)
    blocks = F.create_map(*[x for i, n in asked.items() for x in (F.lit(i), F.lit(-(-n // QUERY_BLOCK)))])
    left = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), blocks[F.col("list")])).select(
        "list", F.explode(F.sequence(F.lit(0).cast("long"), (count_of() - 1).cast("long"))).alias("part"), "block", "id", "vec"
    )
    right = index.where(blocks[F.col("list")].isNotNull()).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), count_of()).cast("long"))
    right = right.select("list", "part", F.explode(F.sequence(F.lit(0).cast("long"), (blocks[F.col("list")] - 1).cast("long"))).alias("block"), "id", "vec")

    def cell(wanted: pa.Table, there: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if wanted.num_rows and there.num_rows:
            x, y = matrix(wanted["vec"]), matrix(there["vec"])
            ids = np.asarray(there["id"])
            for q, vec in zip(np.asarray(wanted["id"]).tolist(), x):
                gap = np.sqrt(((y - vec) ** 2).sum(1))
                own = np.flatnonzero(ids != q)
                # the nearest row of each id
                own = own[np.lexsort((gap[own], ids[own]))]
                own = own[np.append(True, ids[own][1:] != ids[own][:-1])] if len(own) else own
                best = own[np.lexsort((ids[own], gap[own]))[:k]]
                out["query_id"] += [q] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += gap[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["list", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    over = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
