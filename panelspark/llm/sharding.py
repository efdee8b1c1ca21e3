"""Shards by a hierarchical weighted hash tree.

A tree of regions, racks and shards has a weight at every node. A key descends it: at
each level every child draws ``-ln(u) / weight`` with ``u`` from a hash of the key and
the child's name, and the smallest draw wins, so children get keys in proportion to
their weights. A changed weight alters the draws of one node's child only: keys move
between that child and its siblings, and no other subtree sees a move.

``grow`` adds a shard as a region of its own, with the weight of one shard. Only the
draws at the root gain an entry, so rows move into the new shard and nowhere else.

Everything is a column expression; assigning shards shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.words import fresh


@dataclass(frozen=True)
class Node:
    """A subtree: its name, its weight among its siblings and its children. A leaf is a shard."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def uniform_tree(regions: int = 4, racks: int = 2, shards: int = 5) -> Node:
    """``regions * racks * shards`` equal shards, numbered from 0 in the order of the tree."""
    number = iter(range(regions * racks * shards))
    tops = []
    for i in range(regions):
        mids = []
        for j in range(racks):
            leaves = tuple(Node(f"r{i}/k{j}/s{k}", 1.0, (), next(number)) for k in range(shards))
            mids.append(Node(f"r{i}/k{j}", float(shards), leaves))
        tops.append(Node(f"r{i}", float(racks * shards), tuple(mids)))
    return Node("", float(regions * racks * shards), tuple(tops))


def leaves(tree: Node) -> list[Node]:
    return [tree] if not tree.children else [x for child in tree.children for x in leaves(child)]


def depth(tree: Node) -> int:
    return 1 + max(depth(child) for child in tree.children) if tree.children else 0


def grow(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, as a region of its own."""
    shard = len(leaves(tree))
    return Node(tree.name, tree.weight + weight, (*tree.children, Node(f"x{shard}", weight, (), shard)))


def reweigh(tree: Node, name: str, weight: float) -> Node:
    """The tree with another weight at one node; the weights above stay, so keys move below its parent only."""
    return Node(
        tree.name,
        weight if tree.name == name else tree.weight,
        tuple(reweigh(child, name, weight) for child in tree.children),
        tree.shard,
    )


def draw(key: Column, child: Column, weight: Column) -> Column:
    """The smallest of these wins. 53 bits of the hash make the uniform number; weight 0 never wins against others."""
    u = (F.shiftrightunsigned(F.xxhash64(key, child), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.ln(u) / weight


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that ``key`` (as text; null counts as a key of its own) descends to."""
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    nodes: list[Node] = []

    def number(node: Node) -> None:
        nodes.append(node)
        for child in node.children:
            number(child)

    number(tree)
    place = {id(node): i for i, node in enumerate(nodes)}
    kind = "array<struct<name:string,weight:double,node:int>>"
    below = F.array(
        *[
            F.array(
                *[F.struct(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(place[id(c)]).alias("node")) for c in node.children]
            ).cast(kind)
            for node in nodes
        ]
    )

    def step(node: Column) -> Column:
        children = F.element_at(below, node + 1)
        drawn = F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node")))
        return F.coalesce(F.array_min(drawn)["node"], node)

    # one level a step, each over a let-binding, so that a level is computed once
    at = F.array(F.lit(0))
    for _ in range(depth(tree)):
        at = F.transform(at, step)
    return F.element_at(F.array(*[F.lit(node.shard) for node in nodes]), at[0] + 1)


def assign(df: DataFrame, tree: Node, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; an existing column ``out`` is replaced. Equal ids share a shard."""
    return df.withColumn(out, shard_of(F.col(id_col), tree))


def slots(df: DataFrame, keys: list[str], shard: str = "shard", out: str = "slot", chunk: int = 200_000) -> DataFrame:
    """Gapless numbers from 0 within each shard, for the columns ``keys``; other columns must follow from them.

    Every shard is cut by hash, into one part for each ``chunk`` rows of the whole table. Equal rows are counted
    before the shuffle, chunks are summed into offsets, each chunk is numbered on its
    own and equal rows are unfolded last, so no task holds a shard and no repeated row
    makes a task large. The order is that of the keys within the chunks. An existing column ``out`` is replaced.
    """
    kept, names = [c for c in df.columns if c != out], {}
    for name in ("_n", "_part", "_s", "_c", "_base", "_first", "_rows"):
        names[name] = fresh([*kept, *names.values()], name)
    n, part, s, c, base, first, rows = names.values()
    chunks = max(1, df.count() // chunk)
    cells = (
        df.groupBy(*kept)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(part, F.pmod(F.xxhash64(*keys, F.lit("slot")), F.lit(chunks)))
    )
    sums = cells.groupBy(shard, part).agg(F.sum(n).alias(rows))
    over = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(shard).alias(s), F.col(part).alias(c), F.coalesce(F.sum(rows).over(over), F.lit(0)).alias(base))
    within = Window.partitionBy(shard, part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cells.withColumn(first, F.coalesce(F.sum(n).over(within), F.lit(0)))
    placed = numbered.join(sums, (F.col(shard) == F.col(s)) & (F.col(part) == F.col(c)))
    start = F.col(base) + F.col(first)
    return placed.select(*kept, F.explode(F.sequence(start, start + F.col(n) - 1)).alias(out))
