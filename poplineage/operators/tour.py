"""Places along a tree without paths: subtree sizes, then preorder numbers, both by pointer doubling.

Every node points to its parent. A round replaces the pointers by those four times as far up and adds up what lies between: going up
the tree, a node's size is added to the nodes it points to; then the offsets of a node and of the nodes above it, each of them one more
than the sizes of the earlier siblings, are added up to its place. Rounds grow with the logarithm of the depth, rows with
the nodes, at any shape of the tree. The subtree of a node is the range from its own place to the last one inside it, and sums over
subtrees are differences of running sums.

Sizes are summed before they are shuffled. Nodes that look up the same node are the left side of a left join, which AQE splits; those
that point to the root look up nothing. Siblings are summed in chunks, so a parent of very many is no task of its own.

With ``keys`` every key has a tree of its own, and all trees are worked on in the same rounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import pin, pin_counted, small_table
from .ordered import CHUNK_BITS, numbered, running_sums

ROOT = 1
HOPS = 3


class BrokenTree(RuntimeError):
    """Some mutations cannot be reached from the root."""


def _look_up(rows: DataFrame, table: DataFrame, pointer: str, names: Mapping[str, str], root: int, keys: Sequence[str]) -> DataFrame:
    """Adds columns of the row of ``table`` that ``pointer`` names; a row that points to none is dropped.

    Rows that point nowhere, or to the root, look for a partner under their own number, which none has, and get nulls.
    """
    there, held = F.col(pointer), rows.columns
    over = there.isNull() | (there == root)
    marked = rows.select("*", F.when(over, F.col("node")).otherwise(there).alias("__key"), over.alias("__over"))
    ahead = table.select(
        *keys, F.col("node").alias("__key"), F.lit(False).alias("__over"), *[F.col(c).alias(out) for c, out in names.items()], F.lit(True).alias("__met")
    )
    joined = marked.join(ahead, [*keys, "__key", "__over"], "left").filter("__over or __met")
    return joined.select(*held, *names.values())


def _sizes(edges: DataFrame, roots: DataFrame, held: int, root: int, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys, node, size) of the nodes that are tied to the root, and how many of the ``held`` ones that are not roots."""
    table = edges.select(*keys, F.col("mutationId").alias("node"), F.col("parentMutationId").alias("up"))
    table = table.unionByName(roots.withColumn("up", F.lit(None).cast("long"))).withColumn("size", F.lit(1).cast("long"))
    open_, every = F.count("up").alias("open"), F.count_if(F.col("node") != root).alias("all")
    counted = {"open": held, "all": held}
    # Nodes still on the way after so many rounds are on a cycle, or below one.
    rounds = max(1, math.ceil(math.log(max(2, counted["all"]), HOPS + 1))) + 1
    pointers = [f"__up_{k}" for k in range(1, HOPS + 2)]
    while counted["open"] and rounds:
        rounds -= 1
        far = table.withColumnRenamed("up", pointers[0])
        for here, there in zip(pointers, pointers[1:]):
            far = _look_up(far, table, here, {"up": there}, root, keys)
        below = far.select(*keys, F.explode(F.array_compact(F.array(*pointers[:-1]))).alias("node"), "size")
        below = below.groupBy(*keys, "node").agg(F.sum("size").alias("__below"))
        grown = far.join(below, [*keys, "node"], "left")
        step = grown.select(*keys, "node", F.col(pointers[-1]).alias("up"), (F.col("size") + F.coalesce("__below", F.lit(0))).alias("size"))
        table, counted = pin_counted(step, "sizes", open_, every)
    return table.filter("up is null").select(*keys, "node", "size"), counted["all"] - counted["open"]


def _roots(edges: DataFrame, root: int, keys: Sequence[str]) -> DataFrame:
    number = F.lit(root).cast("long").alias("node")
    if keys:
        return edges.select(*keys).distinct().select(*keys, number)
    return edges.sparkSession.range(1).select(number)


def _places(offsets: DataFrame, root: int, keys: Sequence[str]) -> DataFrame:
    """(keys, node, pre, size, depth): offsets and levels added up along the way to the root."""
    open_ = F.count("up").alias("open")
    table, counted = pin_counted(offsets, "places", open_)
    sums = ("pre", "depth")
    while counted["open"]:
        far = table
        for k in range(HOPS):
            names = {"up": "__up", **{c: f"__{c}" for c in sums}}
            met = _look_up(far, table, "up", names, root, keys)
            added = [(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums]
            far = met.select(*keys, "node", F.col("__up").alias("up"), "size", *added)
        table, counted = pin_counted(far, "places", open_)
    return table


def tour(
    links: DataFrame,
    root: int = ROOT,
    keys: Sequence[str] = (),
    descending: bool = True,
    strict: bool = True,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """``keys, mutationId, pre, last, depth``: the place of every mutation in preorder, and the last place in its subtree.

    Siblings come by id, larger ids first with ``descending``. The root has place 0 and depth 0. A mutation has one
    row in ``links``. With ``strict`` mutations off the tree raise ``BrokenTree``; otherwise they have no row.
    """
    edges = links.select(*keys, "mutationId", "parentMutationId").filter(F.col("mutationId") != root)
    edges, held = pin_counted(edges, "edges", F.count(F.lit(1)).alias("all"))
    roots = pin(_roots(edges, root, keys), "roots") if keys else _roots(edges, root, keys)
    sizes, reached = _sizes(edges, roots, held["all"], root, keys)
    lost = held["all"] - reached
    if strict and lost > 0:
        raise BrokenTree(f"{lost} of {held['all']} mutations are not connected to {root}")
    # One row per node on both sides.
    named = edges.select(*keys, F.col("mutationId").alias("node"), F.col("parentMutationId").alias("up"))
    children = named.join(sizes, [*keys, "node"]).withColumn("__order", -F.col("node") if descending else F.col("node"))
    along = running_sums(children, {"__upto": F.col("size")}, "__order", [*keys, "up"], bits)
    one, nothing = F.lit(1).cast("long"), F.lit(0).cast("long")
    offsets = along.select(
        *keys,
        "node",
        F.when(F.col("up") != root, F.col("up")).alias("up"),
        "size",
        (F.col("__upto") - F.col("size") + 1).alias("pre"),
        one.alias("depth"),
    )
    tops = sizes.filter(F.col("node") == root).select(
        *keys, "node", F.lit(None).cast("long").alias("up"), "size", nothing.alias("pre"), nothing.alias("depth")
    )
    found = _places(offsets.unionByName(tops), root, keys)
    last = (F.col("pre") + F.col("size") - 1).alias("last")
    return found.select(*keys, F.col("node").alias("mutationId"), "pre", last, "depth")


def order_among(tree: DataFrame, kept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, mutationId, ordering``: dense places of the kept mutations only, in the order of the tour."""
    ids = small_table(kept.select(*keys, "mutationId").distinct(), "kept")
    return numbered(tree.join(ids, [*keys, "mutationId"]), ["pre"], "ordering", keys=keys).select(*keys, "mutationId", "ordering")


def subtree_sums(
    tree: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = (), bits: int = CHUNK_BITS
) -> DataFrame:
    """Adds, for each named value, its sum over the subtree of each row; ``tree`` has all rows of the tours.

    Rows written grow with the nodes, not with nodes times depth.
    """
    up_to = {f"__upto_{name}": value for name, value in values.items()}
    along = running_sums(tree.withColumns(dict(values)), up_to, "pre", keys, bits)
    along = pin(along, "running")
    # Many nodes can end at one place, all of a chain do: they are the left side, the places are unique.
    ends = along.select(*keys, F.col("pre").alias("last"), *[F.col(c).alias(f"{c}_end") for c in up_to])
    joined = along.join(ends, [*keys, "last"], "left")
    sums = {name: F.col(f"__upto_{name}_end") - F.col(f"__upto_{name}") + F.col(name) for name in values}
    return joined.withColumns(sums).drop(*up_to, *[f"{c}_end" for c in up_to])
