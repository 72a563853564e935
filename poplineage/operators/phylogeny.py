"""The mutation tree: its edges, the path of every mutation from the root, sums over subtrees.

With ``keys`` (the run, say) every key has a tree of its own; ids then are ids within a key, and all trees are built in the
same rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bucketed, pin, pin_counted, scratch_path, write_counted
from ..schemas import PARAMS
from .tour import ROOT, BrokenTree, subtree_sums

PATH_SCHEMA = "mutationId bigint, ancestors array<bigint>"
PATH_COLUMNS = ("mutationId", "ancestors")


def mutation_tree(chronicles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each mutation with the mutation of the parent particle at its first appearance.

    Of several appearances the earliest by birth, then by ids, is kept.
    """
    children = chronicles.select(*keys, "birthTime", "particleId", "parentId", "mutationId", "cellParams")
    parents = chronicles.select(
        *keys, F.col("particleId").alias("parentId"), F.col("mutationId").alias("parentMutationId")
    )
    # No particle has id 0, and it can be the parent of very many: those rows need no partner.
    rootless = F.col("parentId") == 0
    joined = children.filter(~rootless).join(parents, [*keys, "parentId"], "left")
    pairs = joined.unionByName(
        children.filter(rootless).withColumn("parentMutationId", F.lit(None).cast("long"))
    )
    branches = pairs.na.fill(0, ["birthTime", "mutationId", "parentMutationId"]).filter(
        F.col("mutationId") != F.col("parentMutationId")
    )
    order = F.struct("birthTime", "particleId", "parentId", "parentMutationId")
    first = F.min_by(F.struct("cellParams", "parentMutationId", F.col("birthTime").alias("time")), order)
    return branches.groupBy(*keys, "mutationId").agg(first.alias("__first")).select(*keys, "mutationId", "__first.*")


def lineages(
    links: DataFrame, root: int = ROOT, method: str = "doubling", strict: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """Path from the root to every mutation: ``keys, mutationId, ancestors``.

    ``doubling`` joins paths to paths, so its rounds grow with the logarithm of the depth;
    ``levels`` adds one level per round. With ``strict`` a mutation off the tree raises
    ``BrokenTree``; otherwise such mutations have no row.
    """
    edges = links.select(*keys, "mutationId", "parentMutationId").filter(F.col("mutationId") != root)
    build: dict[str, Callable] = {"doubling": _by_doubling, "levels": _by_levels}
    edges, counted = pin_counted(edges, "edges", F.count(F.lit(1)).alias("all"))
    return build[method](edges, counted["all"], root, strict, list(keys))


def _root_rows(edges: DataFrame, root: int, keys: Sequence[str]) -> DataFrame:
    number = F.lit(root).cast("long")
    rows = edges.select(*keys).distinct() if keys else edges.sparkSession.range(1)
    return rows.select(*keys, number.alias("mutationId"), F.array(number).alias("ancestors"))


def _by_levels(edges: DataFrame, total: int, root: int, strict: bool, keys: list[str]) -> DataFrame:
    """Each level is added to one folder, which is read as one table in the end.

    The edges lie in buckets by parent, so that a round moves the frontier alone.
    """
    spark, path, step = edges.sparkSession, scratch_path(edges.sparkSession, "levels"), _root_rows(edges, root, keys)
    schema, reached, depth = step.schema, 0, 0
    with bucketed(edges, [*keys, "parentMutationId"]) as held:
        while True:
            depth += 1
            place = f"{path}/level={depth}"
            size = write_counted(step, place)
            if depth == 1:  # the roots, which have no edge
                total += size
            reached += size
            if size == 0 or reached >= total:
                break
            step = next_level(held, spark.read.schema(schema).parquet(place), keys)
    if strict and reached < total:
        raise BrokenTree(f"{total - reached} of {total} mutations are not connected to {root}")
    return spark.read.schema(schema).parquet(path).select(*keys, *PATH_COLUMNS)


def next_level(edges: DataFrame, frontier: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Paths of the children of the mutations in ``frontier``."""
    parents = frontier.withColumnRenamed("mutationId", "parentMutationId")
    joined = edges.join(parents, [*keys, "parentMutationId"])
    return joined.select(*keys, "mutationId", F.array_append("ancestors", F.col("mutationId")).alias("ancestors"))


def _by_doubling(edges: DataFrame, total: int, root: int, strict: bool, keys: list[str]) -> DataFrame:
    # head: the parent of the first mutation on the path; the path is whole when it is null.
    whole = [pin(_root_rows(edges, root, keys).withColumn("head", F.lit(None).cast("long")), "paths")]
    open_ = edges.select(
        *keys, "mutationId", F.array("mutationId").alias("ancestors"), F.col("parentMutationId").alias("head")
    )
    lost, at_head = 0, [*keys, "head"]
    while True:
        known = functools.reduce(DataFrame.unionByName, [*whole, open_])
        heads = known.select(
            *keys, F.col("mutationId").alias("head"), F.col("ancestors").alias("__up"), F.col("head").alias("__next")
        )
        # Only paths that some open path goes on with are moved.
        wanted = open_.select(*at_head).distinct()
        longer = open_.join(heads.join(wanted, at_head, "left_semi"), at_head, "left")
        path = F.concat("__up", "ancestors")
        # Orphans meet no head; a path on a cycle comes back to its own head before it is twice as long as the cycle.
        off = F.col("__up").isNull() | F.coalesce(F.array_contains(path, F.col("__next")), F.lit(False))
        moved = longer.select(
            *keys, "mutationId", F.when(~off, path).alias("ancestors"), F.when(~off, F.col("__next")).alias("head")
        )
        counts = F.count_if(F.col("ancestors").isNull()).alias("lost"), F.count("head").alias("open")
        step, held = pin_counted(moved, "paths", *counts)
        # A path that was lost is null; one that met a lost path is lost in the next round.
        whole.append(step.filter(F.col("ancestors").isNotNull() & F.col("head").isNull()))
        open_ = step.filter(F.col("head").isNotNull())
        lost += held["lost"]
        if held["open"] == 0:
            break
    found = functools.reduce(DataFrame.unionByName, whole).select(*keys, *PATH_COLUMNS)
    if strict and lost:
        raise BrokenTree(f"{lost} of {total} mutations are not connected to {root}")
    return found


def disconnected(links: DataFrame, root: int = ROOT) -> DataFrame:
    """Edges whose mutation cannot be reached from the root: orphans, cycles and what hangs on them."""
    return links.join(lineages(links, root, strict=False), "mutationId", "left_anti")


def wanted_links(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``parents`` on the way up from ``ids``, and no others.

    Jump tables of two numbers a row are made for all mutations: who is 1, 2, 4, … steps up. A table holds those with so
    many ancestors only. From the longest jump down, the wanted set then takes in what it reaches by each.
    """
    node, up = F.col("mutationId"), F.col("__up")
    links = parents.select("mutationId", "parentMutationId").filter(node != 0)
    links, counted = pin_counted(links, "edges", F.count(F.lit(1)).alias("all"))
    jumps = [links.select("mutationId", F.col("parentMutationId").alias("__up"))]
    for _ in range(max(1, counted["all"]).bit_length()):  # on a cycle jumps go on for ever
        last = jumps[-1]
        ahead = last.select(node.alias("__up"), up.alias("__next"))
        longer, held = pin_counted(
            last.join(ahead, "__up").select("mutationId", F.col("__next").alias("__up")), "jumps", F.count(F.lit(1)).alias("all")
        )
        if not held["all"]:
            break
        jumps.append(longer)
    wanted = ids.select("mutationId").distinct()
    for jump in reversed(jumps):
        both = wanted.join(jump, "mutationId", "left").select(F.explode(F.array_compact(F.array(node, up))).alias("mutationId"))
        wanted = both.distinct()
    return links.join(pin(wanted, "wanted"), "mutationId", "left_semi")


def ancestry_of(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """Path of each requested mutation, walked up the parent table to parent 0.

    Every mutation with parent 0 starts a tree of its own. Paths are put together for the ids asked for and what is
    above them only.
    """
    links = wanted_links(ids, parents)
    top = F.lit(0).cast("long")
    paths = lineages(links, root=0, strict=False)
    wanted = ids.select("mutationId").distinct().join(paths, "mutationId", "left")
    missing = F.raise_error(F.lit("a requested mutation has no path to parent 0")).cast("array<bigint>")
    path = F.when(F.col("ancestors").isNull(), missing).otherwise(F.array_remove("ancestors", top))
    return wanted.select("mutationId", path.alias("ancestors"))


def subtree_counts(clones: DataFrame, tree: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``tree`` (a tour) with ``typeCount`` and ``mutationCount``: a mutation's own living cells, and those of its subtree.

    ``clones`` counts the rows of ``clones`` in the subtree.
    """
    own = clones.groupBy(*keys, "mutationId").agg(F.sum("count").alias("typeCount"), F.count(F.lit(1)).alias("__rows"))
    placed = tree.join(own, [*keys, "mutationId"], "left").na.fill(0, ["typeCount", "__rows"])
    return subtree_sums(placed, {"mutationCount": F.col("typeCount"), "clones": F.col("__rows")}, keys).drop("__rows")


def mutation_frequency(clones: DataFrame, tree: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Living cells that carry each mutation: its own and those of all its descendants."""
    counted = subtree_counts(clones, tree, keys).filter(F.col("clones") > 0)
    return counted.select(*keys, F.col("mutationId").alias("ancestorMutationId"), "mutationCount")


def parameter_changes(mutations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each mutation with its waiting time and parameter changes since its parent."""
    parents = mutations.select(
        *keys,
        F.col("mutationId").alias("parentMutationId"),
        F.col("cellParams").alias("__params"),
        F.col("time").alias("__time"),
    )
    child = mutations.join(parents, [*keys, "parentMutationId"], "left").na.fill(0, ["time", "__time"])
    changes = [(F.col(f"cellParams.{p}") - F.col(f"__params.{p}")).alias(p) for p in PARAMS]
    return child.select(
        *keys,
        "mutationId",
        "cellParams",
        "time",
        (F.col("time") - F.greatest(F.lit(0.0), F.col("__time"))).alias("waitingTime"),
        F.struct(*changes).alias("parameterUpgrades"),
    )


def mutation_summary(
    paths: DataFrame, tree: DataFrame, clones: DataFrame, mutations: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Own cells, cells of the subtree, ancestors, times and parameter changes of every mutation.

    Counts come from the tour ``tree``; the paths are joined because the result shows them.
    """
    same = [*keys, "mutationId"]
    counts = subtree_counts(clones, tree, keys).select(*same, "typeCount", "mutationCount")
    joined = counts.join(paths, same).join(parameter_changes(mutations, keys), same)
    return joined.select(
        *same,
        "cellParams",
        "typeCount",
        "mutationCount",
        "ancestors",
        "time",
        "waitingTime",
        "parameterUpgrades",
    )
