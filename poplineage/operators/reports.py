"""Tables behind the reports on the mutation tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_ABOVE = 100_000


def tree_edges(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parent and child of every mutation but the roots."""
    child = summary.filter(F.size("ancestors") > 1)
    return child.select(*keys, F.element_at("ancestors", -2).alias("parentMutationId"), "mutationId")


def tree_roots(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return summary.filter(F.size("ancestors") == 1).select(*keys, "mutationId")


def tree_vertices(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mutations with the size they are drawn in: the fourth root of their own cells plus one."""
    size = F.pow(F.col("typeCount") + 1, F.lit(0.25))
    return summary.select(*keys, "mutationId", "typeCount", "mutationCount", size.alias("size"))


def subtree_over(
    summary: DataFrame, count: int = SHOWN_ABOVE, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Vertices carried by more than ``count`` cells, and the edges between them."""
    vertices = tree_vertices(summary, keys).filter(F.col("mutationCount") > count)
    ids = vertices.select(*keys, "mutationId")
    edges = tree_edges(summary, keys).join(ids, [*keys, "mutationId"], "left_semi")
    parents = ids.withColumnRenamed("mutationId", "parentMutationId")
    return vertices, edges.join(parents, [*keys, "parentMutationId"], "left_semi")
