"""Lifetimes and parents of particles, rebuilt from grouped events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import CREATED, REMOVED
from ..runtime import pin
from ..schemas import CHRONICLE
from .events import event_groups, initial_events, initial_size, numbered_cells
from .ordered import CHUNK_BITS, hot_groups, with_neighbours

PLUS_INF = float("inf")


def linear_chronicles(
    grouped: DataFrame,
    initial: DataFrame | None = None,
    keys: Sequence[str] = (),
    parent_rule: str = "previous_row",
    bits: int = CHUNK_BITS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row per lifetime at a position: who was there before, and when the next event came.

    ``particleId`` counts initial cells from 1 and goes on in log order. With ``parent_rule``
    ``previous_row`` the parent is the row before at the position, a removed one included;
    with ``kind_aware`` a CREATED row never takes it.
    """
    if parent_rule not in ("previous_row", "kind_aware"):
        raise ValueError(f"unknown parent rule {parent_rule!r}")
    cells = None if initial is None else numbered_cells(initial, keys)
    first_id = initial_size(cells) + 1
    rows = grouped if cells is None else initial_events(cells).unionByName(grouped)
    rows = rows.withColumn("particleId", F.col("ord") + first_id)
    linked = with_neighbours(
        rows,
        [*keys, "position"],
        "ord",
        previous={"parentId": F.col("particleId")},
        following={"deathTime": F.col("time")},
        bits=bits,
        hot=hot,
    )
    kind = F.col("eventKind.encoded")
    if parent_rule == "kind_aware":
        linked = linked.withColumn("parentId", F.when(kind != CREATED, F.col("parentId")))
    return (
        linked.withColumn("deathTime", F.coalesce("deathTime", F.lit(PLUS_INF)))
        .filter(kind != REMOVED)
        .withColumnRenamed("time", "birthTime")
    )


def split_by_parent(linear: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offspring (a parent is known) and settlers (it is not)."""
    has_parent = F.col("parentId").isNotNull()
    return linear.filter(has_parent), linear.filter(~has_parent).drop("parentId")


def resolve_parents(linear: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chronicles: a settler descends from the parent of the offspring row in its own event.

    An event with several offspring rows repeats its settlers once for each; one without any
    leaves them with parent 0. Pass a pinned table: it is read three times.
    """
    offspring, settlers = split_by_parent(linear)
    step = [*keys, "eventId"]
    settled = settlers.join(offspring.select(*step, "parentId"), step, "left")
    columns = [*keys, *CHRONICLE.names]
    rows = settled.select(*columns).unionByName(offspring.select(*columns))
    return rows.withColumn("parentId", F.coalesce("parentId", F.lit(0).cast("long")))


def chronicles(
    events: DataFrame,
    initial: DataFrame | None = None,
    keys: Sequence[str] = (),
    strict: bool = False,
    parent_rule: str = "previous_row",
    bits: int = CHUNK_BITS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """From ordered events to lifetimes with parents."""
    if hot is None:
        # Found here, where it costs one pass over the positions and no grouping.
        hot = hot_groups(events, [*keys, "position"], bits)
    grouped = event_groups(events, keys, strict, bits)
    linear = linear_chronicles(grouped, initial, keys, parent_rule, bits, hot)
    needed = [*keys, "eventId", *CHRONICLE.names]
    return resolve_parents(pin(linear.select(*needed), "linear"), keys)


def cells_of(rows: DataFrame) -> DataFrame:
    """The cell that each lifetime belongs to."""
    return rows.select("position", "mutationId", "cellParams")
