"""The population at chosen time points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import INDEX, START, STOP, TimeGrid
from ..runtime import small_side
from ..schemas import AXES, PARAM_COLUMNS, PARAMS
from .chronicles import PLUS_INF, cells_of
from .timepoints import KeyedGrids, PointTable

Grid = TimeGrid | KeyedGrids | PointTable


def max_time(chronicles: DataFrame) -> float | None:
    """Time of the last birth; None for an empty table."""
    return chronicles.agg(F.max("birthTime")).first()[0]


def time_grid(chronicles: DataFrame, whole: bool = False) -> TimeGrid:
    """The grid up to the last birth: with that birth as its last point, or of whole numbers only."""
    last = max_time(chronicles)
    if last is None:
        raise ValueError("no lifetimes, so no time points")
    return TimeGrid(last, whole=whole)


def time_points(chronicles: DataFrame) -> DataFrame:
    """0, 1, 2, … below the last birth, then the last birth itself, as one sorted column ``value``."""
    grid = time_grid(chronicles)
    points = chronicles.sparkSession.range(grid.size)
    return points.select(grid.point(F.col("id")).alias("value")).orderBy("value")


def snapshot_at(chronicles: DataFrame, time: float) -> DataFrame:
    """Cells alive at ``time``: birth <= time < death."""
    alive = (F.col("birthTime") <= F.lit(time)) & (F.lit(time) < F.col("deathTime"))
    return cells_of(chronicles.filter(alive))


def cells_by_time(chronicles: DataFrame, grid: Grid, bounds: str = "half_open") -> DataFrame:
    """Each lifetime once for every time point inside it."""
    steps = F.explode(F.sequence(START, F.col(STOP) - 1))
    return grid.at_points(grid.spans(chronicles, bounds).withColumn(INDEX, steps).drop(START, STOP), bounds)


def earliest_params() -> Column:
    """Parameters of a group's first particle in log order.

    Field by field, so that the buffers stay fixed in size and Spark aggregates by hash.
    Rows that share a particle id are copies of one particle and share its parameters.
    """
    return F.struct(*[F.min_by(f"cellParams.{p}", "particleId").alias(p) for p in PARAMS])


def clone_snapshot(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells per mutation, with the parameters that the mutation has."""
    return cells.groupBy(*keys, "mutationId").agg(
        F.count(F.lit(1)).alias("count"),
        F.struct(*[F.any_value(f"cellParams.{p}").alias(p) for p in PARAMS]).alias("cellParams"),
    )


def clone_snapshots(
    chronicles: DataFrame,
    grid: Grid,
    bounds: str = "half_open",
    method: str = "delta",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Living cells per mutation and time point; mutations without any at a point have no row there.

    ``explode`` counts each lifetime at every point inside it. ``delta`` counts it twice, where it
    begins and where it ends, and adds up along time, so its work does not grow with the number
    of points. Parameters are those of the first particle of the mutation at the point (explode) or
    of the mutation (delta), which is the same where all its cells share them.
    """
    if method == "explode":
        rows = cells_by_time(chronicles, grid, bounds)
        return rows.groupBy(*keys, "mutationId", "timePoint").agg(
            F.count(F.lit(1)).alias("count"), earliest_params().alias("cellParams")
        )
    if method != "delta":
        raise ValueError(f"unknown method {method!r}")
    clone = [*keys, "mutationId"]
    moves = F.array(
        F.struct(F.col(START).alias("index"), F.lit(1).cast("long").alias("change")),
        F.struct(F.col(STOP).alias("index"), F.lit(-1).cast("long").alias("change")),
    )
    changes = (
        grid.spans(chronicles, bounds)
        .select(*clone, "particleId", "cellParams", F.explode(moves).alias("move"))
        .groupBy(*clone, "move.index")
        .agg(F.sum("move.change").alias("change"), earliest_params().alias("params"))
    )
    # At most one row per clone and time point is left to the windows. All lifetimes are closed, so nobody is left after the last change.
    along = Window.partitionBy(*clone).orderBy("index")
    spans = changes.select(
        *clone,
        F.sum("change").over(along).alias("count"),
        F.first("params").over(along).alias("cellParams"),
        "index",
        F.lead("index").over(along).alias("next"),
    ).filter((F.col("count") > 0) & (F.col("index") < F.col("next")))
    points = F.explode(F.sequence("index", F.col("next") - 1)).alias(INDEX)
    rows = grid.at_points(spans.select(*clone, "count", "cellParams", points), bounds)
    return rows.select(*clone, "timePoint", "count", "cellParams")


def mutation_snapshots(snapshots: DataFrame) -> DataFrame:
    """Cells per time point and mutation from exploded lifetimes, parameters as plain columns."""
    params = [F.min_by(f"cellParams.{p}", "particleId").alias(c) for p, c in zip(PARAMS, PARAM_COLUMNS)]
    return snapshots.groupBy("timePoint", "mutationId").agg(F.count(F.lit(1)).alias("count"), *params)


def living(chronicles: DataFrame) -> DataFrame:
    """Lifetimes without an end."""
    return chronicles.filter(F.col("deathTime") == PLUS_INF)


def clones_at_last(snapshots: DataFrame, lasts: DataFrame, keys: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """Clone counts of each key at its own last time point, which ``lasts`` has as ``value``."""
    joined = snapshots.join(small_side(lasts.select(*keys, F.col("value").alias("__last"))), list(keys))
    return joined.filter(F.abs(F.col("timePoint") - F.col("__last")) < tolerance).drop("timePoint", "__last")


def final_clone_snapshot(chronicles: DataFrame) -> DataFrame:
    """Never-ended lifetimes per mutation."""
    rows = living(chronicles)
    return rows.groupBy("mutationId").agg(
        F.count(F.lit(1)).alias("count"), earliest_params().alias("cellParams")
    )


def final_cells(chronicles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Never-ended lifetimes as plain columns."""
    return living(chronicles).select(
        *keys, *[f"position.{a}" for a in AXES], "mutationId", *[f"cellParams.{p}" for p in PARAMS]
    )


def clones_at(snapshots: DataFrame, time: float, tolerance: float = 1e-3) -> DataFrame:
    """Clone counts at one time point, matched within a tolerance."""
    return snapshots.filter(F.abs(F.col("timePoint") - time) < tolerance).drop("timePoint")
