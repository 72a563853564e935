"""Cell events: nesting of log rows, the initial configuration, events of one simulator step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import CREATED
from ..schemas import AXES, CELL_PARAMS, EVENT_LOG, PARAM_COLUMNS, PARAMS
from .ordered import CHUNK_BITS, chunk_of, few_groups, numbered, one_window

# The configuration every run starts from unless a file is given.
START_MUTATION = 1
START_HALF_WIDTH = 2
START_PARAMS = (0.1, 0.5, 0.1, 0.5, 0.9, 0.5)

MINUS_INF = float("-inf")


def to_events(log: DataFrame) -> DataFrame:
    """Flat log rows as nested events; columns that are not part of the log pass through."""
    extra = [c for c in log.columns if c not in EVENT_LOG.names]
    return log.select(
        *extra,
        F.col("event_time").alias("time"),
        F.col("event_time_delta").alias("timeDelta"),
        F.struct(F.col("event_kind").alias("encoded")).alias("eventKind"),
        F.struct(*[F.col(f"position_{i}").alias(a) for i, a in enumerate(AXES)]).alias("position"),
        F.col("mutation_id").alias("mutationId"),
        F.struct(*[F.col(c).alias(p) for c, p in zip(PARAM_COLUMNS, PARAMS)]).alias("cellParams"),
    )


def log_columns(log: DataFrame) -> DataFrame:
    """The 14 columns of the log that lifetimes are built from, in the order of the initial file."""
    return log.select(
        *[F.col(f"position_{i}").alias(a) for i, a in enumerate(AXES)],
        F.col("event_time").alias("time"),
        F.col("event_time_delta").alias("delta_time"),
        "event_kind",
        "mutation_id",
        *PARAM_COLUMNS,
        *[c for c in log.columns if c not in EVENT_LOG.names],
    )


def starting_snapshot(spark: SparkSession, runs: DataFrame | None = None) -> DataFrame:
    """A cube of cells around the origin, all of the first mutation, with order numbers below 0; one for each row of ``runs``."""
    side = 2 * START_HALF_WIDTH + 1
    cell, keys = F.col("id"), [] if runs is None else runs.columns
    rows = spark.range(side**3) if runs is None else runs.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(side**3 - 1)).cast("array<bigint>")))
    axes = [F.floor(cell / side**2), F.floor(cell / side) % side, cell % side]
    params = [F.lit(v).cast("float").alias(p) for v, p in zip(START_PARAMS, PARAMS)]
    return rows.select(
        *keys,
        (cell - side**3).alias("ord"),
        F.struct(*[(v - START_HALF_WIDTH).cast("float").alias(a) for v, a in zip(axes, AXES)]).alias("position"),
        F.lit(START_MUTATION).cast("long").alias("mutationId"),
        F.struct(*params).alias("cellParams"),
    )


def cells_from_initial_file(rows: DataFrame) -> DataFrame:
    """Rows of an initial-configuration file as cells."""
    params = F.struct(*[F.col(c).alias(p) for c, p in zip(PARAM_COLUMNS, PARAMS)])
    return rows.select(
        F.struct(*AXES).alias("position"),
        F.col("mutation_id").alias("mutationId"),
        params.cast(CELL_PARAMS).alias("cellParams"),
    )


def numbered_cells(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gives initial cells the order numbers -n … -1, ahead of every log row; n is the largest number of cells of a key."""
    if "ord" in cells.columns:
        return cells
    ranked = numbered(cells, ["position", "mutationId"], "ord", keys=keys)
    return ranked.withColumn("ord", F.col("ord") - 1 - (ranked.agg(F.max("ord")).first()[0] or 0))


def initial_size(cells: DataFrame | None) -> int:
    """How many order numbers below 0 the initial cells take."""
    if cells is None:
        return 0
    return -(cells.agg(F.min("ord")).first()[0] or 0)


def initial_events(cells: DataFrame) -> DataFrame:
    """Initial cells as events that happened before all time, in event 0."""
    cells = numbered_cells(cells)
    return cells.withColumns(
        {
            "time": F.lit(MINUS_INF),
            "timeDelta": (F.col("ord") + initial_size(cells)).cast("int"),
            "eventKind": F.struct(F.lit(CREATED).alias("encoded")),
            "eventId": F.lit(0).cast("long"),
        }
    )


def event_groups(
    events: DataFrame,
    keys: Sequence[str] = (),
    strict: bool = False,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Adds ``eventId``: it rises at each row whose time delta does not fall below the previous one.

    The first row is compared with delta 0. With ``strict`` a new event needs a delta above the
    previous one, so that neighbouring events of one row each with equal deltas merge.
    Needs the order number ``ord``.
    """
    def starts(delta, before):
        return (delta > before if strict else delta >= before).cast("long")

    parts = [*keys, "__chunk"]
    inside = Window.partitionBy(*parts).orderBy("ord")
    delta = F.col("timeDelta")
    local = events.withColumn("__chunk", chunk_of("ord", bits)).withColumn(
        "__rise", F.coalesce(starts(delta, F.lag(delta).over(inside)), F.lit(0))
    )
    local = local.withColumn("eventId", F.sum("__rise").over(inside))
    # One row per chunk: its first and last delta and the events that start inside it.
    ends = local.groupBy(*parts).agg(
        F.min_by(delta, "ord").alias("__first"),
        F.max_by(delta, "ord").alias("__last"),
        F.max("eventId").alias("__inner"),
    )
    # Chunks are joined in groups, and one row per group in the same way.
    chunk, group = "__chunk", "__group"
    inside = Window.partitionBy(*keys, group).orderBy(chunk)
    ends = ends.withColumn(group, F.shiftright(chunk, bits))
    ends = ends.withColumn("__entry", F.coalesce(starts(F.col("__first"), F.lag("__last").over(inside)), F.lit(0)))
    rises = F.sum(F.col("__entry") + F.col("__inner")).over(inside)
    ends = ends.withColumn("__inside", rises - F.col("__inner"))
    groups = ends.groupBy(*keys, group).agg(
        F.min_by("__first", chunk).alias("__first"),
        F.max_by("__last", chunk).alias("__last"),
        F.sum(F.col("__entry") + F.col("__inner")).alias("__inner"),
    )
    along = Window.partitionBy(*keys, one_window()).orderBy(group)
    groups = groups.withColumn("__entry", starts(F.col("__first"), F.lag("__last", 1, 0).over(along)))
    rises = F.sum(F.col("__entry") + F.col("__inner")).over(along)
    groups = groups.select(*keys, group, (rises - F.col("__inner")).alias("__outside"))
    offsets = ends.join(few_groups(groups, keys), [*keys, group], "left").select(*parts, (F.col("__inside") + F.col("__outside")).alias("__before"))
    joined = local.join(offsets, parts, "left")
    return joined.withColumn("eventId", F.col("eventId") + F.col("__before")).drop(
        "__chunk", "__rise", "__before"
    )
