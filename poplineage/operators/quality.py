"""Data-quality checks: each gives the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import CREATED, REMOVED, TRANSFORMED
from .ordered import CHUNK_BITS, ahead, with_neighbours


def sequence_anomalies(
    events: DataFrame,
    initial: DataFrame | None = None,
    keys: Sequence[str] = (),
    bits: int = CHUNK_BITS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Events that cannot follow what came before at their position.

    Codes: ``first_removed`` and ``first_transformed`` where nothing was there yet,
    ``created_again`` where something already was, ``unexpected_kind`` for other kinds.
    """
    rows = events if initial is None else initial.unionByName(events, allowMissingColumns=True)
    seen = with_neighbours(
        rows, [*keys, "position"], "ord", previous={"seen": F.lit(True)}, bits=bits, hot=hot
    )
    kind, first = F.col("eventKind.encoded"), F.col("seen").isNull()
    code = (
        F.when(first & (kind == REMOVED), "first_removed")
        .when(first & (kind == TRANSFORMED), "first_transformed")
        .when(~first & (kind == CREATED), "created_again")
        .when(~kind.isin(CREATED, REMOVED, TRANSFORMED), "unexpected_kind")
    )
    return seen.withColumn("anomaly", code).filter(F.col("anomaly").isNotNull()).drop("seen")


def repeated_particles(chronicles: DataFrame) -> DataFrame:
    """Particles that several offspring rows of one event have multiplied."""
    counts = chronicles.groupBy("particleId").agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") > 1)


def unsorted_neighbours(df: DataFrame, column: str, order: str, bits: int = CHUNK_BITS) -> DataFrame:
    """Rows whose value is below that of the row before; none if the table is sorted.

    Two neighbouring chunks are compared through their last and first rows.
    """
    chunk = F.shiftright(F.col(order), bits)
    inside = Window.partitionBy("__chunk").orderBy(order)
    local = df.withColumn("__chunk", chunk).withColumn("__before", F.lag(column).over(inside))
    ends = local.groupBy("__chunk").agg(F.max_by(F.struct(F.col(column).alias("value")), order).alias("end"))
    carried = ahead(ends, lasts=["end"], bits=bits)
    first = F.row_number().over(inside) == 1
    joined = local.withColumn("__first", first).join(carried, "__chunk", "left")
    before = F.when(F.col("__first"), F.col("__before_end.value")).otherwise(F.col("__before"))
    return joined.filter(F.col(column) < before).drop("__chunk", "__before", "__first", "__before_end")
