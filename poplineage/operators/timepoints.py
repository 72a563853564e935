"""Grids of time points that are data: a grid of its own for each key, or a table of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import INDEX, START, STOP, TimeGrid
from ..runtime import pin, pin_counted, small_table
from .ordered import CHUNK_BITS, numbered, running_sums

LAST = "__last_point"


class KeyedGrids:
    """For each key the time grid up to its own last birth."""

    def __init__(self, lifetimes: DataFrame, keys: Sequence[str], whole: bool = False):
        self.keys = list(keys)
        last = lifetimes.groupBy(*keys).agg(F.max("birthTime").alias(LAST))
        # One row per key, broadcast if they are counted to be few.
        self.lasts = small_table(last, "last-points")
        self.grid = TimeGrid(F.col(LAST), whole=whole)

    def spans(self, lifetimes: DataFrame, bounds: str = "half_open") -> DataFrame:
        return self.grid.spans(lifetimes.join(self.lasts, self.keys), bounds).drop(LAST)

    def at_points(self, rows: DataFrame, bounds: str = "half_open") -> DataFrame:
        return self.grid.at_points(rows.join(self.lasts, self.keys), bounds).drop(LAST)

    def points(self) -> DataFrame:
        """``keys, value``: all time points of every key."""
        steps = F.explode(F.sequence(F.lit(0).cast("long"), self.grid.size - 1))
        return self.lasts.select(*self.keys, LAST, steps.alias(INDEX)).select(*self.keys, self.grid.point(F.col(INDEX)).alias("value"))


class PointTable:
    """Time points from the column ``value`` of a table; nulls and repeats are left out.

    Points are numbered in order and laid into equal cells of time, about ``CELL`` points each. A time finds its cell by
    arithmetic, the cell's row by an equi-join, and its place among the cell's points by bisection, so a look-up takes as many steps as
    the fullest cell has binary digits, however many points there are.
    """

    CELL = 32

    def __init__(self, points: DataFrame, bits: int = CHUNK_BITS):
        value = F.col("value").cast("double")
        given = points.select(value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value")).distinct()
        self.points = pin(numbered(given, ["value"], INDEX), "points")
        finite = F.when(F.abs("value") < float("inf"), F.col("value"))
        bounds = self.points.agg(F.min(finite), F.max(finite), F.count(F.lit(1))).first()
        self.size = bounds[2]
        self.low, high = bounds[0] or 0.0, bounds[1] or 0.0
        self.cells = max(1, self.size // self.CELL)
        self.width = (high - self.low) / self.cells or 1.0
        held = self.points.groupBy(self._cell(F.col("value")).alias("__cell")).agg(F.array_sort(F.collect_list("value")).alias("__points"))
        every = points.sparkSession.range(self.cells).select(F.col("id").alias("__cell")).join(held, "__cell", "left")
        inside = F.coalesce(F.size("__points"), F.lit(0)).cast("long")
        counted = running_sums(every, {"__upto": inside}, "__cell", bits=bits)
        table, most = pin_counted(
            counted.select("__cell", "__points", (F.col("__upto") - inside).alias("__before")), "cells", F.max(F.size("__points")).alias("most")
        )
        self.steps = max(1, most["most"] or 0).bit_length()
        self.table = F.broadcast(table) if self.size <= 200_000 else table

    def _cell(self, time: Column) -> Column:
        """Times before the first cell are in it, and those behind the last one in that."""
        at = F.floor((time - F.lit(self.low)) / F.lit(self.width)).cast("long")
        return F.greatest(F.least(at, F.lit(self.cells - 1).cast("long")), F.lit(0).cast("long"))

    def _below(self, time: Column, closed: bool) -> Column:
        """How many points are before ``time``, or at it too with ``closed``."""
        n = F.coalesce(F.size("__points"), F.lit(0))

        def halve(held: Column, _: Column) -> Column:
            low, high = held["low"], held["high"]
            middle = F.shiftright(low + high, 1)
            value = F.get("__points", middle)
            less = value <= time if closed else value < time
            open_ = low < high
            return F.struct(
                F.when(open_ & less, middle + 1).otherwise(low).alias("low"),
                F.when(open_ & ~less, middle).otherwise(high).alias("high"),
            )

        start = F.struct(F.lit(0).alias("low"), n.alias("high"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), start, halve)
        return F.col("__before") + found["low"]

    def _placed(self, rows: DataFrame, time: str, out: str, closed: bool = False) -> DataFrame:
        """Adds the number of points below ``time``; the lifetimes are the left side, which AQE splits if a cell is hot."""
        joined = rows.withColumn("__cell", self._cell(F.col(time))).join(self.table, "__cell", "left")
        return joined.withColumn(out, self._below(F.col(time), closed)).drop("__cell", "__points", "__before")

    def spans(self, lifetimes: DataFrame, bounds: str = "half_open") -> DataFrame:
        if bounds not in ("half_open", "open"):
            raise ValueError(f"unknown bounds {bounds!r}")
        placed = self._placed(lifetimes, "birthTime", START, closed=bounds == "open")
        return self._placed(placed, "deathTime", STOP).filter(F.col(START) < F.col(STOP))

    def at_points(self, rows: DataFrame, bounds: str = "half_open") -> DataFrame:
        points = self.points.select(INDEX, F.col("value").alias("timePoint"))
        points = F.broadcast(points) if self.size <= 200_000 else points
        return rows.join(points, INDEX).drop(INDEX)
