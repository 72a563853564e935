"""Time points and the lifetimes that cover them.

A grid says which of its points, by index, a lifetime covers (``spans``), and turns indices into points (``at_points``).
"""

from __future__ import annotations

from dataclasses import dataclass
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, INDEX = "__start", "__stop", "__index"


@dataclass(frozen=True)
class TimeGrid:
    """Sorted time points, either given or 0, 1, 2, … below ``last`` and ``last`` itself.

    With ``whole`` the points are the whole numbers from 0 to ``last`` only. ``last`` may be a column. A short list can be given;
    ``operators.timepoints.PointTable`` takes a table of any length.
    """

    last: float | Column
    given: tuple[float, ...] | None = None
    whole: bool = False

    @classmethod
    def of(cls, points) -> "TimeGrid":
        points = tuple(sorted({float(p) for p in points}))
        if not points:
            raise ValueError("no time points given")
        return cls(points[-1], points)

    @property
    def size(self) -> int | Column:
        if self.given is not None:
            return len(self.given)
        if isinstance(self.last, Column):
            end = F.floor(self.last) + 1 if self.whole else F.greatest(F.ceil(self.last), F.lit(0)) + 1
            return F.greatest(end, F.lit(0)).cast("long")
        if self.whole:
            return max(math.floor(self.last) + 1, 0)
        return (math.ceil(self.last) if self.last > 0 else 0) + 1

    def point(self, index: Column) -> Column:
        if self.given is not None:
            return F.element_at(self._array(), (index + 1).cast("int"))
        if self.whole:
            return index.cast("double")
        return F.when(index == F.lit(self.size) - 1, F.lit(self.last)).otherwise(index.cast("double"))

    def first_from(self, time: Column) -> Column:
        """Index of the first point at or after ``time``; ``size`` if there is none."""
        if self.given is not None:
            return F.size(F.filter(self._array(), lambda p: p < time)).cast("long")
        inside = F.greatest(F.least(time, F.lit(self.last)), F.lit(0.0))
        if self.whole:
            return F.when(time > self.last, F.lit(self.size)).otherwise(F.least(F.ceil(inside), F.lit(self.size))).cast("long")
        index = F.least(F.ceil(inside), F.lit(self.size) - 1)
        return F.when(time > self.last, F.lit(self.size)).otherwise(index).cast("long")

    def first_after(self, time: Column) -> Column:
        """Index of the first point strictly after ``time``; ``size`` if there is none."""
        at = self.first_from(time)
        on_point = (at < self.size) & (self.point(F.least(at, F.lit(self.size) - 1)) == time)
        return F.when(on_point, at + 1).otherwise(at)

    def _array(self) -> Column:
        return F.array(*[F.lit(p) for p in self.given])

    def covered(self, birth: Column, death: Column, bounds: str = "half_open") -> tuple[Column, Column]:
        """Index range [from, to) of the points inside a lifetime.

        ``half_open``: birth <= t < death. ``open``: birth < t < death. ``closed_int``: every whole number from the one at or before birth
        up to the one at or before death or the last point, both included.
        """
        if bounds == "half_open":
            return self.first_from(birth), self.first_from(death)
        if bounds == "open":
            return self.first_after(birth), self.first_from(death)
        if bounds == "closed_int":
            start, stop = self._held(birth).cast("long"), self._held(death).cast("long") + 1
            return start, F.when(birth <= self.last, stop).otherwise(start)
        raise ValueError(f"unknown bounds {bounds!r}")

    def _held(self, time: Column) -> Column:
        """The whole number at or before a time, held between 0 and the last point."""
        return F.greatest(F.least(time, F.lit(self.last)), F.lit(0.0)).cast("int")

    def points_inside(self, birth: Column, death: Column, bounds: str = "half_open") -> Column:
        """Array of the time points inside a lifetime."""
        start, stop = self.covered(birth, death, bounds)
        steps = F.sequence(start, stop - 1)
        return F.when(start < stop, F.transform(steps, self.point)).otherwise(
            F.array().cast("array<double>")
        )

    def spans(self, lifetimes: DataFrame, bounds: str = "half_open") -> DataFrame:
        """The lifetimes that cover a point, with the index range [``__start``, ``__stop``) of their points."""
        start, stop = self.covered(F.col("birthTime"), F.col("deathTime"), bounds)
        return lifetimes.filter(start < stop).withColumns({START: start, STOP: stop})

    def at_points(self, rows: DataFrame, bounds: str = "half_open") -> DataFrame:
        """``__index`` as ``timePoint``."""
        point = F.col(INDEX).cast("int") if bounds == "closed_int" else self.point(F.col(INDEX))
        return rows.withColumn("timePoint", point).drop(INDEX)
