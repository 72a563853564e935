"""Weighted aggregates written as sums, so that Spark combines them before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_avg(value: Column, weight: Column) -> Column:
    """Σ value·weight / Σ weight; a null value adds nothing above the line but its weight counts below."""
    weight = F.coalesce(weight, F.lit(0))
    return F.try_divide(F.sum(value.cast("double") * weight), F.sum(weight).cast("double"))


def weighted_stddev(value: Column, weight: Column, centre: Column | float = 0.0) -> Column:
    """Sample standard deviation of values that each stand for ``weight`` equal observations.

    Null values count as 0.0, null weights as 0. Total weight 0 gives null, 1 gives NaN.
    ``centre`` shifts the values before they are squared; pass the group's mean to lose no
    digits when the spread is small beside the mean.
    """
    weight = F.coalesce(weight, F.lit(0)).cast("double")
    centre = centre if isinstance(centre, Column) else F.lit(float(centre))
    distance = F.coalesce(value.cast("double"), F.lit(0.0)) - centre
    total = F.sum(weight)
    first = F.sum(weight * distance)
    second = F.sum(weight * distance * distance)
    squares = F.greatest(second - F.try_divide(first * first, total), F.lit(0.0))
    return F.when(total == 1, F.lit(float("nan"))).when(
        total > 0, F.sqrt(F.try_divide(squares, total - 1))
    )


def shannon_term(probability: Column) -> Column:
    """p·(−log2 p), null for p = 0, which a sum then skips."""
    return probability * -F.log2(probability)


def bin_number(value: Column, bins: int, clamp: bool = True) -> Column:
    """Number of the equal-width bin of [0, 1) that holds ``value``; bins are closed on the left.

    With ``clamp`` the edge bins also take what lies outside, NaN goes to bin 0, and the product
    is taken in single precision like the values. Without it, values outside [0, 1) give null.
    """
    if clamp:
        scaled = value.cast("float") * F.lit(bins).cast("float")
        bounded = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(bins - 1)))
        # Said for each case: greatest and least pass over nulls.
        return F.when(F.isnan(value), F.lit(0)).when(value.isNotNull(), F.floor(bounded).cast("int"))
    value = value.cast("double")
    # One step past the estimate and back: edges are i/bins in double precision.
    guess = F.floor(F.when((value >= 0) & (value < 1), value) * bins).cast("int")
    return (
        F.when(value < guess / F.lit(float(bins)), guess - 1)
        .when(value >= (guess + 1) / F.lit(float(bins)), guess + 1)
        .otherwise(guess)
    )


def dense_counts(bin_: Column, count: Column, bins: int) -> Column:
    """Array of ``bins`` counts from one row per occupied bin; empty bins hold 0.

    At most ``bins`` pairs are gathered per group, so pre-aggregate by bin first.
    """
    pairs = F.array_sort(F.collect_list(F.when(bin_.isNotNull(), F.struct(bin_.alias("bin"), count.alias("count")))))
    before = F.concat(F.array(F.lit(-1)), F.transform(pairs, lambda p: p["bin"]))
    nothing = F.array().cast("array<bigint>")

    def filled(pair: Column, last: Column) -> Column:
        gap = F.coalesce(pair["bin"], F.lit(bins)) - last - 1
        zeros = F.array_repeat(F.lit(0).cast("long"), gap)
        return F.concat(zeros, F.when(pair.isNull(), nothing).otherwise(F.array(pair["count"])))

    # One step longer than the pairs: the last one fills up to the end.
    return F.flatten(F.zip_with(pairs, before, filled))


def fractions(counts: Column) -> Column:
    """The array divided by its sum; null shares where the sum is 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    # Repeated beside the counts, because inside the function it would be summed for each of them.
    return F.zip_with(
        counts, F.array_repeat(total, F.size(counts)), lambda n, t: F.try_divide(n.cast("double"), t)
    )
