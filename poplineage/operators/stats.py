"""Statistics of clone snapshots per time point.

Few time points can hold all the rows, so rows are never sent to the task of their time point:
they are summed where they are read, and only sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import (
    bin_number,
    dense_counts,
    fractions,
    shannon_term,
    weighted_avg,
    weighted_stddev,
)
from ..runtime import small_side, small_table
from ..schemas import PARAM_COLUMNS, PARAMS

HISTOGRAM_BINS = 100


def system_size(snapshots: DataFrame, keys: Sequence[str] = ("timePoint",)) -> DataFrame:
    """Cells per time point."""
    return snapshots.groupBy(*keys).agg(F.sum("count").alias("systemSize"))


def _centres(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size and weighted means of each time point: one row each, checked before broadcast."""
    means = [
        F.coalesce(weighted_avg(F.col(f"cellParams.{p}"), F.col("count")), F.lit(0.0)).alias(f"__{p}")
        for p in PARAMS
    ]
    sums = snapshots.groupBy(*keys).agg(F.sum("count").alias("systemSize"), *means)
    return small_table(sums, "centres")


def scalar_stats(snapshots: DataFrame, keys: Sequence[str] = ("timePoint",)) -> DataFrame:
    """Clone count, size, entropy, weighted means and spreads of the parameters per time point.

    Sizes and probabilities refer to the given rows only. Two passes over the input: the first
    gives size and means, the second sums around them.
    """
    rows = snapshots.join(_centres(snapshots, keys), list(keys))
    probability = F.try_divide(F.col("count").cast("double"), F.col("systemSize"))
    weight = F.col("count")
    means, spreads = [], []
    for param, column in zip(PARAMS, PARAM_COLUMNS):
        value = F.col(f"cellParams.{param}")
        means.append(weighted_avg(value, weight).alias(f"mean_{column}"))
        spreads.append(weighted_stddev(value, weight, F.col(f"__{param}")).alias(f"stddev_{column}"))
    return rows.groupBy(*keys).agg(
        F.struct(
            F.count(F.lit(1)).alias("cloneCount"),
            F.any_value("systemSize").alias("systemSize"),
            # A single clone gives −0.0, which adding 0.0 turns into 0.0.
            (F.sum(shannon_term(probability)) + 0.0).alias("entropy"),
            *means,
            *spreads,
        ).alias("scalarStats")
    )


def histograms(
    snapshots: DataFrame,
    keys: Sequence[str] = ("timePoint",),
    bins: int = HISTOGRAM_BINS,
    clamp: bool = True,
) -> DataFrame:
    """Cells per parameter and bin, in long form: one row per occupied bin.

    A null value has a null bin, which keeps its time point and parameter in the result.
    """
    values = ", ".join(f"'{p}', cellParams.{p}" for p in PARAMS)
    unpivoted = snapshots.select(
        *keys, "count", F.expr(f"stack({len(PARAMS)}, {values}) as (parameter, value)")
    )
    return (
        unpivoted.withColumn("bin", bin_number(F.col("value"), bins, clamp))
        .groupBy(*keys, "parameter", "bin")
        .agg(F.sum(F.coalesce("count", F.lit(0).cast("long"))).alias("cells"))
    )


def histogram_arrays(long_form: DataFrame, keys: Sequence[str] = ("timePoint",), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Dense array of bins per time point and parameter."""
    return long_form.groupBy(*keys, "parameter").agg(
        dense_counts(F.col("bin"), F.col("cells"), bins).alias("histogram")
    )


def histogram_struct(snapshots: DataFrame, keys: Sequence[str] = ("timePoint",), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """One row per time point with the histograms of all parameters in one struct."""
    arrays = histogram_arrays(histograms(snapshots, keys, bins), keys, bins)
    fields = [F.any_value(F.when(F.col("parameter") == p, F.col("histogram")), True).alias(p) for p in PARAMS]
    return arrays.groupBy(*keys).agg(F.struct(*fields).alias("histograms"))


def normalized_histograms(
    snapshots: DataFrame, keys: Sequence[str] = ("timePoint",), bins: int = 1000
) -> DataFrame:
    """Share of the counted cells per bin, values outside [0, 1) left out, as dense arrays."""
    counted = histogram_arrays(histograms(snapshots, keys, bins, clamp=False), keys, bins)
    return counted.withColumn("histogram", fractions(F.col("histogram")))


def clone_stats(snapshots: DataFrame, keys: Sequence[str] = ("timePoint",)) -> DataFrame:
    """``timePoint, histograms, scalarStats``, one row per time point in order."""
    scalars = scalar_stats(snapshots, keys)
    return histogram_struct(snapshots, keys).join(scalars, list(keys)).orderBy(*keys)


def flat_scalars(stats: DataFrame, keys: Sequence[str] = ("timePoint",)) -> DataFrame:
    return stats.select(*keys, "scalarStats.*")


def normalized_entropy(scalars: DataFrame) -> DataFrame:
    """Adds the entropy's share of its maximum; null for a single clone."""
    return scalars.withColumn(
        "normalized_entropy", F.try_divide(F.col("entropy"), F.log2(F.col("cloneCount").cast("double")))
    )


def count_fractions(counts: DataFrame, keys: Sequence[str] = ("timePoint",)) -> DataFrame:
    """Long-form counts with their share of the total at their time point."""
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("__total"))
    shares = counts.join(small_table(totals, "totals"), list(keys))
    return shares.withColumn("fraction", F.try_divide(F.col("count").cast("double"), F.col("__total"))).drop("__total")


def major_and_noise(snapshots: DataFrame, large: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Clone snapshots of the large mutations, and those of all others."""
    same = [*keys, "mutationId"]
    ids = small_side(large.select(*same))
    return snapshots.join(ids, same, "left_semi"), snapshots.join(ids, same, "left_anti")


def top_mutations(counts: DataFrame, k: int, count: str = "mutationCount", keys: Sequence[str] = ()) -> DataFrame:
    """The k largest counts, of each key if there are any; ties broken by id."""
    held = counts.select(*keys, "mutationId", count)
    if not keys:
        return held.orderBy(F.desc(count), "mutationId").limit(k)
    # Spark keeps k rows a key in each task before it shuffles them.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(count), "mutationId"))
    return held.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def second_share(counts: DataFrame, count: str = "mutationCount", keys: Sequence[str] = ()) -> DataFrame:
    """Second largest count as a percentage of the largest; null if there is only one."""
    largest = F.sort_array(F.collect_list(count), asc=False)
    top = top_mutations(counts, 2, count, keys).groupBy(*keys).agg(largest.alias("__top"))
    share = F.try_divide(F.get("__top", F.lit(1)).cast("double"), F.get("__top", F.lit(0))) * 100
    return top.select(*keys, share.alias("percent"))
