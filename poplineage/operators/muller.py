"""Growth-over-time (Müller) tables: order of mutations, large clones, shares per time point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import pin, small_side, small_table
from .ordered import CHUNK_BITS, numbered, running_sums
from .snapshots import Grid, clone_snapshots, earliest_params
from .stats import count_fractions
from .tour import order_among

NOISE = 0
LARGE_CLONE = 1000
BLOCK_WIDTH = 1024


def ancestry_key(descending: bool = True) -> Column:
    """Sort key of a path: element by element, an ancestor before its descendants."""
    return F.transform("ancestors", lambda a: -a) if descending else F.col("ancestors")


def path_order(paths: DataFrame, descending: bool = True) -> DataFrame:
    """``mutationId, ordering`` of mutations whose paths are at hand; ``muller_order`` needs none."""
    return numbered(paths, [ancestry_key(descending)], "ordering").select("mutationId", "ordering")


def muller_order(tree: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, mutationId, ordering``: dense numbers along the tree, from its tour.

    A tour with ``descending`` puts younger branches first, one without them puts branches in the order of their ids.
    """
    return tree.select(*keys, "mutationId", F.col("pre").alias("ordering"))


def large_clones(chronicles: DataFrame, threshold: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mutations that ever had more than ``threshold`` cells."""
    sizes = chronicles.groupBy(*keys, "mutationId").agg(
        F.count(F.lit(1)).alias("mutationSize"), earliest_params().alias("cellParams")
    )
    return sizes.filter(F.col("mutationSize") > threshold).select(*keys, "mutationId", "cellParams")


def mutation_sizes(chronicles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lifetimes ever per mutation."""
    return chronicles.groupBy(*keys, "mutationId").agg(F.count(F.lit(1)).alias("mutationSize"))


def large_muller_order(tree: DataFrame, large: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order of the large mutations only; ``tree`` is a tour."""
    return order_among(tree, large, keys)


def collapsed(snapshots: DataFrame, kept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Snapshot counts per time point, mutations outside ``kept`` summed under id 0."""
    ids = small_side(kept.select(*keys, "mutationId", F.lit(True).alias("__kept")))
    shown = F.when(F.col("__kept"), F.col("mutationId")).otherwise(F.lit(NOISE).cast("long"))
    return (
        snapshots.join(ids, [*keys, "mutationId"], "left")
        .groupBy(*keys, "timePoint", shown.alias("mutationId"))
        .agg(F.sum(F.coalesce("count", F.lit(0).cast("long"))).alias("count"))
    )


def muller_pivot(
    snapshots: DataFrame, order: DataFrame, width: int = BLOCK_WIDTH, keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, timePoint, block, ids, counts``: the wide table of all ordered mutations, cut into blocks of ``width`` columns.

    Columns are id 0 (all others) and the mutations in their order. A block holds the ids of its columns and
    their counts at the time point, zeros included; it is the same at any number of mutations.
    """
    points = pin(snapshots.select(*keys, "timePoint").distinct(), "points")
    rows = points.select(*keys).distinct() if keys else order.sparkSession.range(1)
    nobody = rows.select(*keys, F.lit(NOISE).cast("long").alias("mutationId"), F.lit(0).cast("long").alias("__place"))
    places = nobody.unionByName(order.select(*keys, "mutationId", (F.col("ordering") + 1).alias("__place")))
    places = places.withColumn("block", F.floor(F.col("__place") / width))
    columns = F.transform(F.array_sort(F.collect_list(F.struct("__place", "mutationId"))), lambda c: c["mutationId"])
    blocks = pin(places.groupBy(*keys, "block").agg(columns.alias("ids")), "blocks")
    counts = collapsed(snapshots, order, keys).join(places, [*keys, "mutationId"])
    held = counts.groupBy(*keys, "timePoint", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("mutationId", "count"))).alias("__counts")
    )
    if keys:
        every = points.join(small_side(blocks.select(*keys, "block")), list(keys))
    else:
        last = blocks.agg(F.max("block")).first()[0]
        every = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    filled = every.join(held, [*keys, "timePoint", "block"], "left").join(blocks, [*keys, "block"])
    count = lambda c: F.coalesce(F.element_at("__counts", c), F.lit(0).cast("long"))
    return filled.select(*keys, "timePoint", "block", "ids", F.transform("ids", count).alias("counts"))


def ordered_counts(clones: DataFrame, order: DataFrame) -> DataFrame:
    """Cells per place in the order, mutations without one first, under a null place.

    Ordered mutations without cells have count 0, and so does the null place if nothing is in it.
    """
    spark = clones.sparkSession
    nobody = spark.range(1).select(
        F.lit(None).cast("long").alias("ordering"), F.lit(0).cast("long").alias("count")
    )
    rows = clones.select("mutationId", "count").join(order, "mutationId", "full")
    counted = rows.select("ordering", F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    # Rows without a place can be very many: summed where they are, then by place.
    return counted.unionByName(nobody).groupBy("ordering").agg(F.sum("count").alias("count")).orderBy("ordering")


def muller_data(
    chronicles: DataFrame,
    order: DataFrame,
    grid: Grid,
    min_cells: int = LARGE_CLONE,
    bits: int = CHUNK_BITS,
    keys: Sequence[str] = (),
    bounds: str = "half_open",
) -> DataFrame:
    """Cumulative share of the population up to each mutation, along the order, per time point.

    Mutations with fewer than ``min_cells`` lifetimes are summed under id 0, and mutations
    without a place in the order come first. The last running sum of a time point is its total.
    """
    at = [*keys, "timePoint"]
    counts = clone_snapshots(chronicles, grid, bounds, keys=keys).select(*at, "mutationId", "count")
    # One pass: a mutation is small if its lifetimes are few, whichever time points they cover.
    sizes = mutation_sizes(chronicles, keys).filter(F.col("mutationSize") >= min_cells)
    shown = small_table(sizes.select(*keys, "mutationId", F.lit(True).alias("__large")), "large")
    merged = (
        counts.join(shown, [*keys, "mutationId"], "left")
        .groupBy(*at, F.when(F.col("__large"), F.col("mutationId")).otherwise(F.lit(NOISE).cast("long")).alias("mutationId"))
        .agg(F.sum("count").alias("count"))
    )
    # A place below all others stands for "no place", so that such mutations are peers.
    place = F.coalesce("ordering", F.lit(-1).cast("long"))
    placed = pin(merged.join(order, [*keys, "mutationId"], "left").withColumn("__place", place), "placed")
    along = pin(running_sums(placed, {"__upto": F.col("count")}, "__place", at, bits), "along")
    totals = small_table(along.groupBy(*at).agg(F.max("__upto").alias("__total")), "totals")
    share = F.col("__upto") / F.col("__total")
    return along.join(totals, at).orderBy(*keys, "__place", "timePoint", "mutationId").select(*keys, "mutationId", "timePoint", share.alias("cumeDist"))


def long_fractions(snapshots: DataFrame, order: DataFrame) -> DataFrame:
    """Share of each shown mutation at each time point, in long form."""
    return count_fractions(collapsed(snapshots, order))


def snapshot_counts(cells: DataFrame, time: str = "time", mutation: str = "mutationId") -> DataFrame:
    """Cells per snapshot and mutation of row-per-cell snapshots."""
    return cells.groupBy(F.col(time).alias("timePoint"), F.col(mutation).alias("mutationId")).agg(
        F.count(F.lit(1)).alias("count")
    )


def ever_large(counts: DataFrame, threshold: int = 10) -> DataFrame:
    """Mutations whose count is above ``threshold`` at any time point."""
    peaks = counts.groupBy("mutationId").agg(F.max("count").alias("__peak"))
    return peaks.filter(F.col("__peak") > threshold).select("mutationId")


def noise_series(counts: DataFrame, threshold: int = 10) -> DataFrame:
    """Counts per time point with all never-large mutations summed under id 0."""
    return collapsed(counts, pin(ever_large(counts, threshold), "large"))


def prevalence(counts: DataFrame, paths: DataFrame, threshold: int = 10) -> DataFrame:
    """Share of the noise (place 0) and of each large mutation, in ancestry order, per time point.

    ``paths`` are the ancestries of the large mutations. Absent mutations have no row; the noise
    has one at every time point.
    """
    large = pin(ever_large(counts, threshold), "large")
    order = path_order(paths.join(large, "mutationId", "left_semi"), descending=False)
    shown = collapsed(counts, large)
    zero = counts.select("timePoint", F.lit(NOISE).cast("long").alias("mutationId"), F.lit(0).cast("long").alias("count"))
    filled = (
        shown.unionByName(zero.distinct())
        .groupBy("timePoint", "mutationId")
        .agg(F.sum("count").alias("count"))
    )
    placed = filled.join(order, "mutationId", "left")
    place = F.when(F.col("mutationId") == NOISE, F.lit(0).cast("long")).otherwise(F.col("ordering") + 1)
    return count_fractions(placed.withColumn("place", place)).select(
        "timePoint", "place", "mutationId", "count", "fraction"
    )


def param_table(order: DataFrame, large: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parameters of the ordered mutations as plain columns."""
    params = large.select(*keys, "mutationId", "cellParams")
    return order.join(params, [*keys, "mutationId"]).select(*keys, "ordering", "mutationId", "cellParams.*")

