"""Weighted aggregates and histograms on edge values."""

import math
import random

from pyspark.sql import functions as F
import pytest

from poplineage.functions import kind_code, kind_label
from poplineage.functions.aggregates import bin_number, dense_counts, weighted_avg, weighted_stddev
from poplineage.functions.intervals import TimeGrid
from poplineage.operators import snapshots, stats, timepoints
from poplineage.schemas import PARAMS


def weighted(spark, rows):
    df = spark.createDataFrame(rows, "v float, w bigint")
    return df.agg(weighted_avg(F.col("v"), F.col("w")).alias("m"), weighted_stddev(F.col("v"), F.col("w")).alias("s")).first()


def test_weighted_stddev(spark):
    row = weighted(spark, [(1.0, 2), (2.0, 3), (5.0, 1)])
    assert row.s == pytest.approx(1.471960, abs=1e-6) and row.m == pytest.approx(13 / 6)


def test_weights_of_nothing_and_one(spark):
    assert tuple(weighted(spark, [])) == (None, None)
    assert tuple(weighted(spark, [(1.0, 0), (2.0, None)])) == (None, None)
    one = weighted(spark, [(3.0, 1), (9.0, 0)])
    assert one.m == 3.0 and math.isnan(one.s)


def test_null_values(spark):
    row = weighted(spark, [(None, 3), (2.0, 1)])
    assert row.m == 0.5 and row.s == pytest.approx(1.0)
    assert weighted(spark, [(None, 3)]).m is None


def test_same_as_sample_deviation_of_repeated_rows(spark):
    df = spark.range(200).select((F.col("id") % 17 / 16).cast("float").alias("v"), (F.col("id") % 5).alias("w"))
    ours = df.agg(weighted_stddev(F.col("v"), F.col("w"), 0.4)).first()[0]
    repeated = df.select("v", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int"))))
    assert ours == pytest.approx(repeated.agg(F.stddev_samp("v")).first()[0], rel=1e-12)


def test_spread_of_equal_values_is_zero(spark):
    clones = spark.createDataFrame([(0.0, 1, 10**9, 0.1), (0.0, 2, 10**9, 0.1)], "timePoint double, mutationId bigint, count bigint, v float")
    clones = clones.withColumn("cellParams", F.struct(*[F.col("v").alias(p) for p in PARAMS]))
    row = stats.flat_scalars(stats.scalar_stats(clones)).first()
    assert row.stddev_birth_efficiency == 0.0 and row.entropy == 1.0


def test_bins(spark):
    values = [None, float("nan"), -3.0, 0.0, 0.009, 0.01, 0.29, 0.57, 0.999, 1.0, 7.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v float")
    got = [r[0] for r in df.orderBy("i").select(bin_number(F.col("v"), 100)).collect()]
    # The product is taken in single precision: 0.29 · 100 is 29 there, 28.999… in double.
    assert got == [None, 0, 0, 0, 0, 1, 29, 57, 99, 99, 99, 99, 0]


def test_bins_without_clamping(spark):
    values = [None, float("nan"), -1e-9, 0.0, 0.001, 0.57, 0.9999, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(bin_number(F.col("v"), 1000, clamp=False)).collect()]
    assert got == [None, None, None, 0, 1, 570, 999, None]


def test_every_edge_opens_its_own_bin(spark):
    df = spark.range(1000).select("id", (F.col("id") / F.lit(1000.0)).alias("v"))
    assert df.filter(bin_number(F.col("v"), 1000, clamp=False) != F.col("id")).count() == 0


def test_dense_counts_of_nulls_only(spark):
    df = spark.createDataFrame([(None, 4)], "bin int, cells bigint")
    assert df.agg(dense_counts(F.col("bin"), F.col("cells"), 3)).first()[0] == [0, 0, 0]


def test_single_clone_entropy_has_no_share(spark):
    df = spark.createDataFrame([(1, 0.0), (4, 1.5)], "cloneCount bigint, entropy double")
    got = [r.normalized_entropy for r in stats.normalized_entropy(df).collect()]
    assert got == [None, 0.75]


def test_kinds(spark):
    df = spark.createDataFrame([("JUMPED_OUT",), ("JUPED_OUT",), ("MODIFIED",), ("?",), (None,)], "label string")
    codes = df.select(kind_code(F.col("label")).alias("c"))
    assert [r.c for r in codes.collect()] == [5, 5, 3, -1, -1]
    labels = [r[0] for r in codes.select(kind_label(F.col("c"))).collect()]
    assert labels == ["JUMPED_OUT", "JUMPED_OUT", "MODIFIED", "invalid event kind", "invalid event kind"]


@pytest.mark.parametrize("last", [0.0, 0.5, 3.0, 3.2, -1.0, -math.inf])
def test_grid(spark, last):
    grid = TimeGrid(last)
    points = [float(i) for i in range(10) if i < last] + [last]
    same = TimeGrid.of(points)
    times = [-math.inf, -1.0, -0.2, 0.0, 0.3, 0.5, 1.0, 2.9, 3.0, 3.1, 3.2, 4.0, math.inf]
    pairs = [(a, b) for a in times for b in times if a < b]
    df = spark.createDataFrame(pairs, "birth double, death double")
    for bounds in ("half_open", "open"):
        cols = [g.points_inside(F.col("birth"), F.col("death"), bounds) for g in (grid, same)]
        for (a, b), row in zip(pairs, df.select(*cols).collect()):
            expected = [p for p in points if (a <= p if bounds == "half_open" else a < p) and p < b]
            assert row[0] == expected and row[1] == expected, (a, b, bounds)


@pytest.mark.parametrize("last", [-0.5, 0.0, 2.0, 3.2])
def test_whole_grid(spark, last):
    """Whole numbers from 0 up to the last time, and no other point; the last one of each row's own."""
    points = [float(i) for i in range(10) if i <= last]
    times = [-math.inf, -1.0, 0.0, 0.3, 1.0, 2.0, 2.9, 3.0, 3.2, 4.0, math.inf]
    pairs = [(a, b) for a in times for b in times if a < b]
    df = spark.createDataFrame([(*p, last) for p in pairs], "birth double, death double, last double")
    for grid in (TimeGrid(last, whole=True), TimeGrid(F.col("last"), whole=True)):
        found = df.select(grid.points_inside(F.col("birth"), F.col("death")).alias("p")).collect()
        assert [r.p for r in found] == [[p for p in points if a <= p < b] for a, b in pairs]


def test_table_of_points(spark):
    """Points far apart and close together, repeated and null ones, against a list of them."""
    rng = random.Random(1)
    points = [0.0, 0.5, 0.5, -3.0, 1e9] + [1 + rng.random() / 1000 for _ in range(300)] + [rng.random() * 100 for _ in range(100)]
    times = [-math.inf, -3.0, 0.5, 1.0005, 1e9, 2e9, math.inf, *rng.sample(points, 20), *[rng.random() * 50 for _ in range(20)]]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in times for b in times if a < b)]
    lives = spark.createDataFrame(pairs, "particleId bigint, birthTime double, deathTime double")
    table = timepoints.PointTable(spark.createDataFrame([(p,) for p in [*points, None, math.nan]], "value double"), bits=3)
    for bounds in ("half_open", "open"):
        rows = snapshots.cells_by_time(lives, table, bounds)
        found = {r.particleId: r.points for r in rows.groupBy("particleId").agg(F.sort_array(F.collect_list("timePoint")).alias("points")).collect()}
        for i, birth, death in pairs:
            expected = sorted(p for p in set(points) if (birth <= p if bounds == "half_open" else birth < p) and p < death)
            assert found.get(i, []) == expected, (birth, death, bounds)
    nothing = timepoints.PointTable(spark.createDataFrame([(None,)], "value double"))
    assert snapshots.cells_by_time(lives, nothing).count() == 0
    assert timepoints.PointTable(spark.range(10_000).select((F.col("id") * F.col("id")).alias("value"))).steps <= 10


def test_grids_of_runs(spark):
    rows = [("a", 1, 0.0, 2.5), ("a", 2, 3.2, math.inf), ("b", 1, 0.0, math.inf), ("c", 1, -math.inf, 0.5), ("c", 2, 0.25, 7.0)]
    lives = spark.createDataFrame(rows, "run string, particleId bigint, birthTime double, deathTime double")
    grids = timepoints.KeyedGrids(lives, ["run"])
    points = {}
    for r in grids.points().orderBy("value").collect():
        points.setdefault(r.run, []).append(r.value)
    assert points == {"a": [0.0, 1.0, 2.0, 3.0, 3.2], "b": [0.0], "c": [0.0, 0.25]}
    found = {(r.run, r.particleId, r.timePoint) for r in snapshots.cells_by_time(lives, grids).collect()}
    assert found == {(run, i, p) for run, i, birth, death in rows for p in points[run] if birth <= p < death}
