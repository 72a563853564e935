"""All stages on the worked-out log."""

import math

import golden
from pyspark.sql import functions as F
import pytest

from poplineage.functions.intervals import TimeGrid
from poplineage.operators import chronicles as lifetimes
from poplineage.operators import events, muller, phylogeny, quality, reports, snapshots, stats, tour


@pytest.fixture(scope="module")
def cells(spark):
    return lifetimes.chronicles(golden.log(spark), golden.initial(spark)).persist()


@pytest.fixture(scope="module")
def clones(cells):
    return snapshots.clone_snapshots(cells, snapshots.time_grid(cells)).persist()


@pytest.fixture(scope="module")
def tree(cells):
    return phylogeny.mutation_tree(cells).persist()


@pytest.mark.parametrize("bits", [20, 2, 1, 0])
@pytest.mark.parametrize("strict,expected", [(False, golden.EVENT_IDS), (True, golden.EVENT_IDS_STRICT)])
def test_event_groups(spark, bits, strict, expected):
    grouped = events.event_groups(golden.log(spark), strict=strict, bits=bits)
    assert [r.eventId for r in grouped.orderBy("ord").collect()] == expected


@pytest.mark.parametrize("bits", [20, 1, 0])
def test_chronicles(spark, bits):
    found = lifetimes.chronicles(golden.log(spark), golden.initial(spark), bits=bits)
    assert golden.as_tuples(found) == golden.CHRONICLES


def test_no_initial_cells_and_empty_log(spark):
    empty = golden.log(spark).limit(0)
    assert lifetimes.chronicles(empty).count() == 0
    only_initial = lifetimes.chronicles(empty, golden.initial(spark))
    assert {(r.particleId, r.deathTime) for r in only_initial.collect()} == {(1, golden.INF), (2, golden.INF)}


def test_time_points(cells):
    assert [r.value for r in snapshots.time_points(cells).collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("method", ["delta", "explode"])
def test_clone_snapshots(cells, method):
    found = snapshots.clone_snapshots(cells, TimeGrid(4.0), method=method)
    assert {(r.timePoint, r["mutationId"], r["count"]) for r in found.collect()} == golden.CLONES
    assert {round(r.cellParams.birthEfficiency * 10) - r.mutationId for r in found.collect()} == {0}


def test_open_and_closed_bounds(cells):
    grid = TimeGrid(4.0)
    open_ = snapshots.cells_by_time(cells, grid, "open").filter(F.col("particleId") == 3)
    assert [r.timePoint for r in open_.collect()] == [2.0]
    closed = snapshots.cells_by_time(cells, grid, "closed_int").filter(F.col("particleId") == 4)
    assert sorted(r.timePoint for r in closed.collect()) == [1, 2]
    by_delta = snapshots.clone_snapshots(cells, grid, bounds="open")
    by_rows = snapshots.clone_snapshots(cells, grid, bounds="open", method="explode")
    assert by_delta.select(*by_rows.columns).exceptAll(by_rows).count() == 0 and by_rows.count() > 0
    assert by_delta.count() == by_rows.count()


def test_final_population(cells):
    assert {(r["mutationId"], r["count"]) for r in snapshots.final_clone_snapshot(cells).collect()} == {
        (2, 1),
        (3, 2),
        (4, 1),
    }
    assert snapshots.final_cells(cells).columns[:4] == ["x", "y", "z", "mutationId"]
    assert snapshots.snapshot_at(cells, 2.0).count() == 2


def test_scalar_stats(clones):
    for row in stats.flat_scalars(stats.clone_stats(clones)).collect():
        count, size, entropy = golden.STATS[row.timePoint]
        assert (row.cloneCount, row.systemSize) == (count, size)
        assert row.entropy == pytest.approx(entropy, abs=1e-6) and math.copysign(1, row.entropy) == 1
        assert 0 <= row.entropy <= math.log2(count) + 1e-12


def test_histogram_sums_to_system_size(clones):
    for row in stats.clone_stats(clones).collect():
        for bins in row.histograms:
            assert len(bins) == 100 and sum(bins) == row.scalarStats.systemSize


def test_tree_and_lineages(tree):
    assert {(r.mutationId, r.parentMutationId, r.time) for r in tree.collect()} == golden.TREE
    for method in ("doubling", "levels"):
        found = phylogeny.lineages(tree, method=method).collect()
        assert {r.mutationId: r.ancestors for r in found} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4]}


def test_summary(cells, clones, tree):
    paths, along = phylogeny.lineages(tree), tour.tour(tree)
    final = snapshots.clones_at(clones, 4.0)
    summary = phylogeny.mutation_summary(paths, along, final, tree).persist()
    rows = {r.mutationId: r for r in summary.collect()}
    assert {(k, r.mutationCount) for k, r in rows.items()} == golden.CARRIED
    assert {k: r.waitingTime for k, r in rows.items()} == golden.WAITING
    assert rows[1].typeCount == 0 and rows[1].parameterUpgrades.birthEfficiency is None
    assert rows[3].parameterUpgrades.birthEfficiency == pytest.approx(0.1, abs=1e-6)
    frequency = phylogeny.mutation_frequency(final, along)
    assert {(r.ancestorMutationId, r.mutationCount) for r in frequency.collect()} == golden.CARRIED
    assert rows[1].mutationCount == snapshots.living(cells).count()
    vertices, edges = reports.subtree_over(summary, 1)
    assert {r.mutationId for r in vertices.collect()} == {1, 2, 3}
    assert {(r.parentMutationId, r.mutationId) for r in edges.collect()} == {(1, 2), (2, 3)}


def test_muller(cells, clones, tree):
    along = tour.tour(tree)
    order = muller.muller_order(along)
    assert [(r.mutationId, r.ordering) for r in order.orderBy("ordering").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    large = muller.large_clones(cells, 2)
    assert {r.mutationId for r in large.collect()} == {1, 3}
    wide = muller.muller_pivot(clones, muller.large_muller_order(along, large), width=2)
    assert wide.columns == ["timePoint", "block", "ids", "counts"]
    last = wide.filter("timePoint = 4").orderBy("block").collect()
    assert [(r.ids, r.counts) for r in last] == [([0, 1], [2, 0]), ([3], [2])]
    assert wide.count() == 2 * 5
    for bits in (20, 0):
        data = muller.muller_data(cells, order, TimeGrid(4.0), min_cells=1, bits=bits).collect()
        assert [(r.mutationId, r.cumeDist) for r in data if r.timePoint == 4.0] == [(2, 0.25), (3, 0.75), (4, 1.0)]


def test_anomalies(spark):
    initial = events.initial_events(golden.initial(spark))
    assert quality.sequence_anomalies(golden.log(spark), initial).count() == 0
    found = quality.sequence_anomalies(golden.log(spark)).collect()
    assert {(r.ord, r.anomaly) for r in found} == {(0, "first_transformed"), (2, "first_removed")}
