"""Trees of awkward shape, and the order along them."""

import random

from pyspark.sql import functions as F
import pytest

from poplineage.operators import muller, phylogeny, tour
from poplineage.runtime import bucketed


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "mutationId bigint, parentMutationId bigint")


def test_deep_chain(spark):
    chain = edges(spark, [(i, i - 1) for i in range(1, 1001)])
    paths = phylogeny.lineages(chain)
    last = paths.filter(F.col("mutationId") == 1000).first().ancestors
    assert paths.count() == 1000 and last == list(range(1, 1001))


def test_wide_root(spark):
    star = edges(spark, [(1, 0)] + [(i, 1) for i in range(2, 500)] + [(i, i - 500) for i in range(502, 900)])
    for method in ("doubling", "levels"):
        found = {r.mutationId: r.ancestors for r in phylogeny.lineages(star, method=method).collect()}
        assert len(found) == 897 and found[505] == [1, 5, 505]


@pytest.mark.parametrize("method", ["doubling", "levels"])
@pytest.mark.parametrize(
    "wrong", [[(5, 77)], [(5, 6), (6, 5)], [(5, 6), (6, 7), (7, 5), (8, 7), (9, 8)], [(5, 5)], [(5, 0)]]
)
def test_broken_trees(spark, method, wrong):
    links = edges(spark, [(1, 0), (2, 1), (3, 2), *wrong])
    with pytest.raises(phylogeny.BrokenTree):
        phylogeny.lineages(links, method=method)
    found = phylogeny.lineages(links, method=method, strict=False)
    assert {r.mutationId for r in found.collect()} == {1, 2, 3}
    assert {r.mutationId for r in phylogeny.disconnected(links).collect()} == {a for a, _ in wrong}
    with pytest.raises(phylogeny.BrokenTree):
        tour.tour(links)
    assert as_dict(tour.tour(links, strict=False)) == {1: (0, 2, 0), 2: (1, 2, 1), 3: (2, 2, 2)}


def test_root_alone(spark):
    assert [tuple(r) for r in phylogeny.lineages(edges(spark, [(1, 0)])).collect()] == [(1, [1])]


def test_ancestry_of_a_forest(spark):
    parents = edges(spark, [(1, 0), (2, 1), (3, 0), (4, 3), (9, 77)])
    ids = spark.createDataFrame([(2,), (4,)], "mutationId bigint")
    found = {r.mutationId: r.ancestors for r in phylogeny.ancestry_of(ids, parents).collect()}
    assert found == {2: [1, 2], 4: [3, 4]}
    lost = spark.createDataFrame([(9,)], "mutationId bigint")
    with pytest.raises(Exception, match="no path to parent 0"):
        phylogeny.ancestry_of(lost, parents).collect()


def test_orders(spark):
    links = edges(spark, [(2, 1), (3, 1), (9, 2), (4, 3)])
    down = muller.muller_order(tour.tour(links)).orderBy("ordering").collect()
    assert [(r.mutationId, r.ordering) for r in down] == [(1, 0), (3, 1), (4, 2), (2, 3), (9, 4)]
    up = muller.muller_order(tour.tour(links, descending=False)).orderBy("ordering").collect()
    assert [r.mutationId for r in up] == [1, 2, 9, 3, 4]
    paths = phylogeny.lineages(links)
    for descending, order in ((True, down), (False, up)):
        assert muller.path_order(paths, descending).orderBy("ordering").collect() == order
    few = tour.order_among(tour.tour(links), edges(spark, [(9, 0), (4, 0), (9, 0), (77, 0)]))
    assert {tuple(r) for r in few.collect()} == {(4, 0), (9, 1)}


def walked(pairs, descending, root=1):
    """Preorder by hand: id to (pre, last, depth)."""
    children = {}
    for node, parent in pairs:
        if node != root:
            children.setdefault(parent, []).append(node)
    found, stack, count = {}, [(root, 0, False)], 0
    while stack:
        node, depth, left = stack.pop()
        if left:
            found[node] = (found[node][0], count - 1, depth)
            continue
        found[node] = (count, None, depth)
        count += 1
        stack.append((node, depth, True))
        stack.extend((c, depth + 1, False) for c in sorted(children.get(node, []), reverse=not descending))
    return found


def as_dict(tree):
    return {r.mutationId: (r.pre, r.last, r.depth) for r in tree.collect()}


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("bits", [1, 17])
def test_tours_of_random_trees(spark, descending, bits):
    """Half of the nodes hang on one parent, which is cut into chunks when they are small."""
    rng = random.Random(bits)
    pairs = [(1, 0)] + [(i, rng.choice([2 if i > 2 else 1, rng.randrange(1, i)])) for i in range(2, 120)]
    links = edges(spark, pairs)
    assert as_dict(tour.tour(links, descending=descending, bits=bits)) == walked(pairs, descending)


def test_tours_of_many_runs(spark):
    """Each run has a tree of its own under the same ids; one has a cycle, an orphan and a root alone."""
    rng = random.Random(5)
    runs = {"a": [(i, rng.randrange(1, i)) for i in range(2, 40)], "b": [(i, max(1, i - 1)) for i in range(2, 30)], "c": [(5, 6), (6, 5), (8, 99)]}
    links = spark.createDataFrame([(run, *pair) for run, pairs in runs.items() for pair in pairs], "run string, mutationId bigint, parentMutationId bigint")
    with pytest.raises(tour.BrokenTree):
        tour.tour(links, keys=["run"])
    found = tour.tour(links, keys=["run"], strict=False)
    paths = phylogeny.lineages(links, keys=["run"], strict=False)
    for run, pairs in runs.items():
        own = walked(pairs, True)
        assert as_dict(found.filter(F.col("run") == run)) == own
        held = {r.mutationId: r.ancestors for r in paths.filter(F.col("run") == run).collect()}
        assert {k: len(v) - 1 for k, v in held.items()} == {k: depth for k, (_, _, depth) in own.items()}
    for method in ("doubling", "levels"):
        same = phylogeny.lineages(links, keys=["run"], strict=False, method=method)
        assert sorted(same.collect()) == sorted(paths.collect())


def test_tour_of_a_deep_chain(spark):
    """100,000 levels: paths would hold five thousand million ids."""
    size = 100_000
    links = spark.range(2, size + 1).select(F.col("id").alias("mutationId"), (F.col("id") - 1).alias("parentMutationId"))
    tree = tour.tour(links)
    found = tree.agg(F.count(F.lit(1)), F.count_if(F.expr("pre = mutationId - 1 and depth = pre")), F.min("last"), F.max("last")).first()
    assert tuple(found) == (size, size, size - 1, size - 1)
    clones = spark.range(1, size + 1).select(F.col("id").alias("mutationId"), F.lit(2).cast("long").alias("count"))
    counted = phylogeny.subtree_counts(clones, tree)
    assert counted.filter(F.col("mutationCount") != 2 * (size - F.col("pre"))).count() == 0


def test_subtree_sums(spark):
    rng = random.Random(3)
    pairs = [(i, rng.randrange(max(1, i - 6), i)) for i in range(2, 90)]
    paths = {r.mutationId: r.ancestors for r in phylogeny.lineages(edges(spark, pairs)).collect()}
    counts = {i: rng.randrange(5) for i in rng.sample(range(1, 90), 40)}
    clones = spark.createDataFrame([*counts.items(), (500, 7)], "mutationId bigint, count bigint")
    expected = {}
    for node, path in paths.items():
        for above in path:
            total, rows = expected.get(above, (0, 0))
            expected[above] = (total + counts.get(node, 0), rows + (node in counts))
    for bits in (1, 17):
        tree = tour.tour(edges(spark, pairs), bits=bits)
        counted = phylogeny.subtree_counts(clones, tree)
        assert {r.mutationId: (r.mutationCount, r.clones) for r in counted.collect()} == expected
    frequency = phylogeny.mutation_frequency(clones, tree)
    assert {tuple(r) for r in frequency.collect()} == {(k, total) for k, (total, rows) in expected.items() if rows}


def test_only_wanted_links(spark):
    """Of 3,000 mutations in chains of 100, the way up from two ids and nothing else."""
    pairs = [(i, i - 1 if i % 100 else 0) for i in range(1, 3001)]
    ids = spark.createDataFrame([(150,), (101,), (2999,)], "mutationId bigint")
    held = phylogeny.wanted_links(ids, edges(spark, pairs)).collect()
    assert {r.mutationId for r in held} == {*range(100, 151), *range(2900, 3000)}
    found = {r.mutationId: r.ancestors for r in phylogeny.ancestry_of(ids, edges(spark, pairs)).collect()}
    assert found[150] == list(range(100, 151)) and found[101] == [100, 101]


def test_levels_move_the_frontier_alone(spark):
    links = edges(spark, [(i, i // 2) for i in range(2, 400)])
    frontier = spark.createDataFrame([(3, [1, 3])], phylogeny.PATH_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(links, ["parentMutationId"]) as held:
            step = phylogeny.next_level(held, frontier)
            assert sorted(r.mutationId for r in step.collect()) == [6, 7]
            plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_appearance_counts(spark):
    schema = (
        "particleId bigint, parentId bigint, birthTime double, mutationId bigint, "
        "cellParams struct<birthEfficiency:float>"
    )
    rows = [(1, 0, 0.0, 1, (0.1,)), (2, 1, 2.0, 5, (0.5,)), (3, 2, 3.0, 6, (0.6,)), (4, 3, 4.0, 5, (0.7,)), (5, 99, 5.0, 7, (0.2,))]
    tree = phylogeny.mutation_tree(spark.createDataFrame(rows, schema))
    found = {(r.mutationId, r.parentMutationId, r.time) for r in tree.collect()}
    assert found == {(1, 0, 0.0), (5, 1, 2.0), (6, 5, 3.0), (7, 0, 5.0)}
