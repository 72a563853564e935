"""Keys that hold a third of all rows, and the plans that deal with them."""

from pyspark.sql import functions as F
import pytest

from poplineage.operators import chronicles as lifetimes
from poplineage.operators import muller, phylogeny, stats
from poplineage.schemas import PARAMS

# Thresholds in the size of the test's tables, so that what happens at scale happens here.
AS_AT_SCALE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def at_scale(spark):
    before = {k: spark.conf.get(k) for k in AS_AT_SCALE}
    for k, v in AS_AT_SCALE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    executed = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython() if "isFinalPlan=false" in executed.toString() else None
    return df._jdf.queryExecution().executedPlan().toString()


def linear(spark, rows):
    """Every third row is a settler of event 7, whose only offspring has parent 1."""
    n = F.col("id")
    hot = n % 3 == 0
    zero = F.lit(0.0).cast("float")
    return spark.range(rows).select(
        F.when(hot, 7).otherwise(n + 100).cast("long").alias("eventId"),
        (n + 2).alias("particleId"),
        F.when(n == 3, F.lit(1).cast("long")).when(~hot, n + 1).alias("parentId"),
        n.cast("double").alias("birthTime"),
        F.lit(float("inf")).alias("deathTime"),
        F.struct(n.cast("float").alias("x"), zero.alias("y"), zero.alias("z")).alias("position"),
        (n % 5 + 1).alias("mutationId"),
        F.struct(*[zero.alias(p) for p in PARAMS]).alias("cellParams"),
    )


def test_an_event_with_a_third_of_all_rows_is_split(at_scale):
    resolved = lifetimes.resolve_parents(linear(at_scale, 60_000))
    assert "skew=true" in final_plan(resolved)
    assert resolved.filter("parentId = 1").count() == 20_000 and resolved.count() == 60_000


def test_children_of_one_parent_are_split(at_scale):
    cells = lifetimes.resolve_parents(linear(at_scale, 60_000))
    whole = cells.unionByName(cells.limit(1).withColumn("particleId", F.lit(1).cast("long")))
    tree = phylogeny.mutation_tree(whole)
    assert "skew=true" in final_plan(tree) and tree.count() == 5


def test_children_of_the_root_are_split(at_scale):
    n = F.col("id")
    links = at_scale.range(1, 40_001).select(
        n.alias("mutationId"), F.when(n == 1, 0).when(n % 3 == 0, 1).otherwise(F.floor(n / 2)).cast("long").alias("parentMutationId")
    )
    found = phylogeny.lineages(links)
    assert found.count() == 40_000
    assert found.filter((n := F.col("mutationId")) % 3 == 0).filter(F.size("ancestors") != 2).count() == 0


def test_a_time_point_with_a_third_of_all_rows(at_scale):
    n = F.col("id")
    counts = at_scale.range(30_000).select(
        F.when(n % 3 == 0, 5.0).otherwise((n % 7).cast("double")).alias("timePoint"),
        n.alias("mutationId"),
        F.lit(2).cast("long").alias("count"),
        F.struct(*[((n % 100) / 100).cast("float").alias(p) for p in PARAMS]).alias("cellParams"),
    )
    scalars = stats.scalar_stats(counts)
    plan = final_plan(scalars)
    # Rows meet their time point's sums where they are; only partial sums are shuffled.
    assert "BroadcastHashJoin" in plan and plan.count("partial_count") >= 1
    sizes = {r.timePoint: r.scalarStats.systemSize for r in scalars.collect()}
    assert sum(sizes.values()) == 60_000
    large = at_scale.range(10).select(n.alias("mutationId"))
    assert muller.collapsed(counts, large).agg(F.sum("count")).first()[0] == 60_000

