"""Steps in order, cut into chunks, against one window over everything; skewed groups; many runs."""

import random

import golden
from pyspark.sql import Window
from pyspark.sql import functions as F
import pytest

from poplineage.operators import chronicles as lifetimes
from poplineage.operators import events, ordered, quality


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds a third of all rows."""
    rng = random.Random(7)
    data = [
        (i * 3 + (i // 100) * 5000, 0 if rng.random() < 0.34 else rng.randrange(1, 40), rng.randrange(5), rng.choice([None, i]))
        for i in range(1500)
    ]
    return spark.createDataFrame(data, "ord bigint, g int, v bigint, w bigint").repartition(7, "v").persist()


def same(found, expected):
    found = found.select(*expected.columns)
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 6, 20])
def test_running_sum(rows, bits):
    found = ordered.running_sum(rows, F.col("v"), "ord", "s", bits=bits)
    same(found, rows.withColumn("s", F.sum("v").over(Window.orderBy("ord"))))
    found = ordered.running_sum(rows, F.col("v"), "ord", "s", keys=["g"], bits=bits)
    same(found, rows.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("ord"))))


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_fill_forward(rows, bits):
    found = ordered.fill_forward(rows, {"f": F.col("w")}, "ord", ["g"], bits)
    window = Window.partitionBy("g").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    same(found, rows.withColumn("f", F.last("w", ignorenulls=True).over(window)))


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_neighbours_of_hot_groups(rows, bits):
    hot = ordered.hot_groups(rows, ["g"], bits)
    assert bool(hot.head(1)) == (bits < 20)
    found = ordered.with_neighbours(rows, ["g"], "ord", {"p": F.col("w")}, {"n": F.col("w")}, bits)
    window = Window.partitionBy("g").orderBy("ord")
    same(found, rows.withColumns({"p": F.lag("w").over(window), "n": F.lead("w").over(window)}))


def test_only_the_hot_group_is_cut(rows):
    assert ordered.hot_groups(rows, ["g"], 8).count() == 1


def test_more_than_a_thousand_hot_groups(spark):
    rows = spark.range(0, 9000).select((F.col("id") % 1500).alias("g"), F.col("id").alias("ord"))
    assert ordered.hot_groups(rows, ["g"], 2).count() == 1500
    found = ordered.with_neighbours(rows, ["g"], "ord", {"p": F.col("ord")}, {"n": F.col("ord")}, 2)
    window = Window.partitionBy("g").orderBy("ord")
    same(found, rows.withColumns({"p": F.lag("ord").over(window), "n": F.lead("ord").over(window)}))


def test_numbered(rows):
    found = ordered.numbered(rows, [F.desc("ord")], "n", start=5)
    same(found, rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("ord"))).cast("long") + 4))


def test_numbered_by_key(rows):
    """Keys that span tasks, and tasks that hold many keys."""
    window = Window.partitionBy("g").orderBy(F.desc("ord"))
    expected = rows.withColumn("n", F.row_number().over(window).cast("long") - 1)
    same(ordered.numbered(rows, [F.desc("ord")], "n", keys=["g"]), expected)


def test_two_levels_of_chunks(spark):
    """Chunks of two rows in groups of two: both cuts lie everywhere, order numbers are on both sides of 0."""
    rng = random.Random(2)
    data = [(i - 300 + (i // 50) * 37, rng.randrange(4), rng.choice([None, i]), rng.randrange(3)) for i in range(600)]
    rows = spark.createDataFrame(data, "ord bigint, v int, w bigint, timeDelta int").persist()
    everything = Window.orderBy("ord")
    upto = everything.rowsBetween(Window.unboundedPreceding, 0)
    found = ordered.running_sums(rows, {"s": F.col("v"), "t": F.lit(1)}, "ord", bits=1)
    same(found, rows.withColumns({"s": F.sum("v").over(everything), "t": F.sum(F.lit(1)).over(everything)}))
    same(ordered.fill_forward(rows, {"f": F.col("w")}, "ord", bits=1), rows.withColumn("f", F.last("w", ignorenulls=True).over(upto)))
    rises = (F.col("timeDelta") >= F.lag("timeDelta", 1, 0).over(everything)).cast("long")
    expected = rows.withColumn("r", rises).withColumn("eventId", F.sum("r").over(upto)).drop("r")
    same(events.event_groups(rows, bits=1), expected)
    for df in (found, events.event_groups(rows, bits=1), quality.unsorted_neighbours(rows, "v", "ord", 1)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_unsorted(rows):
    before = F.lag("v").over(Window.orderBy("ord"))
    expected = rows.withColumn("b", before).filter("v < b").drop("b")
    for bits in (0, 4, 20):
        same(quality.unsorted_neighbours(rows, "v", "ord", bits), expected)


@pytest.mark.parametrize("bits", [1, 4])
@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_skewed_log_gives_the_same_chronicles(spark, bits, partitions):
    rng = random.Random(3)
    data = [
        (i, float(i // 3), rng.randrange(3), rng.choice([1, 2, 4]), 0.0 if rng.random() < 0.4 else float(rng.randrange(30)), 1 + i % 5)
        for i in range(400)
    ]
    flat = spark.createDataFrame(
        data, "ord bigint, time double, timeDelta int, kind int, place double, mutationId bigint"
    )
    log = golden.nested(flat).withColumn("eventKind", F.struct(F.col("kind").alias("encoded"))).drop("kind")
    expected = _by_hand(data)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = lifetimes.chronicles(log, bits=bits).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((r.particleId, r.parentId, r.birthTime, r.deathTime, r.position.x) for r in found)
    assert got == expected


def _by_hand(data):
    """Row by row: events, then neighbours at a position, then parents within an event."""
    event, delta, linear = 0, 0, []
    for order, time, d, kind, place, _ in data:
        event += d >= delta
        delta = d
        linear.append([order + 1, None, time, float("inf"), place, event, kind])
    last = {}
    for row in linear:
        if row[4] in last:
            last[row[4]][3] = row[2]
            row[1] = last[row[4]][0]
        last[row[4]] = row
    alive = [r for r in linear if r[6] != 2]
    parents = {}
    for r in alive:
        if r[1] is not None:
            parents.setdefault(r[5], []).append(r[1])
    out = []
    for r in alive:
        for parent in [r[1]] if r[1] is not None else parents.get(r[5], [0]):
            out.append((r[0], parent, r[2], r[3], r[4]))
    return sorted(out)


def test_lifetimes_at_one_position_do_not_overlap(spark):
    cells = lifetimes.chronicles(golden.log(spark), golden.initial(spark))
    window = Window.partitionBy("position").orderBy("birthTime")
    late = cells.withColumn("next", F.lead("birthTime").over(window)).filter("next < deathTime")
    assert late.count() == 0


def test_many_runs_in_one_job(spark):
    one = golden.log(spark)
    both = one.withColumn("run", F.lit("a")).unionByName(
        one.filter(F.col("ord") < 6).withColumn("run", F.lit("b"))
    )
    for bits in (20, 1):
        grouped = events.event_groups(both, keys=["run"], bits=bits)
        ids = {r: [x.eventId for x in grouped.filter(F.col("run") == r).orderBy("ord").collect()] for r in "ab"}
        assert ids == {"a": golden.EVENT_IDS, "b": golden.EVENT_IDS[:6]}
        found = lifetimes.chronicles(both, keys=["run"], bits=bits)
        alone = lifetimes.chronicles(one)
        assert golden.as_tuples(found.filter(F.col("run") == "a")) == golden.as_tuples(alone)
