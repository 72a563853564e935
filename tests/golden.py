"""A worked-out log of ten events on two initial cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poplineage.schemas import PARAMS

PLACES = {name: float(i) for i, name in enumerate("ABCDFG")}
# order, time, delta, kind, place, mutation
LOG = [
    (0, 1.0, 1, 4, "A", 1),
    (1, 1.0, 0, 1, "C", 2),
    (2, 2.0, 0, 2, "B", 1),
    (3, 2.5, 1, 4, "C", 2),
    (4, 2.5, 0, 1, "D", 3),
    (5, 3.0, 0, 2, "A", 1),
    (6, 3.5, 1, 4, "D", 3),
    (7, 3.5, 0, 1, "F", 4),
    (8, 4.0, 1, 4, "D", 3),
    (9, 4.0, 0, 1, "G", 3),
]
EVENT_IDS = [1, 1, 2, 3, 3, 4, 5, 5, 6, 6]
EVENT_IDS_STRICT = [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
INF = float("inf")
CHRONICLES = {
    (1, 0, -INF, 1.0, "A", 1),
    (2, 0, -INF, 2.0, "B", 1),
    (3, 1, 1.0, 3.0, "A", 1),
    (4, 1, 1.0, 2.5, "C", 2),
    (6, 4, 2.5, INF, "C", 2),
    (7, 4, 2.5, 3.5, "D", 3),
    (9, 7, 3.5, 4.0, "D", 3),
    (10, 7, 3.5, INF, "F", 4),
    (11, 9, 4.0, INF, "D", 3),
    (12, 9, 4.0, INF, "G", 3),
}
CLONES = {
    (0.0, 1, 2),
    (1.0, 1, 2),
    (1.0, 2, 1),
    (2.0, 1, 1),
    (2.0, 2, 1),
    (3.0, 2, 1),
    (3.0, 3, 1),
    (4.0, 2, 1),
    (4.0, 3, 2),
    (4.0, 4, 1),
}
TREE = {(1, 0, -INF), (2, 1, 1.0), (3, 2, 2.5), (4, 3, 3.5)}
STATS = {0.0: (1, 2, 0.0), 1.0: (2, 3, 0.918296), 2.0: (2, 2, 1.0), 3.0: (2, 2, 1.0), 4.0: (3, 4, 1.5)}
CARRIED = {(1, 4), (2, 4), (3, 3), (4, 1)}
WAITING = {1: -INF, 2: 1.0, 3: 1.5, 4: 1.0}


def nested(rows: DataFrame) -> DataFrame:
    """Places become positions, and each mutation gets parameters of its own."""
    zero = F.lit(0.0).cast("float")
    params = [(F.col("mutationId") / 10).cast("float").alias(p) for p in PARAMS]
    return rows.select(
        *[c for c in rows.columns if c != "place"],
        F.struct(F.col("place").cast("float").alias("x"), zero.alias("y"), zero.alias("z")).alias("position"),
        F.struct(*params).alias("cellParams"),
    )


def log(spark: SparkSession) -> DataFrame:
    rows = [(o, t, d, k, PLACES[p], m) for o, t, d, k, p, m in LOG]
    flat = spark.createDataFrame(
        rows, "ord bigint, time double, timeDelta int, kind int, place double, mutationId bigint"
    )
    return nested(flat).withColumn("eventKind", F.struct(F.col("kind").alias("encoded"))).drop("kind")


def initial(spark: SparkSession) -> DataFrame:
    rows = [(-2, PLACES["A"], 1), (-1, PLACES["B"], 1)]
    return nested(spark.createDataFrame(rows, "ord bigint, place double, mutationId bigint"))


def as_tuples(chronicles: DataFrame) -> set:
    place = {v: k for k, v in PLACES.items()}
    return {
        (r.particleId, r.parentId, r.birthTime, r.deathTime, place[r.position.x], r.mutationId)
        for r in chronicles.collect()
    }
