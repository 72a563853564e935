"""The given tables as inputs of the operators: events, clone snapshots, a mutation tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import pin
from ..schemas import PARAMS

# One multiplier per parameter; a mutation's parameters follow from its id.
MULTIPLIERS = (37, 101, 211, 307, 401, 503)
MODULUS = 997
EPOCH = "2024-01-01 00:00:00"
DAY_MICROS = 86_400_000_000.0
EVENT_MUTATIONS = 64


# Columns in use, declared so that no file has to be opened to plan a query.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "lineitem": "l_suppkey bigint, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def params_of(mutation: Column) -> Column:
    values = [
        ((mutation * m % MODULUS).cast("double") / F.lit(float(MODULUS))).cast("float").alias(p)
        for m, p in zip(MULTIPLIERS, PARAMS)
    ]
    return F.struct(*values)


def cell_events(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """``events`` as a cell-event log: users are positions, a signup creates, an error removes.

    With ``ordered`` the rows come in the order of ``ord``. They are sorted as they are read, and what follows from them
    is worked out behind the sort: its look for bounds and its exchange have the table's own columns only.
    """
    rows = table(spark, folder, "events")
    rows = rows.orderBy("event_id") if ordered else rows
    # A difference of local times, so that the session's time zone does not shift it.
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts)")
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).otherwise(4)
    mutation = F.col("event_id") % EVENT_MUTATIONS + 1
    return rows.select(
        F.col("event_id").alias("ord"),
        (micros / F.lit(DAY_MICROS)).alias("time"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("timeDelta"),
        F.struct(kind.cast("int").alias("encoded")).alias("eventKind"),
        F.struct(
            (F.col("user_id") % 10).cast("float").alias("x"),
            F.expr("user_id div 10").cast("float").alias("y"),
            F.lit(0.0).cast("float").alias("z"),
        ).alias("position"),
        mutation.alias("mutationId"),
        params_of(mutation).alias("cellParams"),
    )


def job_events(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """The log of the jobs: removals begin late, so that every mutation is there before, and a quarter of the rows are rare mutations."""
    at = F.col("ord")
    mutation = F.when(at % 4 == 0, at % 512).otherwise(at % 8) + 1
    kind = F.col("eventKind.encoded")
    late = F.struct(F.when((kind == 2) & (at < 512), 4).otherwise(kind).alias("encoded"))
    return cell_events(spark, folder, ordered).withColumns({"mutationId": mutation, "eventKind": late, "cellParams": params_of(mutation)})


def job_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One cell of the first mutation for each user, ahead of the rows of the log."""
    # The cells are read several times, and the log is not read again for them.
    users = pin(table(spark, folder, "events").select("user_id").distinct(), "users")
    size = users.agg(F.max("user_id") + 1).first()[0]
    mutation, user = F.lit(1).cast("long"), F.col("user_id")
    axes = [(user % 10).cast("float").alias("x"), F.expr("user_id div 10").cast("float").alias("y"), F.lit(0.0).cast("float").alias("z")]
    return users.select(
        (user - size).alias("ord"), F.struct(*axes).alias("position"), mutation.alias("mutationId"), params_of(mutation).alias("cellParams")
    )


def clone_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as clone snapshots: a time point per year, a clone per supplier."""
    counts = (
        table(spark, folder, "lineitem")
        .groupBy(F.year("l_shipdate").cast("double").alias("timePoint"), (F.col("l_suppkey") + 1).alias("mutationId"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.withColumn("cellParams", params_of(F.col("mutationId")))


def mutation_tree(spark: SparkSession, folder: str) -> DataFrame:
    """``supplier`` as a binary mutation tree."""
    mutation = F.col("s_suppkey") + 1
    return table(spark, folder, "supplier").select(
        mutation.alias("mutationId"),
        F.expr("(s_suppkey + 1) div 2").alias("parentMutationId"),
        F.when(F.col("s_suppkey") == 0, F.lit(float("-inf"))).otherwise(mutation / F.lit(4.0)).alias("time"),
        params_of(mutation).alias("cellParams"),
    )
