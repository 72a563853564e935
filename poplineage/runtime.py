"""What operators need from the session: shared scratch space, cut lineage, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
import concurrent.futures
import contextlib
import tempfile
from typing import Any
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A folder of our own is made only in local mode, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="poplineage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/poplineage/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to shared storage and reads it back.

    Used where a result has several readers: they see the same rows after executor loss,
    prune columns on their own, and do not repeat the shuffles behind it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_counted(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``pin``, and named measures taken while the rows are written.

    A task that runs twice can raise them, so only use them where too large a number does no harm.
    """
    counted = Observation()
    pinned = pin(df.observe(counted, *measures), name)
    return pinned, counted.get


def _size(df: DataFrame) -> list[Column]:
    """Rows, and their bytes: eight for a number, the length of strings, binaries and what else is written out."""
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width += F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            width += F.coalesce(F.length(F.to_json(field.name)), F.lit(0))
        else:
            width += F.lit(8)
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")]


def _is_small(rows: int, size: int, max_rows: int) -> bool:
    return rows <= max_rows and size <= BROADCAST_BYTES


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it is counted to hold at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes.

    A larger table is returned unmarked, so that the join shuffles and AQE splits hot keys.
    Pass a pinned table or one that is cheap to count.
    """
    held = df.limit(max_rows + 1).agg(*_size(df)).first()
    return F.broadcast(df) if _is_small(held["rows"], held["bytes"], max_rows) else df


def small_table(df: DataFrame, name: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pins ``df`` and, like ``small_side``, marks it for broadcast if it is small.

    Rows and bytes are counted while they are written. A task that runs twice can only raise the count,
    which at worst leaves the table unmarked.
    """
    pinned, counted = pin_counted(df, name, *_size(df))
    return F.broadcast(pinned) if _is_small(counted["rows"], counted["bytes"], max_rows) else pinned


def side_by_side(*builds: Callable[[], Any]) -> list[Any]:
    """Results of builders that run jobs of their own and need nothing of each other, worked on at the same time."""
    with concurrent.futures.ThreadPoolExecutor(len(builds)) as pool:
        return list(pool.map(lambda build: build(), builds))


def write_counted(df: DataFrame, path: str) -> int:
    """Writes Parquet and returns the number of rows written."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return counted.get["rows"]


def save_buckets(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table in as many files as buckets, hashed and sorted by ``keys``: joins on them need no exchange on this side."""
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


@contextlib.contextmanager
def bucketed(df: DataFrame, keys: Sequence[str]) -> Iterator[DataFrame]:
    """``df`` in buckets by ``keys``, as many as a shuffle has partitions; its name is dropped at the end."""
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    table = "buckets_" + path.rsplit("-", 1)[1]
    try:
        yield save_buckets(df, table, path, keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    finally:
        spark.sql(f"drop table if exists {table}")
