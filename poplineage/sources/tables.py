"""Result tables: computed once and kept, or written as Parquet, CSV and text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
import functools
import uuid

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import TimeGrid
from ..operators.snapshots import cells_by_time
from ..runtime import save_buckets, side_by_side, small_table
from ..schemas import PARAMS


# Rows of a file of lifetimes: about a hundred megabytes of text.
FILE_ROWS = 1_000_000


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished job has left its marker in the folder."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file of one line whole under a name of its own, then gives it the name ``path`` if nothing has it yet."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, made = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    files = made.getFileSystem(conf)
    if files.exists(target):
        return False
    out = files.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(files.makeQualified(made).toUri(), conf)
    try:
        context.rename(files.makeQualified(made), files.makeQualified(target), spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError:
        files.delete(made, False)
        if not files.exists(target):
            raise
        return False
    return True


def claimed(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written first if it is not there whole."""
    if not is_complete(spark, path):
        save_parquet(build(), path)
    return spark.read.parquet(path)


def save_parquet(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    (df.coalesce(1) if single_file else df).write.mode(mode).parquet(path)


def save_csv(
    df: DataFrame, path: str, single_file: bool = False, header: bool = True, compression: str = "none"
) -> None:
    """``;``-separated text with a header line."""
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    writer.option("sep", ";").option("header", header).option("compression", compression).csv(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Adds rows to a table, which an empty frame of the same columns may have begun."""
    save_parquet(df, path, mode="append")


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = 100) -> DataFrame:
    """A table hashed and sorted by ``key``, so that joins on it need no exchange on this side."""
    return save_buckets(df, table, path, [key], buckets)


def histogram_lines(stats: DataFrame, separator: str = ";") -> DataFrame:
    """Per time point and parameter, the bins joined to one line."""
    values = ", ".join(f"'{p}', histograms.{p}" for p in PARAMS)
    long_form = stats.select("timePoint", F.expr(f"stack({len(PARAMS)}, {values}) as (parameter, bins)"))
    return long_form.select("timePoint", "parameter", F.array_join("bins", separator).alias("line"))


def write_histograms(
    stats: DataFrame, prefix: str, separator: str = ";", single_file: bool = False, keys: Sequence[str] = ()
) -> None:
    """One text table per parameter, a line per time point in order; a folder for each key if there are any.

    All parameters are written at the same time: each is a short job of its own.
    """

    def write(param: str) -> None:
        line = F.array_join(f"histograms.{param}", separator).alias("value")
        lines = stats.orderBy(*keys, "timePoint").select(*keys, line)
        writer = (lines.coalesce(1) if single_file else lines).write.mode("overwrite").partitionBy(*keys)
        writer.text(f"{prefix}histogram_{param}.csv")

    side_by_side(*[functools.partial(write, param) for param in PARAMS])


def read_histogram(spark: SparkSession, path: str, bins: int, separator: str = ";") -> DataFrame:
    """Lines of bins without a header as columns ``_c0`` …."""
    schema = ", ".join(f"_c{i} bigint" for i in range(bins))
    return spark.read.option("sep", separator).schema(schema).csv(path)


def write_scalars(stats: DataFrame, path: str) -> None:
    """Scalar statistics as text, a line per time point in order."""
    save_csv(stats.orderBy("timePoint").select("scalarStats.*"), path, header=False)


def dealt_by_size(rows: DataFrame, group: str, spread: str, file_rows: int) -> DataFrame:
    """Rows laid together by ``group``, those of a large group in slices of about ``file_rows`` rows each.

    The slice follows from the column ``spread``. Written by ``group``, every slice is one file, however many tasks there are.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"))
    slices = sizes.select(group, F.ceil(F.col("__rows") / F.lit(file_rows)).alias("__slices"))
    placed = rows.join(small_table(slices, "slices"), group)
    place = F.pmod(F.xxhash64(spread), F.col("__slices"))
    return placed.withColumn("__slice", place).repartition(group, "__slice").drop("__slice", "__slices")


def write_snapshot_folders(chronicles: DataFrame, path: str, last: float, file_rows: int = FILE_ROWS) -> None:
    """Lifetimes that cover a whole time 0 … ``last``, ends excluded, in one CSV folder per time.

    The number of files follows the rows: one per time and ``file_rows`` rows.
    """
    grid = TimeGrid(float(int(max(last, 0.0))))
    rows = cells_by_time(chronicles, grid, bounds="open").select(
        F.format_string("%05d", F.col("timePoint").cast("int")).alias("snapshot"),
        "particleId",
        "parentId",
        "birthTime",
        "deathTime",
        "position.*",
        "mutationId",
        "cellParams.*",
    )
    writer = dealt_by_size(rows, "snapshot", "particleId", file_rows).write.mode("overwrite").partitionBy("snapshot")
    writer.option("sep", ";").option("header", True).csv(f"{path}/snapshots")
