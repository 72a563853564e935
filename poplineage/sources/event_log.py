"""Event logs as CSV or Parquet, with the order of their rows."""

from __future__ import annotations

from collections.abc import Sequence
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import to_events
from ..runtime import pin, small_table
from ..schemas import EVENT_LOG, INITIAL_FILE, PARENT_FILE

# Where a row came from: these three order the rows of all files.
SOURCE = ("source_file", "source_block", "source_row")
_SOURCE_FIELDS = [T.StructField(n, t) for n, t in zip(SOURCE, (T.StringType(), T.LongType(), T.LongType()))]
_CORRUPT = "malformed"
# Files whose ends can be looked at: Spark reads them whole for that.
MOST_BYTES = 1 << 30
# Runs of digits in file names up to this length are compared as numbers.
_DIGITS = 40


def _csv(spark: SparkSession, mode: str, header: bool = True):
    # Without column pruning off, a row is malformed or not depending on the columns asked for.
    return (
        spark.read.option("sep", ";")
        .option("header", header)
        .option("mode", mode)
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .option("columnPruning", False)
    )


def read_log_csv(spark: SparkSession, path: str, cut_off: bool = False) -> DataFrame:
    """Log rows of ``;``-separated files, compressed or not; malformed rows are dropped.

    With ``cut_off`` a file may end anywhere: its rows up to the break are read, and ``cut_files`` tells which ones do.
    Rows carry their source, so that ``in_log_order`` can number them.
    """
    reader = _csv(spark, "DROPMALFORMED").schema(EVENT_LOG)
    if cut_off:
        reader = reader.option("ignoreCorruptFiles", True)
    # Always true, but it needs all columns: a field is checked only if it is asked for.
    whole = F.xxhash64(*EVENT_LOG.names) >= F.lit(-(1 << 63))
    return with_source(reader.csv(path)).filter(whole)


def malformed_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The lines that ``read_log_csv`` drops."""
    schema = T.StructType([*EVENT_LOG.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = _csv(spark, "PERMISSIVE", header).schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).csv(path)
    # Stored with all columns: a field is checked only if it is asked for.
    return pin(rows.filter(F.col(_CORRUPT).isNotNull()), "malformed").select(_CORRUPT)


def read_log_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of Parquet files in the declared schema, with their source."""
    held = spark.read.parquet(path).columns
    if set(SOURCE) <= set(held):
        return spark.read.schema(T.StructType([*EVENT_LOG.fields, *_SOURCE_FIELDS])).parquet(path)
    rows = spark.read.schema(EVENT_LOG).parquet(path)
    return rows.select(
        *EVENT_LOG.names,
        F.col("_metadata.file_path").alias("source_file"),
        F.lit(0).cast("long").alias("source_block"),
        F.col("_metadata.row_index").alias("source_row"),
    )


def with_source(rows: DataFrame) -> DataFrame:
    """Adds file, block within it and a number that rises inside a block, for text-like sources."""
    return rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )


def natural_order(name: str = "source_file") -> Column:
    """Sort key of file names in which runs of digits count as numbers: 9 before 10, 99999 before 100000."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, F.greatest(F.length(p), F.lit(_DIGITS)), F.lit("0"))).otherwise(p))
    return F.array_join(padded, "")


def with_run(rows: DataFrame, root: str, out: str = "run") -> DataFrame:
    """Adds the name of the folder below ``root`` that a row's file lies in: one folder for each run of a campaign."""
    name = F.regexp_extract("source_file", re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/([^/]+)/", 1)
    lost = F.raise_error(F.concat(F.lit("no folder of a run: "), "source_file"))
    return rows.withColumn(out, F.when(name == "", lost.cast("string")).otherwise(name))


def in_log_order(rows: DataFrame, out: str = "ord", pinned: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Numbers rows from 0, for each key if there are any, in the order of file, block and row, without sorting or moving them.

    Files follow the natural order of their names; names that differ only in leading zeros fail the job.

    One row per block tells how many rows came before it. How files are cut into blocks may
    differ between two reads, so the rows are pinned first unless they are stored already.
    """
    rows = rows if pinned else pin(rows, "log")
    block = [*keys, "source_file", "source_block"]
    counts = rows.groupBy(*block).agg(
        F.count(F.lit(1)).alias("__rows"), F.min("source_row").alias("__first")
    )
    along = Window.partitionBy(*keys).orderBy("__name", *block)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")
    unclear = (F.lag("__name").over(along) == F.col("__name")) & (F.lag("source_file").over(along) != F.col("source_file"))
    failed = F.raise_error(F.concat(F.lit("no order between files of one name: "), "source_file")).cast("long")
    before = F.when(unclear, failed).otherwise(before)
    counts = counts.withColumn("__name", natural_order())
    starts = small_table(counts.select(*block, before.alias("__before")), "blocks")
    numbered = rows.join(starts, block)
    order = F.col("source_row") + F.col("__before")
    return numbered.withColumn(out, order).drop("__before", "source_block", "source_row")


def cut_files(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, lines, bytes, cut``: what can be read of each file, and whether its end is missing.

    A gzip file says in its last four bytes how long its text is (modulo 2^32); one that is cut off holds other bytes there. A plain
    file is cut if its last line is not ended. Each file is read by itself, so a broken one takes nothing from another.
    ``cut`` is null where that cannot be told: files above ``MOST_BYTES``, and gzip files put together from several whose sizes do
    not add up.
    """
    name = F.col("_metadata.file_path").alias("source_file")
    text = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).text(path).select("value", name)
    read = text.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes")
    )
    found = spark.read.format("binaryFile").load(path)
    sizes = found.select(name, "length")
    # The filter is handed to the source, which leaves longer files unread.
    held = found.filter(F.col("length") <= MOST_BYTES)
    last = [F.hex(F.substring("content", -k, 1)) for k in range(1, 5)]
    ends = held.select(
        name,
        F.conv(F.concat(*last), 16, 10).cast("long").alias("__size"),
        (F.substring("content", -1, 1) == F.lit(b"\n")).alias("__ended"),
        F.locate("1f8b0800", F.lower(F.hex("content")), 3).alias("__member"),
    )
    joined = sizes.join(ends, "source_file", "left").join(read, "source_file", "left").na.fill(0, ["lines", "bytes"])
    # One byte less where the last line has no end.
    said = (F.pmod("bytes", F.lit(1 << 32)) == F.col("__size")) | (F.pmod(F.col("bytes") - 1, F.lit(1 << 32)) == F.col("__size"))
    packed = F.when(~said & (F.col("__member") > 0), F.lit(None).cast("boolean")).otherwise(~said)
    plain = F.when(F.col("length") == 0, F.lit(False)).otherwise(~F.col("__ended"))
    cut = F.when(F.col("source_file").endswith(".gz"), packed).otherwise(plain)
    return joined.select("source_file", "lines", "bytes", cut.alias("cut"))


def without_last_rows(rows: DataFrame, files: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Drops the last row of every file that is cut, or may be: its writer may have left it incomplete. ``files`` is ``cut_files``."""
    cut = files.filter(F.coalesce("cut", F.lit(True))).select("source_file")
    last = rows.join(small_table(cut, "cut"), "source_file", "left_semi").groupBy("source_file").agg(F.max(F.struct(*order)).alias("__last"))
    joined = rows.join(small_table(last, "last"), "source_file", "left")
    return joined.filter(F.col("__last").isNull() | (F.struct(*order) < F.col("__last"))).drop("__last")


def convert_log(spark: SparkSession, source: str, target: str, cut_off: bool = False) -> None:
    """CSV log to Parquet, rows kept with their source.

    With ``cut_off`` files may end anywhere; the table of ``cut_files`` is left beside the log as ``<target>.files``.
    """
    if not cut_off:
        read_log_csv(spark, source).write.mode("overwrite").parquet(target)
        return
    cut_files(spark, source).write.mode("overwrite").parquet(f"{target}.files")
    files, rows = spark.read.parquet(f"{target}.files"), pin(read_log_csv(spark, source, True), "log")
    without_last_rows(rows, files, SOURCE[1:]).write.mode("overwrite").parquet(target)


def convert_campaign(spark: SparkSession, root: str, target: str) -> None:
    """The CSV logs of all runs, one folder each below ``root``, to one Parquet table with a folder for each ``run``."""
    rows = with_run(read_log_csv(spark, f"{root.rstrip('/')}/*"), root)
    rows.write.mode("overwrite").partitionBy("run").parquet(target)


def read_campaign(spark: SparkSession, path: str) -> DataFrame:
    """Nested events of all runs with ``run`` and their order number within it."""
    schema = T.StructType([*EVENT_LOG.fields, *_SOURCE_FIELDS, T.StructField("run", T.StringType())])
    ordered = in_log_order(spark.read.schema(schema).parquet(path), pinned=True, keys=["run"])
    return to_events(ordered.drop("source_file"))


def read_events(spark: SparkSession, path: str, kind: str = "parquet", cut_off: bool = False) -> DataFrame:
    """Nested events with their order number ``ord``."""
    if kind == "csv":
        ordered = in_log_order(read_log_csv(spark, path, cut_off))
        ordered = without_last_rows(ordered, cut_files(spark, path)) if cut_off else ordered
    elif kind == "parquet":
        ordered = in_log_order(read_log_parquet(spark, path), pinned=True)
    else:
        raise ValueError(f"unknown kind of log {kind!r}")
    return to_events(ordered.drop("source_file"))


def read_initial(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an initial-configuration file."""
    return _csv(spark, "FAILFAST", header=False).schema(INITIAL_FILE).csv(path)


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    """Parent table: child and parent per line, no header."""
    return spark.read.schema(PARENT_FILE).csv(path)
