"""Snapshots as text in sections: a ``time = T`` line, a header line, a line per cell, a blank line."""

from __future__ import annotations

from collections.abc import Sequence
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import CHUNK_BITS, fill_forward
from ..runtime import small_table
from .event_log import in_log_order, with_source

# Fixed value: how a section begins.
TIME_PREFIX = "time = "


def _lines(spark: SparkSession, path: str, bits: int) -> DataFrame:
    """Lines with the time and first line number of their section."""
    lines = in_log_order(with_source(spark.read.text(path)))
    is_time = F.col("value").startswith(TIME_PREFIX)
    time = F.when(is_time, F.trim(F.substring("value", len(TIME_PREFIX) + 1, 1 << 30)).cast("double"))
    values = {"time": time, "section": F.when(is_time, F.col("ord"))}
    return fill_forward(lines, values, "ord", ["source_file"], bits)


def _body(lines: DataFrame, first: int) -> DataFrame:
    """Data lines; one ahead of any section fails the job."""
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith(TIME_PREFIX))
    lost = F.raise_error(F.lit("a line comes before the first time")).cast("boolean")
    inside = F.col("ord") >= F.col("section") + first
    return rows.filter(F.when(F.col("section").isNull(), lost).otherwise(inside))


def _split(column: str, delimiter: str, quotation: str, escape: str) -> Column:
    """Fields between delimiters that are neither quoted nor escaped.

    The line is matched from left to right in one pass, a delimiter and a field at a time. A doubled mark inside a field is one
    mark, and the escape character makes the next one ordinary; a mark without its partner is ordinary too.
    """
    if not quotation and not escape:
        return F.split(column, re.escape(delimiter), -1)
    d, q, e = (re.escape(c) for c in (delimiter, quotation, escape))
    special = [c for c in (q, e) if c]
    plain = rf"[^{d}{''.join(special)}]++"
    parts = [plain, *([rf"{e}."] if e else []), *([rf"{q}(?:[^{''.join(special)}]++{rf'|{e}.' if e else ''}|{q}{q})*+{q}"] if q else []), *special]
    field = rf"{d}((?:{'|'.join(parts)})*+)"
    ordinary = "|".join([*([rf"{q}(?={q})"] if q else []), *([e] if e else [])])

    def bare(part: Column) -> Column:
        part = F.trim(part)
        part = F.regexp_replace(part, rf"(?s)^{q}(.*){q}$", "$1") if q else part
        return F.trim(F.regexp_replace(part, rf"(?s)(?:{ordinary})(.)", "$1"))

    # Every match takes a delimiter with it, the first one as well.
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter), column), F.lit(f"(?s){field}"), F.lit(1))
    return F.transform(fields, bare)


def read_sections(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    delimiter: str = ",",
    quotation: str = '"',
    escape: str = "\\",
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """``time`` and the named columns, as doubles, one row per cell.

    Columns are found by name in the header of each section. A named column that a header lacks fails the
    job. If none are named, all columns of all headers are read, in the order in which they first
    appear, and are null in sections without them. A name that stands twice in a header fails the job, and so
    does a line with another number of fields than its header.
    """
    lines = _lines(spark, path, bits)
    headers = lines.filter(F.col("ord") == F.col("section") + 1).select(
        "section", _split("value", delimiter, quotation, escape).alias("names")
    )
    everything = columns is None
    if everything:
        # One row per name: as many as the result has columns.
        met = headers.select("section", F.posexplode("names").alias("place", "name")).groupBy("name")
        first = met.agg(F.min(F.struct("section", "place")).alias("first")).orderBy("first").collect()
        columns = [row["name"] for row in first]
    places = [_place(F.col("names"), c, everything) for c in columns]
    held = F.array(*places) if columns else F.array().cast("array<int>")
    # One row per section.
    sections = small_table(headers.select("section", F.size("names").alias("width"), held.alias("places")), "sections")
    rows = _body(lines, 2).join(sections, "section")
    fields = rows.select("time", "places", "width", _split("value", delimiter, quotation, escape).alias("fields"))
    wrong = F.raise_error(F.lit("a line has another number of fields than its header")).cast("boolean")
    fields = fields.filter(F.when(F.size("fields") == F.col("width"), True).otherwise(wrong))
    # Place 0 stands for a column that the section does not have.
    place = lambda i: F.nullif(F.col("places")[i], F.lit(0))
    picked = [F.element_at("fields", place(i)).cast("double").alias(c) for i, c in enumerate(columns)]
    return fields.select("time", *picked)


def _place(names: Column, column: str, may_lack: bool = False) -> Column:
    held = F.size(F.filter(names, lambda n: n == column))
    wrong = F.raise_error(F.lit(f"column {column} is missing or repeated in a section header"))
    wrong = F.when(held == 0, F.lit(0)).otherwise(wrong) if may_lack else wrong
    return F.when(held == 1, F.array_position(names, column).cast("int")).otherwise(wrong.cast("int"))


def read_points(spark: SparkSession, path: str, bits: int = CHUNK_BITS) -> DataFrame:
    """Sections without a header line: ``time, x, y`` from the first two blank-separated numbers."""
    fields = F.split(F.trim("value"), r"\s+")
    return _body(_lines(spark, path, bits), 1).select(
        "time", fields[0].cast("double").alias("x"), fields[1].cast("double").alias("y")
    )
