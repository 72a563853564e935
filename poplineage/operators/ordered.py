"""Order-dependent steps over whole tables without a whole table, or a hot group, in one task.

Rows are cut into chunks of ``2**bits`` neighbouring order numbers. A window runs inside each
chunk, and one small row per chunk carries values across the cuts. Chunks are cut in the same way into groups of
``2**bits``, and one row per group carries values across those, so no task holds more than a row for each 2^34 of the log.
The chunk of a row depends on its order number alone, so a task that is run again after a lost executor gives the same rows.

Order numbers are whole numbers that are dense, or dense in runs (row numbers of files or
partitions). Use ``numbered`` first for any other order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import pin, small_table

CHUNK_BITS = 17
_CHUNK = "__chunk"
_GROUP = "__group"
_HOT = "__hot"


def chunk_of(order: str, bits: int = CHUNK_BITS) -> Column:
    return F.shiftright(F.col(order), bits)


def one_window() -> Column:
    """The same for every group: what is left after two cuts is one row per group."""
    return F.shiftright(F.shiftrightunsigned(F.col(_GROUP), 1), 63)


def few_groups(tops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks the groups' table for broadcast where it has one row for each 2^34 order numbers, that is without keys."""
    return tops if keys else F.broadcast(tops)


def ahead(
    ends: DataFrame,
    keys: Sequence[str] = (),
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """For each chunk of ``ends`` what the chunks before it hold, under the names with ``__before_`` ahead: sums, and last set values."""
    parts = [*keys, _GROUP]
    grouped = ends.withColumn(_GROUP, F.shiftright(_CHUNK, bits))
    inside = Window.partitionBy(*parts).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.select(
        *parts,
        _CHUNK,
        *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__in_{s}") for s in sums],
        *[F.last(v, ignorenulls=True).over(inside).alias(f"__in_{v}") for v in lasts],
    )
    totals = grouped.groupBy(*parts).agg(
        *[F.sum(s).alias(s) for s in sums],
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(_CHUNK))).alias(v) for v in lasts],
    )
    wide = Window.partitionBy(*keys, one_window()).orderBy(_GROUP).rowsBetween(Window.unboundedPreceding, -1)
    tops = totals.select(
        *parts,
        *[F.coalesce(F.sum(s).over(wide), F.lit(0)).alias(f"__up_{s}") for s in sums],
        *[F.last(v, ignorenulls=True).over(wide).alias(f"__up_{v}") for v in lasts],
    )
    return local.join(few_groups(tops, keys), parts, "left").select(
        *keys,
        _CHUNK,
        *[(F.col(f"__in_{s}") + F.col(f"__up_{s}")).alias(f"__before_{s}") for s in sums],
        *[F.coalesce(f"__in_{v}", f"__up_{v}").alias(f"__before_{v}") for v in lasts],
    )


def numbered(df: DataFrame, by: Sequence[Column | str], out: str, start: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the dense row number of ``df`` in the order ``by``, by a range-partitioned sort; with ``keys``, one of its own for each key.

    The sorted rows are pinned with the number of their task and their place in it; the row counts and first
    places of each key in each task then turn that into running numbers. A key may lie in many tasks, and a task
    may hold many keys.
    """
    task, place, first = "__task", "__place", "__first"
    tagged = df.orderBy(*keys, *by).withColumn(place, F.monotonically_increasing_id())
    tagged = pin(tagged.withColumn(task, F.shiftright(place, 33)), "numbered")
    counts = tagged.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("__rows"), F.min(place).alias(first))
    earlier = Window.partitionBy(*keys).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, task, first, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    # Without keys one row per task of the sort: bounded by spark.sql.shuffle.partitions.
    offsets = small_table(offsets, "offsets") if keys else F.broadcast(offsets)
    joined = tagged.join(offsets, [*keys, task])
    return joined.withColumn(out, F.col(place) - F.col(first) + F.col("__before") + start).drop(task, place, first, "__before")


def running_sums(
    df: DataFrame, values: Mapping[str, Column], order: str, keys: Sequence[str] = (), bits: int = CHUNK_BITS
) -> DataFrame:
    """Adds, for each named value, its sum over all rows of the same keys up to and including this row.

    Rows with the same order number are peers and get the same sum.
    """
    parts = [*keys, _CHUNK]
    df = df.withColumns({_CHUNK: chunk_of(order, bits), **values})
    totals = df.groupBy(*parts).agg(*[F.sum(v).alias(v) for v in values])
    offsets = ahead(totals, keys, sums=list(values), bits=bits)
    inside = Window.partitionBy(*parts).orderBy(order)
    summed = df.withColumns({v: F.sum(v).over(inside) for v in values}).join(offsets, parts, "left")
    return summed.withColumns({v: F.col(v) + F.col(f"__before_{v}") for v in values}).drop(_CHUNK, *[f"__before_{v}" for v in values])


def running_sum(
    df: DataFrame,
    value: Column,
    order: str,
    out: str,
    keys: Sequence[str] = (),
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, {out: value}, order, keys, bits)


def fill_forward(
    df: DataFrame,
    values: Mapping[str, Column],
    order: str,
    keys: Sequence[str] = (),
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Adds, for each named value, its last non-null state at or before this row."""
    parts = [*keys, _CHUNK]
    df = df.withColumns({_CHUNK: chunk_of(order, bits), **values})
    # Rows without an order are passed over, so this is the last value that is set.
    last_set = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    carried = ahead(df.groupBy(*parts).agg(*last_set), keys, lasts=list(values), bits=bits)
    upto = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in values})
    joined = local.join(carried, parts, "left")
    return joined.withColumns({v: F.coalesce(F.col(v), F.col(f"__before_{v}")) for v in values}).drop(
        _CHUNK, *[f"__before_{v}" for v in values]
    )


def hot_groups(df: DataFrame, group: Sequence[str], bits: int = CHUNK_BITS) -> DataFrame:
    """(``__hot``): hashes of all groups that hold more rows than a chunk, counted exactly.

    Counts are summed before the shuffle. There is at most one such group per chunk of rows; they stay a
    table, which is broadcast only if it is counted small.
    """
    counts = df.groupBy(F.xxhash64(*group).alias(_HOT)).agg(F.count(F.lit(1)).alias("__rows"))
    return small_table(counts.filter(F.col("__rows") > (1 << bits)).select(_HOT), "hot")


def with_neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    bits: int = CHUNK_BITS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Adds values of the row before and of the row after within each group.

    Groups in the table ``hot`` (that of ``hot_groups`` when not given) are cut into chunks, and
    the values at the cuts are carried over; all others are one window partition each.
    Where there is no such row the value is null.
    """
    previous, following = dict(previous or {}), dict(following or {})
    hot = hot_groups(df, group, bits) if hot is None else hot
    any_hot = bool(hot.head(1))
    parts, is_hot = [*group, _CHUNK], F.col("__is_hot")
    if any_hot:
        marks = hot.withColumn("__is_hot", F.lit(True))
        df = df.withColumn(_HOT, F.xxhash64(*group)).join(marks, _HOT, "left").drop(_HOT)
        df = df.withColumn(_CHUNK, F.when(is_hot, chunk_of(order, bits)).otherwise(F.lit(0)))
    window = Window.partitionBy(*(parts if any_hot else group)).orderBy(order)
    local = {
        **{name: F.lag(value).over(window) for name, value in previous.items()},
        **{name: F.lead(value).over(window) for name, value in following.items()},
    }
    if not any_hot:
        return df.withColumns(local)
    cuts = {
        "__first": F.lag(F.lit(True)).over(window).isNull(),
        "__last": F.lead(F.lit(True)).over(window).isNull(),
    }
    # Value by value, so that the buffers stay fixed in size and Spark aggregates by hash.
    ends = df.filter(is_hot).groupBy(*parts).agg(
        *[F.max_by(value, order).alias(f"__{name}") for name, value in previous.items()],
        *[F.min_by(value, order).alias(f"__{name}") for name, value in following.items()],
    )
    along = Window.partitionBy(*group).orderBy(_CHUNK)
    carried = ends.select(
        *parts,
        *[F.lag(f"__{name}").over(along).alias(f"__{name}") for name in previous],
        *[F.lead(f"__{name}").over(along).alias(f"__{name}") for name in following],
    )
    joined = df.withColumns({**local, **cuts}).join(carried, parts, "left")
    mended = {
        **{n: F.when(F.col("__first"), F.col(f"__{n}")).otherwise(F.col(n)) for n in previous},
        **{n: F.when(F.col("__last"), F.col(f"__{n}")).otherwise(F.col(n)) for n in following},
    }
    return joined.withColumns(mended).drop(_CHUNK, "__is_hot", *cuts, *[f"__{n}" for n in mended])
