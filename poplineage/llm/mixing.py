"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions alone.

Each source has a budget of words. Every document is taken as many whole times as the budget covers the source, and
those with a hash under a threshold once more. The threshold is found without sorting: words are summed by source
and bucket of the hash, the bucket in which the budget ends is refined by the next bits, and so on through three
histograms of 4096 buckets; then documents are only filtered. A larger budget only raises the threshold, so mixes of
one corpus are nested.

The hash is MD5 of id and text, so reruns agree. Histograms are summed before the shuffle; a source with most of the
rows sends 4096 sums per task. The table of sources is joined as a broadcast only when counted small.

Defined cases: null text has no words and size 0; a null source is a source of its own, the last one; rows repeated with the same
id and text share a hash and are taken together; a source without words has target 0; the last bucket, which differs
in less than 2^-36 of the hash range, is taken whole if at least half of it fits. Columns that begin with ``_mix`` in the
input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import pin, small_table

#: Parameters: weights by place of the source, the share of all words to take, and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
#: Parameters of the histograms: 3 * 12 of the 60 bits of the hash that are used.
HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3

WORDS = r"[^\x20\x09-\x0D]+"


def with_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_mix_size`` in words and ``_mix_hash`` below 2^60."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return docs.withColumns(
        {
            "_mix_size": F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"),
            "_mix_hash": F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long"),
        }
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of a table with one row per source.

    Sources at their limit are those with the smallest limit for their weight; the level is the words per weight
    of the others, so that all targets together are the share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    weighed = weighed.withColumn("limit", F.col("source_size") * float(repeat))
    weighed = weighed.withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    levelled = weighed.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least("limit", F.coalesce(reached * F.col("weight"), F.col("limit")))
    return levelled.select("source", "source_size", target.alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, prefix): documents whose hash prefix is at most ``prefix`` get a copy more."""
    sizes = rows.groupBy("source").agg(F.sum("_mix_size").alias("source_size"))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    plan = targets(sizes).withColumn("copies", whole)
    plan = plan.withColumns({"left": F.col("target") - F.col("copies") * F.col("source_size"), "prefix": F.lit(0).cast("long")})
    plan = small_table(plan, "mix-plan")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        bounds = plan.select(F.col("source").alias("of"), "left", F.col("prefix").alias("within"))
        inside = rows.join(bounds, _same_source("source", "of") & (F.shiftright("_mix_hash", shift + LEVEL_BITS) == F.col("within")))
        histogram = inside.groupBy("source", F.shiftright("_mix_hash", shift).alias("bucket")).agg(
            F.sum("_mix_size").alias("words"), F.first("left").alias("left")
        )
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = histogram.withColumn("upto", F.sum("words").over(running)).filter("upto > left")
        ends = ends.groupBy("source").agg(F.min(F.struct("bucket", "words", "upto")).alias("end"))
        ends = ends.select(F.col("source").alias("of"), "end.*")
        plan = plan.join(ends, _same_source("source", "of"), "left").withColumns(
            {
                # without an end the budget covers all that is left, so the whole range is under the threshold
                "prefix": F.coalesce("bucket", F.shiftleft(F.col("prefix") + 1, LEVEL_BITS) - 1),
                "left": F.coalesce(F.col("left") - (F.col("upto") - F.col("words")), F.col("left")),
                "words": F.col("words"),
            }
        )
        plan = plan.select("source", "source_size", "target", "copies", "left", "prefix", "words")
        plan = small_table(plan, "mix-plan") if level == LEVELS else small_table(plan.drop("words"), "mix-plan")
    takes_last = F.col("words").isNull() | (F.col("left") * 2 >= F.col("words"))
    return plan.select("source", "source_size", "target", "copies", F.when(takes_last, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("prefix"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` beside the plan of their source, with ``_mix_copies``: how many times each is taken."""
    held = plan.withColumnsRenamed({"source": "_mix_source", "source_size": "_mix_source_size", "target": "_mix_target", "copies": "_mix_whole", "prefix": "_mix_prefix"})
    small = F.broadcast(held) if plan.limit(200_001).count() <= 200_000 else held
    joined = rows.join(small, _same_source("source", "_mix_source"), "left")
    under = F.shiftright("_mix_hash", HASH_BITS - LEVEL_BITS * LEVELS) <= F.col("_mix_prefix")
    return joined.withColumn("_mix_copies", F.col("_mix_whole") + F.when(under, 1).otherwise(0))


def plan_for(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without their texts, written once, and the plan of all sources."""
    rows = pin(with_hash(docs).select("doc_id", "source", "_mix_size", "_mix_hash"), "mix-rows")
    return rows, thresholds(rows)


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as many times as it is taken."""
    _, plan = plan_for(docs)
    taken = with_copies(with_hash(docs), plan).filter("_mix_copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_nth")).drop("_mix_nth")
