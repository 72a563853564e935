"""Queries on ``lineitem`` as clone snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import fractions, weighted_avg, weighted_stddev
from ..operators import muller, stats
from ..runtime import pin
from ..schemas import PARAM_COLUMNS, PARAMS
from ..sources.tables import histogram_lines
from . import sql_views as S
from .registry import joined, query, rounded
from .views import clone_counts, table

NOISE_UP_TO = 95
TOP = 11


def stats_of(source: str) -> str:
    return f"""sized as (select *, sum(count) over (partition by timePoint)::double as n from {source}),
spread as (select *, {", ".join(f"sum(p{i}::double * count) over (partition by timePoint) / n as m{i}" for i in range(6))}
  from sized),
stats as (select timePoint, count(*) as cloneCount, max(n)::bigint as systemSize,
  round(sum(count / n * -log2(count / n)) + 0.0, 6) as entropy,
  {", ".join(f"round(max(m{i}), 6) as mean_{c}" for i, c in enumerate(PARAM_COLUMNS))},
  {", ".join(f"round(sqrt(sum(count * (p{i}::double - m{i}) ** 2) / (max(n) - 1)), 6) as stddev_{c}"
    for i, c in enumerate(PARAM_COLUMNS))}
  from spread group by timePoint)"""


STATS_SQL = f"with {S.CS},\n{stats_of('cs')}"
SCALARS = ("entropy", *[f"mean_{c}" for c in PARAM_COLUMNS], *[f"stddev_{c}" for c in PARAM_COLUMNS])


@query("system_size", f"with {S.CS} select timePoint, sum(count)::bigint as systemSize from cs group by 1")
def system_size(spark, folder):
    return stats.system_size(clone_counts(spark, folder))


@query("clone_stats", f"{STATS_SQL} select * from stats")
def clone_stats(spark, folder):
    scalars = stats.flat_scalars(stats.scalar_stats(clone_counts(spark, folder)))
    return scalars.select("timePoint", "cloneCount", "systemSize", *[rounded(c, c) for c in SCALARS])


@query(
    "normalized_entropy",
    f"""{STATS_SQL} select timePoint, round(entropy / nullif(log2(cloneCount), 0), 5) as normalized_entropy
    from stats""",
)
def normalized_entropy(spark, folder):
    scalars = stats.normalized_entropy(stats.flat_scalars(stats.scalar_stats(clone_counts(spark, folder))))
    return scalars.select("timePoint", F.round("normalized_entropy", 5).alias("normalized_entropy"))


@query(
    "weighted_avg",
    f"""with {S.CS} select mutationId, round(sum(timePoint * count) / sum(count), 6) as avg_time
    from cs group by mutationId""",
)
def weighted_average(spark, folder):
    average = weighted_avg(F.col("timePoint"), F.col("count"))
    return clone_counts(spark, folder).groupBy("mutationId").agg(rounded(average, "avg_time"))


@query(
    "weighted_stddev",
    f"""with {S.CS}, each as (select mutationId, timePoint, unnest(range(count)) as i from cs)
    select mutationId, round(stddev_samp(timePoint), 6) as stddev_time from each group by mutationId""",
)
def weighted_deviation(spark, folder):
    spread = weighted_stddev(F.col("timePoint"), F.col("count"), centre=2000.0)
    return clone_counts(spark, folder).groupBy("mutationId").agg(rounded(spread, "stddev_time"))


def unpivoted(source: str) -> str:
    each = [f"select timePoint, count, '{p}' as parameter, p{i} as v from {source}" for i, p in enumerate(PARAMS)]
    return f"each as ({' union all '.join(each)})"


UNPIVOTED = unpivoted("cs")
_BINNED = f"""{S.CS}, {UNPIVOTED},
binned as (select timePoint, parameter, least(greatest(floor(v * 100::float), 0), 99)::int as bin,
  sum(count)::bigint as cells from each group by 1, 2, 3)"""
_DENSE = f"""{_BINNED},
dense as (select t.timePoint, t.parameter, i as bin, coalesce(b.cells, 0) as cells
  from (select distinct timePoint, parameter from binned) t
  join (select unnest(range(100))::int as i) on true
  left join binned b on b.timePoint = t.timePoint and b.parameter = t.parameter and b.bin = i)"""


@query("histogram_100", f"with {_BINNED} select timePoint, parameter, bin, cells from binned")
def histogram_100(spark, folder):
    return stats.histograms(clone_counts(spark, folder))


def _lines_sql(separator: str) -> str:
    return f"""with {_DENSE} select timePoint, parameter,
    string_agg(cells::varchar, '{separator}' order by bin) as line from dense group by 1, 2"""


@query("histogram_lines", _lines_sql(";"))
def lines(spark, folder):
    return histogram_lines(stats.clone_stats(clone_counts(spark, folder)))


@query("histogram_lines_colon", _lines_sql(":"))
def lines_colon(spark, folder):
    return histogram_lines(stats.histogram_struct(clone_counts(spark, folder)), ":")


@query(
    "histogram_struct",
    f"""with {_DENSE}, l as (select timePoint, parameter, string_agg(cells::varchar, ',' order by bin) as line
      from dense group by 1, 2)
    select timePoint, {", ".join(f"max(line) filter (parameter = '{p}') as {p}" for p in PARAMS)} from l group by 1""",
)
def histogram_struct(spark, folder):
    arrays = stats.histogram_struct(clone_counts(spark, folder))
    return arrays.select("timePoint", *[joined(f"histograms.{p}", p) for p in PARAMS])


@query(
    "histogram_fractions",
    f"""with {_DENSE}, s as (select *, sum(cells) over (partition by timePoint, parameter) as n from dense)
    select timePoint, parameter, bin, round(cells / n, 6) as fraction from s""",
)
def histogram_fractions(spark, folder):
    arrays = stats.histogram_arrays(stats.histograms(clone_counts(spark, folder)))
    shares = arrays.select("timePoint", "parameter", F.posexplode(fractions(F.col("histogram"))).alias("bin", "f"))
    return shares.select("timePoint", "parameter", "bin", rounded("f", "fraction"))


#: The thousand bins of [0, 1) by their edges.
EDGES = """edges as (select i::int as bin, i / 1000::double as low, (i + 1) / 1000::double as high
  from (select unnest(range(1000)) as i))"""


@query(
    "histogram_1000_left",
    f"""with {S.CS}, {UNPIVOTED},
    {EDGES}, counted as (select timePoint, parameter, bin, sum(count) as cells from each
      join edges on low <= v::double and v::double < high group by 1, 2, 3)
    select timePoint, parameter, bin,
      round(cells / sum(cells) over (partition by timePoint, parameter), 6) as fraction from counted""",
)
def histogram_1000_left(spark, folder):
    arrays = stats.normalized_histograms(clone_counts(spark, folder))
    shares = arrays.select("timePoint", "parameter", F.posexplode("histogram").alias("bin", "f"))
    return shares.filter(F.col("f") > 0).select("timePoint", "parameter", "bin", rounded("f", "fraction"))


@query(
    "count_fractions",
    f"""with {S.CS} select timePoint, mutationId, count,
    round(count / sum(count) over (partition by timePoint), 6) as fraction from cs""",
)
def count_fractions(spark, folder):
    counts = clone_counts(spark, folder).select("timePoint", "mutationId", "count")
    return stats.count_fractions(counts).withColumn("fraction", F.round("fraction", 6))


_LARGE = f"large as (select mutationId from cs group by 1 having max(count) > {NOISE_UP_TO})"


@query("ever_large", f"with {S.CS}, {_LARGE} select mutationId from large")
def ever_large(spark, folder):
    return muller.ever_large(clone_counts(spark, folder), NOISE_UP_TO)


@query(
    "noise_series",
    f"""with {S.CS}, {_LARGE} select timePoint,
    case when mutationId in (select mutationId from large) then mutationId else 0 end as mutationId,
    sum(count)::bigint as count from cs group by 1, 2""",
)
def noise_series(spark, folder):
    return muller.noise_series(clone_counts(spark, folder), NOISE_UP_TO)


@query(
    "snapshot_counts",
    """select year(l_shipdate)::double as timePoint, l_suppkey + 1 as mutationId, count(*) as count
    from lineitem group by 1, 2""",
)
def snapshot_counts(spark, folder):
    items = table(spark, folder, "lineitem")
    cells = items.select(F.year("l_shipdate").cast("double").alias("time"), (F.col("l_suppkey") + 1).alias("mutationId"))
    return muller.snapshot_counts(cells)


_TOTALS = "totals as (select mutationId, sum(count)::bigint as mutationCount from cs group by 1)"


def _totals(spark, folder):
    return clone_counts(spark, folder).groupBy("mutationId").agg(F.sum("count").alias("mutationCount"))


@query(
    "top_mutations",
    f"""with {S.CS}, {_TOTALS} select mutationId, mutationCount from totals
    order by mutationCount desc, mutationId limit {TOP}""",
)
def top_mutations(spark, folder):
    return stats.top_mutations(_totals(spark, folder), TOP)


@query(
    "second_share",
    f"""with {S.CS}, {_TOTALS}, ranked as (
      select mutationCount, row_number() over (order by mutationCount desc, mutationId) as n from totals)
    select round(max(mutationCount) filter (n = 2) / max(mutationCount) filter (n = 1) * 100, 6) as percent
    from ranked""",
)
def second_share(spark, folder):
    share = stats.second_share(pin(_totals(spark, folder), "totals"))
    return share.select(rounded("percent", "percent"))
