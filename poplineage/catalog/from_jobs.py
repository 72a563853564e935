"""All result tables of the jobs ``analyze`` and ``report``, on a log made of ``events``."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import HISTOGRAM_BINS
from ..plans import jobs
from ..runtime import scratch_path
from ..schemas import PARAMS
from ..sources import tables
from . import sql_views as S
from .from_counts import SCALARS, stats_of, unpivoted
from .from_files import flat_rows
from .registry import joined, plain, query, rounded
from .views import job_cells, job_events

THRESHOLD = 20
SHOWN = 11

_SQL = f"""with recursive {S.JOB_CHRON}, {S.POINTS}, {S.COVERED},
cs as (select mutationId, timePoint, count(*) as count, {S.params()} from covered group by mutationId, timePoint),
{S.TREE}, tr as (select *, {S.params()} from tree), {S.FINAL}, {S.PATHS}, {S.CARRIED}, {S.SUMMED},
big as (select mutationId from chron group by 1 having count(*) > {THRESHOLD}),
major as (select * from cs where mutationId in (select mutationId from big)),
noise as (select * from cs where mutationId not in (select mutationId from big)),
placed as (select mutationId, row_number() over (order by list_transform(ancestors, lambda a: -a)) - 1 as ordering
  from paths where mutationId in (select mutationId from big)),
shown as (select timePoint, case when mutationId in (select mutationId from big) then mutationId else 0 end as mutationId,
  sum(count)::bigint as count from cs group by 1, 2),
large_final as (select * from summary where mutationCount >= {THRESHOLD})"""


def analysis(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], str]:
    """The job's tables and their folder: run once in a session for each state of the events."""
    return _analysis(spark, folder, jobs.files_of(spark, f"{folder}/events.parquet"))


@functools.lru_cache(maxsize=None)
def _analysis(spark: SparkSession, folder: str, files: str) -> tuple[dict[str, DataFrame], str]:
    lines, log, out = (scratch_path(spark, name) for name in ("log", "converted", "analysis"))
    tables.save_csv(flat_rows(job_events(spark, folder, ordered=True)), lines)
    jobs.convert(spark, lines, log)
    return jobs.analyze(spark, log, out, THRESHOLD, initial=job_cells(spark, folder)), out


def _table(name: str):
    return lambda spark, folder: analysis(spark, folder)[0][name]


def _reported(name: str):
    return lambda spark, folder: jobs.report(analysis(spark, folder)[0], SHOWN, THRESHOLD)[name]


def _add(name: str, select: str, read, shape=lambda df: df, ctes: str = "") -> None:
    query(name, f"{_SQL}{ctes} {select}")(lambda spark, folder: shape(read(spark, folder)))


def _params(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *[rounded(f"cellParams.{p}", p) for p in PARAMS])


def _ancestors(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, joined("ancestors", "ancestors"))


_add(
    "analyze_chronicles",
    f"select particleId, parentId, birthTime, deathTime, mutationId, x, y, z, {S.rounded_params()} from (select *, {S.params()} from chron)",
    _table("chronicles"),
    lambda df: plain(df, "particleId", "parentId", "birthTime", "deathTime", "mutationId", *[rounded(f"cellParams.{p}", p) for p in PARAMS]),
)
_add("analyze_time_points", "select t as value from points", _table("time_points"))
_add(
    "analyze_clone_snapshots",
    f"select mutationId, timePoint, count, {S.rounded_params()} from cs",
    _table("clone_snapshots"),
    lambda df: _params(df, "mutationId", "timePoint", "count"),
)


def _histograms(part: str):
    """All six files of the part, as one table."""

    def read(spark: SparkSession, folder: str) -> DataFrame:
        out = analysis(spark, folder)[1]
        prefix = f"{out}/" if part == "clone" else f"{out}/threshold-{THRESHOLD}/{part}_"
        files = [tables.read_histogram(spark, f"{prefix}histogram_{p}.csv", HISTOGRAM_BINS).withColumn("parameter", F.lit(p)) for p in PARAMS]
        return functools.reduce(DataFrame.unionByName, files)

    return read


_BINS = ", ".join(f"coalesce(sum(count) filter (bin = {i}), 0)::bigint as _c{i}" for i in range(HISTOGRAM_BINS))
for _part, _rows in {"clone": "cs", "major": "major", "noise": "noise"}.items():
    _scalars = f", {stats_of(_rows)}"
    _add(
        f"analyze_{_part}_stats",
        "select * from stats",
        _table(f"{_part}_stats_scalars"),
        lambda df: df.select("timePoint", "cloneCount", "systemSize", *[rounded(c, c) for c in SCALARS]),
        _scalars,
    )
    _add(
        f"report_{_part}_entropy",
        """select timePoint, round((sum(count / n * -log2(count / n)) + 0.0) / nullif(log2(count(*)), 0), 5) as normalized_entropy
        from sized group by timePoint""",
        _reported("stats" if _part == "clone" else f"{_part}_stats"),
        lambda df: df.select("timePoint", F.round("normalized_entropy", 5).alias("normalized_entropy")),
        _scalars,
    )
    _add(
        f"analyze_{_part}_histograms",
        f"select parameter, {_BINS} from b group by timePoint, parameter",
        _histograms(_part),
        ctes=f""", {unpivoted(_rows)},
        b as (select timePoint, parameter, least(greatest(floor(v * 100::float), 0), 99)::int as bin, count from each)""",
    )

_add(
    "analyze_mutation_tree",
    f"select mutationId, parentMutationId, time, {S.rounded_params()} from tr",
    _table("mutation_tree"),
    lambda df: _params(df, "mutationId", "parentMutationId", "time"),
)
_add(
    "analyze_lineages",
    "select mutationId, array_to_string(ancestors, ',') as ancestors from paths",
    _table("lineages"),
    lambda df: _ancestors(df, "mutationId"),
)
_add(
    "analyze_large_clones",
    f"select mutationId, {S.rounded_params()} from (select *, {S.params()} from big)",
    _table("large_clones"),
    lambda df: _params(df, "mutationId"),
)
_add("analyze_large_muller_order", "select mutationId, ordering from placed", _table("large_muller_order"))
_add("analyze_muller_data_long", "select timePoint, mutationId, count from shown", _table("muller_data_long"))
_add(
    "analyze_muller_data",
    """select timePoint, (place // 1024)::bigint as block, string_agg(mutationId::varchar, ',' order by place) as ids,
      string_agg(count::varchar, ',' order by place) as counts from cells group by 1, 2""",
    _table("muller_data"),
    lambda df: df.select("timePoint", "block", joined("ids", "ids"), joined("counts", "counts")),
    """, ids as (select 0 as mutationId, 0 as place union all select mutationId, ordering + 1 from placed),
    cells as (select t.timePoint, i.mutationId, i.place, coalesce(s.count, 0) as count
      from (select distinct timePoint from cs) t join ids i on true left join shown s on s.timePoint = t.timePoint and s.mutationId = i.mutationId)""",
)


def _final_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    floats = ", ".join(f"{c} float" for c in PARAMS)
    read = spark.read.option("sep", ";").option("header", True).schema(f"x double, y double, z double, mutationId bigint, {floats}")
    return read.csv(f"{analysis(spark, folder)[1]}/final_snapshot.csv").select("x", "y", "z", "mutationId", *[rounded(p, p) for p in PARAMS])


_add(
    "analyze_final_snapshot",
    f"select x, y, z, mutationId, {S.rounded_params()} from (select *, {S.params()} from chron where deathTime = 'infinity')",
    _final_snapshot,
)
_add(
    "analyze_final_mutation_freq",
    "select a as ancestorMutationId, sum(n)::bigint as mutationCount from carrying group by a",
    _table("final_mutation_freq"),
    ctes=", carrying as (select unnest(p.ancestors) as a, f.count as n from paths p join final f using (mutationId))",
)
for _name, _from in {"clone_counts": "summary", "large_final_mutations": "large_final"}.items():
    _add(
        f"analyze_{_name}",
        f"""select mutationId, typeCount, mutationCount, array_to_string(ancestors, ',') as ancestors, time, waitingTime,
        {S.rounded_params()}, {", ".join(f"round(d{i}::double, 5) as change_{p}" for i, p in enumerate(PARAMS))} from {_from}""",
        _table(_name),
        lambda df: df.select(
            "mutationId", "typeCount", "mutationCount", joined("ancestors", "ancestors"), "time", "waitingTime",
            *[rounded(f"cellParams.{p}", p) for p in PARAMS],
            *[F.round(F.col(f"parameterUpgrades.{p}").cast("double"), 5).alias(f"change_{p}") for p in PARAMS],
        ),
    )

_add(
    "report_histogram_fractions",
    """select timePoint, parameter, bin, round(cells / sum(cells) over (partition by timePoint, parameter), 6) as fraction from b""",
    _reported("histogram_fractions"),
    lambda df: df.selectExpr("timePoint", f"stack({len(PARAMS)}, {', '.join(f'{chr(39)}{p}{chr(39)}, {p}' for p in PARAMS)}) as (parameter, h)")
    .select("timePoint", "parameter", F.posexplode("h").alias("bin", "f"))
    .filter("f > 0")
    .select("timePoint", "parameter", "bin", rounded("f", "fraction")),
    f""", {unpivoted("cs")}, b as (select timePoint, parameter, least(greatest(floor(v * 100::float), 0), 99)::int as bin,
      sum(count)::bigint as cells from each group by 1, 2, 3)""",
)
_add(
    "report_muller_fractions",
    "select timePoint, mutationId, count, round(count / sum(count) over (partition by timePoint), 6) as fraction from shown",
    _reported("muller_fractions"),
    lambda df: df.withColumn("fraction", F.round("fraction", 6)),
)
_add(
    "report_muller_params",
    f"select ordering, mutationId, {S.rounded_params()} from placed join tr using (mutationId)",
    _reported("muller_params"),
    lambda df: df.select("ordering", "mutationId", *[rounded(p, p) for p in PARAMS]),
)
_add(
    "report_top_mutations",
    f"select mutationId, mutationCount from large_final order by mutationCount desc, mutationId limit {SHOWN}",
    _reported("top_mutations"),
)
_add(
    "report_second_share",
    "select round(max(mutationCount) filter (n = 2) / max(mutationCount) filter (n = 1) * 100, 6) as percent from ranked",
    _reported("second_share"),
    lambda df: df.select(rounded("percent", "percent")),
    ", ranked as (select mutationCount, row_number() over (order by mutationCount desc, mutationId) as n from large_final)",
)
_add(
    "report_tree_vertices",
    f"select mutationId, typeCount, mutationCount, round((typeCount + 1) ** 0.25, 6) as size from large_final where mutationCount > {THRESHOLD}",
    _reported("tree_vertices"),
    lambda df: df.withColumn("size", F.round("size", 6)),
)
_add(
    "report_tree_edges",
    """select mutationId, ancestors[-2] as parentMutationId from drawn
    where len(ancestors) > 1 and ancestors[-2] in (select mutationId from drawn)""",
    _reported("tree_edges"),
    lambda df: df.select("mutationId", "parentMutationId"),
    f", drawn as (select * from large_final where mutationCount > {THRESHOLD})",
)
_add("report_tree_roots", "select mutationId from large_final where len(ancestors) = 1", _reported("tree_roots"))
