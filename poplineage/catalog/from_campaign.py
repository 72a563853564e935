"""Queries on ``events`` as the logs of four runs (``user_id % 4``), all worked on together."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chronicles as lifetimes
from ..operators import muller, phylogeny, snapshots, stats, timepoints, tour
from ..plans import jobs
from ..runtime import pin, scratch_path, side_by_side
from ..sources import tables
from . import sql_views as S
from .from_counts import SCALARS
from .from_files import flat_log
from .registry import joined, query, rounded
from .views import cell_events

RUNS = 4
RUN = ["run"]
AT = ["run", "timePoint"]
LARGE = 12


def campaign_events(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all runs; a position is a user and belongs to one of them."""
    user = (F.col("position.y") * 10 + F.col("position.x")).cast("long")
    return cell_events(spark, folder).withColumn("run", F.concat(F.lit("seed-"), (user % RUNS).cast("string")))


def once(build):
    """Makes a table once in a session for each state of the events; the queries of a campaign share it."""
    kept = functools.lru_cache(maxsize=None)(lambda spark, folder, files: build(spark, folder))
    return lambda spark, folder: kept(spark, folder, jobs.files_of(spark, f"{folder}/events.parquet"))


@once
def cells_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    return pin(lifetimes.chronicles(campaign_events(spark, folder), keys=RUN), "chronicles")


@once
def links_of(spark: SparkSession, folder: str) -> DataFrame:
    return pin(phylogeny.mutation_tree(cells_of_runs(spark, folder), RUN), "links")


@once
def tour_of(spark: SparkSession, folder: str) -> DataFrame:
    return tour.tour(links_of(spark, folder), keys=RUN, strict=False)


@once
def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, timepoints.KeyedGrids]:
    cells = cells_of_runs(spark, folder)
    grid = timepoints.KeyedGrids(cells, RUN)
    return cells, pin(snapshots.clone_snapshots(cells, grid, keys=RUN), "clones"), grid


_CUBE = """cube as (select run, i, (i // 25 - 2)::double as x, (i // 5 % 5 - 2)::double as y, (i % 5 - 2)::double as z
  from (select distinct run, unnest(range(125)) as i from ev)),
started as (
  select run, i - 125 as ord, '-infinity'::double as time, i::int as timeDelta, 1 as eventKind, x, y, z, 1::bigint as mutationId, 0::bigint as eventId from cube
  union all
  select run, ord, time, timeDelta, eventKind, x, y, z, mutationId, eventId from grp)"""


def chronicle_sql(dense: bool = False) -> str:
    """Lifetimes of each run; with ``dense`` rows are numbered within a run, and the cube of first cells is ahead of them."""
    order = "row_number() over (partition by user_id % 4 order by event_id) - 1" if dense else "event_id"
    log = S.EV.replace("select event_id as ord", f"select 'seed-' || (user_id % {RUNS}) as run, {order} as ord")
    start, source, shift = (f"{_CUBE},", "started", 126) if dense else ("", "grp", 1)
    return f"""with recursive {log},
lagged as (select *, lag(timeDelta, 1, 0) over (partition by run order by ord) as before from ev),
grp as (select * exclude (before), sum((timeDelta >= before)::bigint) over (partition by run order by ord rows unbounded preceding)::bigint as eventId from lagged),
{start}
lin as (select * from (
  select run, ord + {shift} as particleId, lag(ord + {shift}) over here as parentId, time as birthTime, lead(time, 1, 'infinity'::double) over here as deathTime,
    mutationId, eventId, eventKind from {source} window here as (partition by run, x, y, z order by eventId, ord)) where eventKind <> 2),
chron as (
  select s.run, s.particleId, coalesce(o.parentId, 0) as parentId, s.birthTime, s.deathTime, s.mutationId
  from (select * from lin where parentId is null) s
  left join (select run, eventId, parentId from lin where parentId is not null) o using (run, eventId)
  union all
  select run, particleId, parentId, birthTime, deathTime, mutationId from lin where parentId is not null),
last as (select run, max(birthTime) as m from chron group by run),
points as (
  select run, t from (select run, unnest(range(greatest(ceil(m)::bigint, 0)))::double as t, m from last) where t < m
  union all select run, m from last),
covered as (select c.*, p.t as timePoint from chron c join points p on c.run = p.run and c.birthTime <= p.t and p.t < c.deathTime),
cs as (select run, mutationId, timePoint, count(*) as count, {S.params()} from covered group by run, mutationId, timePoint),
branches as (
  select c.run, c.mutationId, c.birthTime as time, c.particleId, c.parentId, coalesce(p.mutationId, 0) as parentMutationId
  from chron c left join chron p on c.run = p.run and c.parentId = p.particleId where c.mutationId <> coalesce(p.mutationId, 0)),
tree as (select run, mutationId, parentMutationId, time from (
    select *, row_number() over (partition by run, mutationId order by time, particleId, parentId, parentMutationId) as n from branches) where n = 1),
paths as (
  select distinct run, 1::bigint as mutationId, [1::bigint] as ancestors from tree
  union all
  select t.run, t.mutationId, list_append(p.ancestors, t.mutationId)
  from tree t join paths p on t.run = p.run and t.parentMutationId = p.mutationId where t.mutationId <> 1),
preorder as (select *, row_number() over (partition by run order by list_transform(ancestors, lambda a: -a)) - 1 as pre from paths)"""


_SQL = chronicle_sql()
_BIG = f"big as (select run, mutationId from chron group by 1, 2 having count(*) > {LARGE})"
_PLACED = """placed as (select run, mutationId, row_number() over (partition by run order by pre) - 1 as ordering
  from preorder semi join big using (run, mutationId))"""
_FINAL = "final as (select run, mutationId, count from cs join last using (run) where abs(timePoint - m) < 0.001)"
_CARRIED = """carried as (select run, a as mutationId, sum(n)::bigint as cells, count(n) as clones from (
    select p.run, unnest(p.ancestors) as a, f.count as n from paths p left join final f using (run, mutationId)) group by 1, 2)"""


@query("campaign_chronicles", f"{_SQL} select run, particleId, parentId, mutationId, birthTime, deathTime from chron")
def campaign_chronicles(spark, folder):
    return cells_of_runs(spark, folder).select(*RUN, "particleId", "parentId", "mutationId", "birthTime", "deathTime")


@query("campaign_time_points", f"{_SQL} select run, t as value from points")
def campaign_time_points(spark, folder):
    return timepoints.KeyedGrids(cells_of_runs(spark, folder), RUN).points()


@query("campaign_clone_snapshots", f"{_SQL} select run, mutationId, timePoint, count from cs")
def campaign_clone_snapshots(spark, folder):
    return _snapshots(spark, folder)[1].select(*AT, "mutationId", "count")


def campaign_stats_of(source: str) -> str:
    return f"""sized as (select *, sum(count) over (partition by run, timePoint)::double as n from {source}),
spread as (select *, {", ".join(f"sum(p{i}::double * count) over (partition by run, timePoint) / n as m{i}" for i in range(6))} from sized)
select run, timePoint, count(*) as cloneCount, max(n)::bigint as systemSize, round(sum(count / n * -log2(count / n)) + 0.0, 6) as entropy,
  {", ".join(f"round(max(m{i}), 6) as {c}" for i, c in enumerate(SCALARS[1:7]))},
  {", ".join(f"round(sqrt(sum(count * (p{i}::double - m{i}) ** 2) / (max(n) - 1)), 6) as {c}" for i, c in enumerate(SCALARS[7:]))}
  from spread group by run, timePoint"""


@query("campaign_stats", f"{_SQL}, {campaign_stats_of('cs')}")
def campaign_stats(spark, folder):
    scalars = stats.flat_scalars(stats.scalar_stats(_snapshots(spark, folder)[1], AT), AT)
    return scalars.select(*AT, "cloneCount", "systemSize", *[rounded(c, c) for c in SCALARS])


@query("campaign_tree", f"{_SQL} select run, mutationId, parentMutationId, time from tree")
def campaign_tree(spark, folder):
    return links_of(spark, folder).select(*RUN, "mutationId", "parentMutationId", "time")


_LINEAGES_SQL = f"{_SQL} select run, mutationId, array_to_string(ancestors, ',') as ancestors from paths"


def _lineages(spark: SparkSession, folder: str, method: str) -> DataFrame:
    paths = phylogeny.lineages(links_of(spark, folder), method=method, strict=False, keys=RUN)
    return paths.select(*RUN, "mutationId", joined("ancestors", "ancestors"))


@query("campaign_lineages", _LINEAGES_SQL)
def campaign_lineages(spark, folder):
    return _lineages(spark, folder, "doubling")


@query("campaign_lineages_levels", _LINEAGES_SQL)
def campaign_lineages_levels(spark, folder):
    return _lineages(spark, folder, "levels")


@query(
    "campaign_preorder",
    f"""{_SQL}, inside as (select run, unnest(ancestors) as mutationId, pre as inner_pre from preorder)
    select run, mutationId, p.pre, max(inner_pre) as last, (len(ancestors) - 1)::bigint as depth
    from preorder p join inside using (run, mutationId) group by 1, 2, 3, 5""",
)
def campaign_preorder(spark, folder):
    return tour_of(spark, folder)


@query("campaign_order", f"{_SQL}, {_BIG}, {_PLACED} select run, mutationId, ordering from placed")
def campaign_order(spark, folder):
    large = muller.large_clones(cells_of_runs(spark, folder), LARGE, RUN)
    return muller.large_muller_order(tour_of(spark, folder), large, RUN)


@query(
    "campaign_pivot",
    f"""{_SQL}, {_BIG}, {_PLACED},
    shown as (select run, timePoint, coalesce(p.mutationId, 0) as mutationId, sum(count)::bigint as count
      from cs left join placed p using (run, mutationId) group by 1, 2, 3),
    ids as (select distinct run, 0::bigint as mutationId, 0::bigint as place from chron union all select run, mutationId, ordering + 1 from placed),
    cells as (select t.run, t.timePoint, i.mutationId, i.place, coalesce(s.count, 0) as count
      from (select distinct run, timePoint from cs) t join ids i using (run)
      left join shown s on s.run = t.run and s.timePoint = t.timePoint and s.mutationId = i.mutationId)
    select run, timePoint, (place // 4)::bigint as block, string_agg(mutationId::varchar, ',' order by place) as ids,
      string_agg(count::varchar, ',' order by place) as counts from cells group by 1, 2, 3""",
)
def campaign_pivot(spark, folder):
    cells, clones, _ = _snapshots(spark, folder)
    order = pin(muller.large_muller_order(tour_of(spark, folder), muller.large_clones(cells, LARGE, RUN), RUN), "order")
    blocks = muller.muller_pivot(clones, order, width=4, keys=RUN)
    return blocks.select(*AT, "block", joined("ids", "ids"), joined("counts", "counts"))


@query(
    "campaign_cume_dist",
    f"""{_SQL}, sizes as (select run, mutationId, count(*) as size from chron group by 1, 2),
    shown as (select run, case when size < {LARGE} then 0 else mutationId end as mutationId, timePoint from covered join sizes using (run, mutationId)),
    ranked as (select s.run, s.mutationId, s.timePoint,
        cume_dist() over (partition by s.run, s.timePoint order by o.pre nulls first) as d
      from shown s left join preorder o using (run, mutationId))
    select distinct run, mutationId, timePoint, round(d, 6) as cumeDist from ranked""",
)
def campaign_cume_dist(spark, folder):
    cells = cells_of_runs(spark, folder)
    order = muller.muller_order(tour_of(spark, folder), RUN)
    shares = muller.muller_data(cells, order, timepoints.KeyedGrids(cells, RUN), min_cells=LARGE, keys=RUN)
    return shares.select(*AT, "mutationId", rounded("cumeDist", "cumeDist"))


@query(
    "campaign_frequency",
    f"{_SQL}, {_FINAL}, {_CARRIED} select run, mutationId as ancestorMutationId, cells as mutationCount from carried where clones > 0",
)
def campaign_frequency(spark, folder):
    cells, clones, grid = _snapshots(spark, folder)
    last = grid.points().groupBy(*RUN).agg(F.max("value").alias("value"))
    return phylogeny.mutation_frequency(snapshots.clones_at_last(clones, last, RUN), tour_of(spark, folder), RUN)


@once
def analysis(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], str]:
    """The job's tables and their folder, from one folder of text for each run."""
    root, out = scratch_path(spark, "campaign"), scratch_path(spark, "analysis")
    rows = pin(campaign_events(spark, folder), "rows")
    write = lambda k: tables.save_csv(flat_log(rows.filter(F.col("run") == f"seed-{k}")), f"{root}/seed-{k}")
    side_by_side(*[functools.partial(write, k) for k in range(RUNS)])
    return jobs.campaign(spark, root, out, LARGE, connected=False), out


_JOB_SQL = chronicle_sql(dense=True)


@query("campaign_job_chronicles", f"{_JOB_SQL} select run, particleId, parentId, mutationId, birthTime, deathTime from chron")
def campaign_job_chronicles(spark, folder):
    return analysis(spark, folder)[0]["chronicles"].select(*RUN, "particleId", "parentId", "mutationId", "birthTime", "deathTime")


@query(
    "campaign_job_stats",
    f"""{_JOB_SQL}, sized as (select *, sum(count) over (partition by run, timePoint)::double as n from cs)
    select run, timePoint, count(*) as cloneCount, max(n)::bigint as systemSize, round(sum(count / n * -log2(count / n)) + 0.0, 6) as entropy
    from sized group by run, timePoint""",
)
def campaign_job_stats(spark, folder):
    return analysis(spark, folder)[0]["clone_stats_scalars"].select(*AT, "cloneCount", "systemSize", rounded("entropy", "entropy"))


@query("campaign_job_order", f"{_JOB_SQL}, {_BIG}, {_PLACED} select run, mutationId, ordering from placed")
def campaign_job_order(spark, folder):
    return analysis(spark, folder)[0]["large_muller_order"]


@query(
    "campaign_job_top",
    f"""{_JOB_SQL}, {_FINAL}, {_CARRIED} select run, mutationId, mutationCount from (
      select run, mutationId, coalesce(cells, 0) as mutationCount, row_number() over (partition by run order by coalesce(cells, 0) desc, mutationId) as n
      from carried where mutationId in (select mutationId from tree t where t.run = carried.run) and coalesce(cells, 0) >= {LARGE}) where n <= 5""",
)
def campaign_job_top(spark, folder):
    return jobs.report(analysis(spark, folder)[0], shown=5, keys=RUN)["top_mutations"]


@query(
    "campaign_job_summary",
    f"""{_JOB_SQL}, {_FINAL}, {_CARRIED} select run, mutationId, coalesce(f.count, 0)::bigint as typeCount, coalesce(cells, 0)::bigint as mutationCount,
      array_to_string(ancestors, ',') as ancestors, t.time, t.time - greatest(0, coalesce(u.time, 0)) as waitingTime
    from tree t join paths p using (run, mutationId) left join carried c using (run, mutationId) left join final f using (run, mutationId)
    left join tree u on u.run = t.run and u.mutationId = t.parentMutationId""",
)
def campaign_job_summary(spark, folder):
    summary = analysis(spark, folder)[0]["clone_counts"]
    return summary.select(*RUN, "mutationId", "typeCount", "mutationCount", joined("ancestors", "ancestors"), "time", "waitingTime")
