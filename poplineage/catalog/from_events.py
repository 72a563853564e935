"""Queries on ``events`` as a cell-event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import kind_code, kind_label
from ..operators import chronicles as lifetimes
from ..operators import events, muller, phylogeny, quality, snapshots, stats, timepoints, tour
from ..runtime import pin
from ..schemas import PARAM_COLUMNS, PARAMS
from . import sql_views as S
from .registry import plain, query, rounded
from .views import cell_events, mutation_tree

SNAPSHOT_TIME = 15.0
LISTED_TIMES = (0.5, 3.0, 7.25, 15.0, 29.75)
LARGE = 125


def chronicle(spark: SparkSession, folder: str, **options) -> DataFrame:
    return lifetimes.chronicles(cell_events(spark, folder), **options)


def snapshot_table(spark: SparkSession, folder: str, **options) -> DataFrame:
    cells = stored_chronicle(spark, folder)
    return snapshots.clone_snapshots(cells, snapshots.time_grid(cells), **options)


def stored_chronicle(spark: SparkSession, folder: str) -> DataFrame:
    """The same, for queries that read it more than once."""
    return pin(chronicle(spark, folder), "chronicles")


LIFETIME = ("particleId", "parentId", "birthTime", "deathTime", "mutationId")
# No parent is shown as -1: a column of whole numbers with nulls reads as floats in some clients.
LINEAR_COLUMNS = """particleId, coalesce(parentId, -1) as parentId, birthTime, deathTime, mutationId, eventId,
  x, y, z"""


def no_parent_as_minus_one(linear: DataFrame) -> DataFrame:
    return linear.withColumn("parentId", F.coalesce("parentId", F.lit(-1).cast("long")))


_CHRON_COLUMNS = "particleId, parentId, birthTime, deathTime, mutationId, x, y, z"


@query("event_groups", f"with {S.groups()} select ord, eventId from grp")
def event_groups(spark, folder):
    return events.event_groups(cell_events(spark, folder)).select("ord", "eventId")


@query("event_groups_strict", f"with {S.groups('>')} select ord, eventId from grp")
def event_groups_strict(spark, folder):
    return events.event_groups(cell_events(spark, folder), strict=True).select("ord", "eventId")


@query(
    "initial_events",
    f"with {S.WITH_INITIAL} select ord, time, timeDelta, eventId, mutationId, eventKind, x, y, z from started",
)
def initial_events(spark, folder):
    start = events.initial_events(events.starting_snapshot(spark))
    rows = start.unionByName(events.event_groups(cell_events(spark, folder)))
    kind = F.col("eventKind.encoded").alias("eventKind")
    return plain(rows, "ord", "time", "timeDelta", "eventId", "mutationId", kind)


@query(
    "linear_chronicles",
    f"with {S.LINEAR} select {LINEAR_COLUMNS} from lin",
)
def linear_chronicles(spark, folder):
    linear = lifetimes.linear_chronicles(events.event_groups(cell_events(spark, folder)))
    return plain(no_parent_as_minus_one(linear), *LIFETIME, "eventId")


@query("chronicles", f"with {S.CHRON} select {_CHRON_COLUMNS} from chron")
def chronicles(spark, folder):
    return plain(chronicle(spark, folder), *LIFETIME)


@query("chronicles_kind_aware", f"with {S.CHRON_KIND_AWARE} select {_CHRON_COLUMNS} from chron")
def chronicles_kind_aware(spark, folder):
    return plain(chronicle(spark, folder, parent_rule="kind_aware"), *LIFETIME)


@query("chronicles_with_initial", f"with {S.CHRON_WITH_INITIAL} select {_CHRON_COLUMNS} from chron")
def chronicles_with_initial(spark, folder):
    return plain(chronicle(spark, folder, initial=events.starting_snapshot(spark)), *LIFETIME)


@query(
    "split_by_parent",
    f"""with {S.LINEAR} select particleId, coalesce(parentId, -1) as parentId,
      case when parentId is null then 'settler' else 'offspring' end as part from lin""",
)
def split_by_parent(spark, folder):
    linear = lifetimes.linear_chronicles(events.event_groups(cell_events(spark, folder)))
    offspring, settlers = lifetimes.split_by_parent(linear)
    none = F.lit(-1).cast("long").alias("parentId")
    return offspring.select("particleId", "parentId", F.lit("offspring").alias("part")).unionByName(
        settlers.select("particleId", none, F.lit("settler").alias("part"))
    )


@query(
    "sequence_anomalies",
    f"""with {S.EV}, seen as (select *, lag(ord) over (partition by x, y, z order by ord) as before from ev)
    select ord, eventKind, anomaly from (
      select ord, eventKind, case when before is null and eventKind = 2 then 'first_removed'
        when before is null and eventKind = 4 then 'first_transformed'
        when before is not null and eventKind = 1 then 'created_again' end as anomaly from seen)
    where anomaly is not null""",
)
def sequence_anomalies(spark, folder):
    found = quality.sequence_anomalies(cell_events(spark, folder))
    return found.select("ord", F.col("eventKind.encoded").alias("eventKind"), "anomaly")


@query(
    "repeated_particles",
    f"with {S.CHRON} select particleId, count(*) as rows from chron group by particleId having count(*) > 1",
)
def repeated_particles(spark, folder):
    return quality.repeated_particles(chronicle(spark, folder))


@query(
    "unsorted_events",
    f"""with {S.EV}, seen as (select ord, timeDelta, lag(timeDelta) over (order by ord) as before from ev)
    select ord, timeDelta from seen where timeDelta < before""",
)
def unsorted_events(spark, folder):
    return quality.unsorted_neighbours(cell_events(spark, folder), "timeDelta", "ord").select("ord", "timeDelta")


@query(
    "kind_labels",
    f"""with {S.EV} select ord, case eventKind when 1 then 'CREATED' when 2 then 'REMOVED'
      when 4 then 'TRANSFORMED' end as label, eventKind as code from ev""",
)
def kind_labels(spark, folder):
    labelled = cell_events(spark, folder).select("ord", kind_label(F.col("eventKind.encoded")).alias("label"))
    return labelled.withColumn("code", kind_code(F.col("label")))


@query("time_points", f"with {S.CHRON}, {S.POINTS} select t as value from points")
def time_points(spark, folder):
    return snapshots.time_points(chronicle(spark, folder))


@query(
    "snapshot_at",
    f"""with {S.CHRON} select mutationId, x, y, z from chron
    where birthTime <= {SNAPSHOT_TIME} and {SNAPSHOT_TIME} < deathTime""",
)
def snapshot_at(spark, folder):
    return plain(snapshots.snapshot_at(chronicle(spark, folder), SNAPSHOT_TIME), "mutationId")


@query(
    "snapshot_open",
    f"""with {S.CHRON}, {S.POINTS} select t as timePoint, particleId, parentId from chron
    join points on birthTime < t and t < deathTime""",
)
def snapshot_open(spark, folder):
    cells = stored_chronicle(spark, folder)
    rows = snapshots.cells_by_time(cells, snapshots.time_grid(cells), bounds="open")
    return rows.select("timePoint", "particleId", "parentId")


@query(
    "snapshot_closed_int",
    f"""with {S.CHRON}, {S.POINTS} select particleId, parentId, unnest(range(
      floor(greatest(0, birthTime))::int, floor(least(m, deathTime))::int + 1))::int as timePoint from chron, last""",
)
def snapshot_closed_int(spark, folder):
    cells = stored_chronicle(spark, folder)
    rows = snapshots.cells_by_time(cells, snapshots.time_grid(cells), bounds="closed_int")
    return rows.select("particleId", "parentId", "timePoint")


@query("cells_by_time", f"with {S.CHRON}, {S.POINTS}, {S.COVERED} select timePoint, particleId, parentId from covered")
def cells_by_time(spark, folder):
    cells = stored_chronicle(spark, folder)
    rows = snapshots.cells_by_time(cells, snapshots.time_grid(cells))
    return rows.select("timePoint", "particleId", "parentId")


@query(
    "time_point_lists",
    f"""with {S.CHRON}, {S.POINTS}, {S.COVERED}, l as (
      select particleId, parentId, string_agg(timePoint::int::varchar, ',' order by timePoint) as points
      from covered where timePoint < (select m from last) group by 1, 2)
    select c.particleId, c.parentId, coalesce(points, '') as points from chron c
    left join l on l.particleId = c.particleId and l.parentId = c.parentId""",
)
def time_point_lists(spark, folder):
    """Whole time points inside each lifetime, as one list."""
    cells = stored_chronicle(spark, folder)
    grid = snapshots.time_grid(cells)
    inside = grid.points_inside(F.col("birthTime"), F.col("deathTime"))
    whole = F.transform(F.filter(inside, lambda t: t < grid.last), lambda t: t.cast("int").cast("string"))
    return cells.select("particleId", "parentId", F.array_join(whole, ",").alias("points"))


_COUNTS_SQL = f"with {S.SNAPS} select mutationId, timePoint, count, {S.rounded_params()} from snaps"


def _counts(df: DataFrame) -> DataFrame:
    return df.select("mutationId", "timePoint", "count", *[rounded(f"cellParams.{p}", p) for p in PARAMS])


@query("clone_snapshots", _COUNTS_SQL)
def clone_snapshots(spark, folder):
    return _counts(snapshot_table(spark, folder, method="explode"))


@query("clone_snapshots_delta", _COUNTS_SQL)
def clone_snapshots_delta(spark, folder):
    return _counts(snapshot_table(spark, folder))


@query(
    "clone_snapshots_listed",
    f"""with {S.CHRON}, points as (select unnest({list(LISTED_TIMES)}::double[]) as t), {S.COVERED}
    select mutationId, timePoint, count(*) as count from covered group by 1, 2""",
)
def clone_snapshots_listed(spark, folder):
    """The points come as a table."""
    listed = spark.createDataFrame([(t,) for t in LISTED_TIMES], "value double")
    counts = snapshots.clone_snapshots(chronicle(spark, folder), timepoints.PointTable(listed))
    return counts.select("mutationId", "timePoint", "count")


@query(
    "clone_snapshots_at_events",
    f"""with {S.CHRON}, points as (select distinct time as t from ev where ord % 20 = 0), {S.COVERED}
    select mutationId, timePoint, count(*) as count from covered group by 1, 2""",
)
def clone_snapshots_at_events(spark, folder):
    """At the time of every twentieth row of the log: as many points as the log has rows for."""
    listed = cell_events(spark, folder).filter("ord % 20 = 0").select(F.col("time").alias("value"))
    counts = snapshots.clone_snapshots(chronicle(spark, folder), timepoints.PointTable(listed))
    return counts.select("mutationId", "timePoint", "count")


@query(
    "clone_snapshots_closed_int",
    f"""with {S.CHRON}, {S.POINTS}, covered as (
      select mutationId, unnest(range(floor(greatest(0, birthTime))::int, floor(least(m, deathTime))::int + 1))::int
        as timePoint from chron, last)
    select mutationId, timePoint, count(*) as count from covered group by 1, 2""",
)
def clone_snapshots_closed_int(spark, folder):
    return snapshot_table(spark, folder, bounds="closed_int").select("mutationId", "timePoint", "count")


@query(
    "clone_snapshot_at",
    f"""with {S.CHRON}, c as (select mutationId, count(*) as count, {S.params()} from chron
      where birthTime <= {SNAPSHOT_TIME} and {SNAPSHOT_TIME} < deathTime group by mutationId)
    select mutationId, count, {S.rounded_params()} from c""",
)
def clone_snapshot_at(spark, folder):
    counts = snapshots.clone_snapshot(snapshots.snapshot_at(chronicle(spark, folder), SNAPSHOT_TIME))
    return counts.select("mutationId", "count", *[rounded(f"cellParams.{p}", p) for p in PARAMS])


@query(
    "mutation_snapshots",
    f"""with {S.SNAPS} select timePoint, mutationId, count,
    {", ".join(f"round(p{i}::double, 6) as {c}" for i, c in enumerate(PARAM_COLUMNS))} from snaps""",
)
def mutation_snapshots(spark, folder):
    cells = stored_chronicle(spark, folder)
    rows = snapshots.mutation_snapshots(snapshots.cells_by_time(cells, snapshots.time_grid(cells)))
    return rows.select("timePoint", "mutationId", "count", *[rounded(c, c) for c in PARAM_COLUMNS])


@query(
    "final_clones",
    f"with {S.CHRON} select mutationId, count(*) as count from chron where deathTime = 'infinity' group by 1",
)
def final_clones(spark, folder):
    return snapshots.final_clone_snapshot(chronicle(spark, folder)).select("mutationId", "count")


@query(
    "final_cells",
    f"""with {S.CHRON} select x, y, z, mutationId, {S.rounded_params()} from (
      select *, {S.params()} from chron where deathTime = 'infinity')""",
)
def final_cells(spark, folder):
    cells = snapshots.final_cells(chronicle(spark, folder))
    axes = [F.col(a).cast("double").alias(a) for a in "xyz"]
    return cells.select(*axes, "mutationId", *[rounded(p, p) for p in PARAMS])


@query(
    "clones_at_last",
    f"with {S.SNAPS} select mutationId, count from snaps where abs(timePoint - (select m from last)) < 0.001",
)
def clones_at_last(spark, folder):
    cells = stored_chronicle(spark, folder)
    grid = snapshots.time_grid(cells)
    clones = snapshots.clones_at(snapshots.clone_snapshots(cells, grid), grid.last)
    return clones.select("mutationId", "count")


_BIG = f"big as (select mutationId from chron group by mutationId having count(*) > {LARGE})"


@query(
    "large_clones",
    f"""with {S.CHRON}, {_BIG} select mutationId, {S.rounded_params()}
    from (select *, {S.params()} from big)""",
)
def large_clones(spark, folder):
    large = muller.large_clones(chronicle(spark, folder), LARGE)
    return large.select("mutationId", *[rounded(f"cellParams.{p}", p) for p in PARAMS])


@query("mutation_sizes", f"with {S.CHRON} select mutationId, count(*) as mutationSize from chron group by 1")
def mutation_sizes(spark, folder):
    return muller.mutation_sizes(chronicle(spark, folder))


def _part_sql(member: str) -> str:
    return f"""with {S.SNAPS}, {_BIG},
    part as (select * from snaps where mutationId {member} (select mutationId from big)),
    sized as (select *, sum(count) over (partition by timePoint) as n from part)
    select timePoint, count(*) as cloneCount, max(n)::bigint as systemSize,
      round(sum(count / n * -log2(count / n)) + 0.0, 6) as entropy,
      round(sum(p0::double * count) / sum(count), 6) as mean_birth_efficiency
    from sized group by timePoint"""


def _part(spark: SparkSession, folder: str, which: int) -> DataFrame:
    cells = stored_chronicle(spark, folder)
    clones = snapshots.clone_snapshots(cells, snapshots.time_grid(cells))
    part = stats.major_and_noise(clones, pin(muller.large_clones(cells, LARGE), "large"))[which]
    scalars = stats.flat_scalars(stats.scalar_stats(part))
    return scalars.select(
        "timePoint",
        "cloneCount",
        "systemSize",
        rounded("entropy", "entropy"),
        rounded("mean_birth_efficiency", "mean_birth_efficiency"),
    )


@query("major_stats", _part_sql("in"))
def major_stats(spark, folder):
    return _part(spark, folder, 0)


@query("noise_stats", _part_sql("not in"))
def noise_stats(spark, folder):
    return _part(spark, folder, 1)


@query(
    "mutation_tree",
    f"""with {S.TREE_OF_EV} select mutationId, parentMutationId, time, {S.rounded_params()}
    from (select *, {S.params()} from tree)""",
)
def tree(spark, folder):
    edges = phylogeny.mutation_tree(stored_chronicle(spark, folder))
    return edges.select(
        "mutationId", "parentMutationId", "time", *[rounded(f"cellParams.{p}", p) for p in PARAMS]
    )


@query(
    "disconnected",
    f"""with recursive {S.TREE_OF_EV},
    reached as (select 1::bigint as id union
      select t.mutationId from tree t join reached r on t.parentMutationId = r.id)
    select mutationId, parentMutationId from tree where mutationId not in (select id from reached)""",
)
def disconnected(spark, folder):
    links = pin(phylogeny.mutation_tree(stored_chronicle(spark, folder)), "links")
    return phylogeny.disconnected(links).select("mutationId", "parentMutationId")


_SHOWN = "case when size < 125 then 0 else mutationId end"


def _cumulative(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    cells = stored_chronicle(spark, folder)
    order = muller.muller_order(tour.tour(mutation_tree(spark, folder)))
    shares = muller.muller_data(cells, order, snapshots.time_grid(cells, whole), min_cells=LARGE)
    return shares.select("mutationId", "timePoint", rounded("cumeDist", "cumeDist"))


def _cumulative_sql(points: str) -> str:
    return f"""with recursive {S.CHRON}, {points}, {S.COVERED}, {S.TR}, {S.PATHS},
    placed as (select mutationId, row_number() over (order by list_transform(ancestors, lambda a: -a)) - 1 as ordering
      from paths),
    sizes as (select mutationId, count(*) as size from chron group by 1),
    shown as (select {_SHOWN} as mutationId, timePoint from covered join sizes using (mutationId)),
    ranked as (select s.mutationId, s.timePoint, o.ordering,
        cume_dist() over (partition by s.timePoint order by o.ordering nulls first) as d
      from shown s left join placed o using (mutationId))
    select distinct mutationId, timePoint, round(d, 6) as cumeDist from ranked"""


_WHOLE_POINTS = "points as (select unnest(range(floor((select max(birthTime) from chron))::bigint + 1))::double as t)"


@query("muller_cume_dist_whole", _cumulative_sql(_WHOLE_POINTS))
def muller_cume_dist_whole(spark, folder):
    """At whole time points only."""
    return _cumulative(spark, folder, whole=True)


@query("muller_cume_dist", _cumulative_sql(S.POINTS))
def muller_cume_dist(spark, folder):
    return _cumulative(spark, folder, whole=False)
