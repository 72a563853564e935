"""Queries on ``supplier`` as a mutation tree, with ``lineitem`` as its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import muller, phylogeny, reports, snapshots, tour
from ..runtime import pin, side_by_side
from ..schemas import PARAMS
from . import sql_views as S
from .from_counts import NOISE_UP_TO
from .registry import joined, query, rounded
from .views import clone_counts, mutation_tree

BIG_CLONE = 620
DRAWN_ABOVE = 100

_PATHS_SQL = f"with recursive {S.TR}, {S.PATHS}"
_LINEAGES_SQL = f"{_PATHS_SQL} select mutationId, array_to_string(ancestors, ',') as ancestors from paths"


def paths_of(spark: SparkSession, folder: str, method: str = "doubling") -> DataFrame:
    return phylogeny.lineages(mutation_tree(spark, folder), method=method)


def tour_of(spark: SparkSession, folder: str, descending: bool = True) -> DataFrame:
    return tour.tour(mutation_tree(spark, folder), descending=descending)


def final_clones(spark: SparkSession, folder: str) -> DataFrame:
    counts = clone_counts(spark, folder)
    last = counts.agg(F.max("timePoint")).first()[0]
    return snapshots.clones_at(counts, last)


def big_clones(spark: SparkSession, folder: str) -> DataFrame:
    """Mutations with many cells over all time points."""
    totals = clone_counts(spark, folder).groupBy("mutationId").agg(F.sum("count").alias("total"))
    return pin(totals.filter(F.col("total") > BIG_CLONE).select("mutationId"), "big")


_BIG = f"big as (select mutationId from cs group by 1 having sum(count) > {BIG_CLONE})"


@query("lineages", _LINEAGES_SQL)
def lineages(spark, folder):
    return paths_of(spark, folder, "levels").select("mutationId", joined("ancestors", "ancestors"))


@query("lineages_doubling", _LINEAGES_SQL)
def lineages_doubling(spark, folder):
    return paths_of(spark, folder).select("mutationId", joined("ancestors", "ancestors"))


@query(
    "ancestry_of",
    f"""with recursive {S.CS}, {S.TR}, {S.PATHS}, {_BIG} select mutationId, array_to_string(ancestors, ',') as ancestors
    from paths where mutationId in (select mutationId from big)""",
)
def ancestry_of(spark, folder):
    wanted = phylogeny.ancestry_of(
        big_clones(spark, folder), mutation_tree(spark, folder).select("mutationId", "parentMutationId")
    )
    return wanted.select("mutationId", joined("ancestors", "ancestors"))


@query(
    "mutation_frequency",
    f"""with recursive {S.CS}, {S.FINAL}, {S.TR}, {S.PATHS}
    select a as ancestorMutationId, sum(n)::bigint as mutationCount from (
      select unnest(p.ancestors) as a, f.count as n from paths p join final f using (mutationId)) group by a""",
)
def mutation_frequency(spark, folder):
    return phylogeny.mutation_frequency(final_clones(spark, folder), tour_of(spark, folder))


def summary_of(spark: SparkSession, folder: str) -> DataFrame:
    links = mutation_tree(spark, folder)
    paths, tree = side_by_side(lambda: phylogeny.lineages(links), lambda: tour.tour(links))
    return phylogeny.mutation_summary(paths, tree, final_clones(spark, folder), links)


@query(
    "mutation_summary",
    f"""with recursive {S.SUMMARY} select mutationId, typeCount, mutationCount,
    array_to_string(ancestors, ',') as ancestors, time, waitingTime, {S.rounded_params()},
    {", ".join(f"round(d{i}::double, 5) as change_{p}" for i, p in enumerate(PARAMS))} from summary""",
)
def mutation_summary(spark, folder):
    return summary_of(spark, folder).select(
        "mutationId",
        "typeCount",
        "mutationCount",
        joined("ancestors", "ancestors"),
        "time",
        "waitingTime",
        *[rounded(f"cellParams.{p}", p) for p in PARAMS],
        *[F.round(F.col(f"parameterUpgrades.{p}").cast("double"), 5).alias(f"change_{p}") for p in PARAMS],
    )


_DESCENDING = "row_number() over (order by list_transform(ancestors, lambda a: -a)) - 1 as ordering"


@query("muller_order", f"{_PATHS_SQL} select mutationId, {_DESCENDING} from paths")
def muller_order(spark, folder):
    return muller.muller_order(tour_of(spark, folder))


@query(
    "muller_order_large",
    f"""with recursive {S.CS}, {S.TR}, {S.PATHS}, {_BIG}
    select mutationId, {_DESCENDING} from paths where mutationId in (select mutationId from big)""",
)
def muller_order_large(spark, folder):
    return muller.large_muller_order(tour_of(spark, folder), big_clones(spark, folder))


@query("ancestry_order", f"{_PATHS_SQL} select mutationId, row_number() over (order by ancestors) - 1 as ordering from paths")
def ancestry_order(spark, folder):
    return muller.muller_order(tour_of(spark, folder, descending=False))


_PLACED_SQL = """placed as (select mutationId, ancestors, row_number() over (order by list_transform(ancestors, lambda a: -a)) - 1 as pre from paths)"""


@query(
    "preorder",
    f"""{_PATHS_SQL}, {_PLACED_SQL}, inside as (select unnest(ancestors) as mutationId, pre as inner_pre from placed)
    select p.mutationId, p.pre, max(inner_pre) as last, (len(ancestors) - 1)::bigint as depth
    from placed p join inside using (mutationId) group by 1, 2, 4""",
)
def preorder(spark, folder):
    return tour_of(spark, folder)


@query(
    "subtree_intervals",
    f"""with recursive {S.CS}, {S.FINAL}, {S.TR}, {S.PATHS}, {_PLACED_SQL},
    inside as (select unnest(ancestors) as mutationId, mutationId as inner_id from paths)
    select i.mutationId, p.pre, count(*) as mutations, sum(coalesce(f.count, 0))::bigint as cells, sum(len(q.ancestors) - 1)::bigint as depths
    from inside i join placed p using (mutationId) join paths q on q.mutationId = i.inner_id left join final f on f.mutationId = i.inner_id
    group by 1, 2""",
)
def subtree_intervals(spark, folder):
    """Mutations, cells and summed depths of every subtree."""
    counted = phylogeny.subtree_counts(final_clones(spark, folder), tour_of(spark, folder))
    summed = tour.subtree_sums(counted, {"depths": F.col("depth")})
    mutations = (F.col("last") - F.col("pre") + 1).alias("mutations")
    return summed.select("mutationId", "pre", mutations, F.col("mutationCount").alias("cells"), "depths")


_SHOWN = f"""with recursive {S.CS}, {S.TR}, {S.PATHS}, {_BIG},
shown as (select timePoint, case when mutationId in (select mutationId from big) then mutationId else 0 end as mutationId,
  sum(count)::bigint as count from cs group by 1, 2)"""


def _large_order(spark: SparkSession, folder: str) -> DataFrame:
    return pin(muller.large_muller_order(tour_of(spark, folder), big_clones(spark, folder)), "order")


@query("muller_long", f"{_SHOWN} select timePoint, mutationId, count from shown")
def muller_long(spark, folder):
    return muller.collapsed(clone_counts(spark, folder), big_clones(spark, folder))


@query(
    "muller_pivot",
    f"""{_SHOWN}, placed as (select mutationId, {_DESCENDING} from paths where mutationId in (select mutationId from big)),
    ids as (select 0 as mutationId, 0 as place union all select mutationId, ordering + 1 from placed),
    cells as (select t.timePoint, i.mutationId, i.place, coalesce(s.count, 0) as count
      from (select distinct timePoint from cs) t join ids i on true left join shown s on s.timePoint = t.timePoint and s.mutationId = i.mutationId)
    select timePoint, (place // 16)::bigint as block, string_agg(mutationId::varchar, ',' order by place) as ids,
      string_agg(count::varchar, ',' order by place) as counts from cells group by 1, 2""",
)
def muller_pivot(spark, folder):
    blocks = muller.muller_pivot(clone_counts(spark, folder), _large_order(spark, folder), width=16)
    return blocks.select("timePoint", "block", joined("ids", "ids"), joined("counts", "counts"))


@query(
    "muller_fractions",
    f"""{_SHOWN} select timePoint, mutationId, count,
    round(count / sum(count) over (partition by timePoint), 6) as fraction from shown""",
)
def muller_fractions(spark, folder):
    shares = muller.long_fractions(clone_counts(spark, folder), big_clones(spark, folder))
    return shares.withColumn("fraction", F.round("fraction", 6))


@query(
    "muller_ordered_counts",
    f"""with recursive {S.CS}, {S.FINAL}, {S.TR}, {S.PATHS}, {_BIG},
    placed as (select mutationId, {_DESCENDING} from paths where mutationId in (select mutationId from big))
    select coalesce(ordering, -1) as ordering, sum(count)::bigint as count from (
      select p.ordering, coalesce(f.count, 0) as count from final f full join placed p using (mutationId)
      union all select null, 0) group by 1""",
)
def muller_ordered_counts(spark, folder):
    counts = muller.ordered_counts(final_clones(spark, folder), _large_order(spark, folder))
    return counts.withColumn("ordering", F.coalesce("ordering", F.lit(-1).cast("long")))


@query(
    "prevalence",
    f"""with recursive {S.CS}, {S.TR}, {S.PATHS},
    large as (select mutationId from cs group by 1 having max(count) > {NOISE_UP_TO}),
    placed as (select mutationId, row_number() over (order by ancestors) as place
      from paths where mutationId in (select mutationId from large)),
    shown as (select timePoint, mutationId, count from cs where mutationId in (select mutationId from large)
      union all select timePoint, 0, sum(case when mutationId in (select mutationId from large) then 0 else count end)
        from cs group by 1)
    select timePoint, coalesce(place, 0) as place, mutationId, count::bigint as count,
      round(count / sum(count) over (partition by timePoint), 6) as fraction
    from shown left join placed using (mutationId)""",
)
def prevalence(spark, folder):
    counts = clone_counts(spark, folder)
    shares = muller.prevalence(counts, paths_of(spark, folder), NOISE_UP_TO)
    return shares.withColumn("fraction", F.round("fraction", 6))


@query(
    "tree_edges",
    f"{_PATHS_SQL} select ancestors[-2] as parentMutationId, mutationId from paths where len(ancestors) > 1",
)
def tree_edges(spark, folder):
    return reports.tree_edges(paths_of(spark, folder))


@query("tree_roots", f"{_PATHS_SQL} select mutationId from paths where len(ancestors) = 1")
def tree_roots(spark, folder):
    return reports.tree_roots(paths_of(spark, folder))


@query(
    "tree_vertices",
    f"""with recursive {S.SUMMARY} select mutationId, typeCount, mutationCount,
    round((typeCount + 1) ** 0.25, 6) as size from summary""",
)
def tree_vertices(spark, folder):
    vertices = reports.tree_vertices(summary_of(spark, folder))
    return vertices.withColumn("size", F.round("size", 6))


@query(
    "subtree_over",
    f"""with recursive {S.SUMMARY}, shown as (select * from summary where mutationCount > {DRAWN_ABOVE})
    select mutationId, ancestors[-2] as parentMutationId from shown
    where len(ancestors) > 1 and ancestors[-2] in (select mutationId from shown)""",
)
def subtree_over(spark, folder):
    summary = pin(summary_of(spark, folder), "summary")
    return reports.subtree_over(summary, DRAWN_ABOVE)[1].select("mutationId", "parentMutationId")


@query(
    "subtree_vertices",
    f"""with recursive {S.SUMMARY} select mutationId, typeCount, mutationCount,
    round((typeCount + 1) ** 0.25, 6) as size from summary where mutationCount > {DRAWN_ABOVE}""",
)
def subtree_vertices(spark, folder):
    vertices = reports.subtree_over(summary_of(spark, folder), DRAWN_ABOVE)[0]
    return vertices.withColumn("size", F.round("size", 6))


@query(
    "large_final_mutations",
    f"""with recursive {S.SUMMARY} select mutationId, typeCount, mutationCount from summary
    where mutationCount >= {DRAWN_ABOVE}""",
)
def large_final_mutations(spark, folder):
    large = summary_of(spark, folder).filter(F.col("mutationCount") >= DRAWN_ABOVE)
    return large.select("mutationId", "typeCount", "mutationCount")


@query(
    "order_params",
    f"""with recursive {S.CS}, {S.TR}, {S.PATHS}, {_BIG},
    placed as (select mutationId, {_DESCENDING} from paths where mutationId in (select mutationId from big))
    select ordering, mutationId, {S.rounded_params()} from placed join tr using (mutationId)""",
)
def order_params(spark, folder):
    table = muller.param_table(_large_order(spark, folder), mutation_tree(spark, folder))
    return table.select("ordering", "mutationId", *[rounded(p, p) for p in PARAMS])
