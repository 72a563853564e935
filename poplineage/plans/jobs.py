"""The five jobs: convert a log, build chronicles, analyze them, make report tables, read snapshot text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import fractions
from ..functions.intervals import TimeGrid
from ..operators import chronicles as lifetimes
from ..operators import events, muller, phylogeny, reports, snapshots, stats, timepoints, tour
from ..runtime import pin, side_by_side
from ..sources import event_log, snapshot_text, tables
from ..sources.tables import materialize

MUTATION_COLUMN = "mutation.id"
# Names of the parameters in snapshot text.
TEXT_PARAMS = (
    "birth.efficiency",
    "birth.resistance",
    "lifespan.efficiency",
    "lifespan.resistance",
    "success.efficiency",
    "success.resistance",
)
TEXT_BINS = 1000
SHOWN_MUTATIONS = 11


def convert(spark: SparkSession, source: str, target: str, cut_off: bool = False) -> None:
    """CSV log to Parquet; with ``cut_off`` files may be broken off, and a table beside it tells which ones are."""
    event_log.convert_log(spark, source, target, cut_off)


def chronicle(
    spark: SparkSession,
    log: str,
    out: str,
    initial: DataFrame | None = None,
    strict: bool = False,
    parent_rule: str = "previous_row",
) -> DataFrame:
    """Parquet log to ``chronicles.parquet``; reads the table if it is already there.

    The folder keeps what its tables were made from, and refuses any other log, start or rule.
    """
    cells = events.starting_snapshot(spark) if initial is None else initial
    _belongs(spark, out, f"{files_of(spark, log)} {strict} {parent_rule} {_content(cells)}")

    def build() -> DataFrame:
        rows = event_log.read_events(spark, log)
        return lifetimes.chronicles(rows, cells, strict=strict, parent_rule=parent_rule)

    return materialize(spark, f"{out}/chronicles.parquet", build)


def _lifetimes(
    spark: SparkSession, log: str, out: str, initial: DataFrame | None, strict: bool, parent_rule: str, keys: Sequence[str]
) -> DataFrame:
    """The chronicles of one run, or those of a campaign by ``run``."""
    if not keys:
        return chronicle(spark, log, out, initial, strict, parent_rule)
    rows = event_log.read_campaign(spark, log)
    cells = events.starting_snapshot(spark, rows.select(*keys).distinct()) if initial is None else initial
    _belongs(spark, out, f"{files_of(spark, log)} {strict} {parent_rule} {_content(cells)}")
    build = lambda: lifetimes.chronicles(rows, cells, keys, strict=strict, parent_rule=parent_rule)
    return materialize(spark, f"{out}/chronicles.parquet", build)


def files_of(spark: SparkSession, path: str) -> str:
    """Number of the files below ``path`` and a sum over their names, sizes and times: another one for rewritten files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # The content is not asked for, so only the files' entries are read.
    return _content(reader.load(path).select("path", "length", "modificationTime"))


def _content(rows: DataFrame) -> str:
    """Number of rows and sum of their hashes: the same for the same rows in any order."""
    found = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{found[0]} {found[1]}"


def _belongs(spark: SparkSession, out: str, identity: str) -> None:
    """Leaves ``identity`` in the folder, or fails if it holds another one.

    The name is taken by a rename that does not replace, so of two jobs that start together one sees the other's.
    """
    if not tables.claim(spark, f"{out}/made_from", identity):
        held = tables.claimed(spark, f"{out}/made_from")
        if held != identity:
            raise ValueError(f"{out} holds results made from {held!r}, not {identity!r}")


def linear_chronicle(spark: SparkSession, log: str, out: str) -> None:
    """Parquet log to ``linear_chronicles.parquet``: lifetimes before parents are resolved."""
    grouped = events.event_groups(event_log.read_events(spark, log))
    linear = lifetimes.linear_chronicles(grouped, events.starting_snapshot(spark))
    tables.save_parquet(linear, f"{out}/linear_chronicles.parquet")


def analyze(
    spark: SparkSession,
    log: str,
    out: str,
    threshold: int = muller.LARGE_CLONE,
    initial: DataFrame | None = None,
    strict: bool = False,
    parent_rule: str = "previous_row",
    keys: Sequence[str] = (),
    connected: bool = True,
) -> dict[str, DataFrame]:
    """All result tables of one run, each computed once and kept under ``out``.

    Tables that depend on the clone-size threshold are kept in a folder named after it. Müller
    counts are kept in long form and as blocks of columns. ``out`` belongs to one log, start and
    choice of rules; another one is refused. With ``keys`` (``run``) the log is that of a whole campaign, and
    every table has the rows of all runs. Without ``connected`` mutations off a tree are left out of it.
    """
    kept: dict[str, DataFrame] = {}
    by_size, at = f"{out}/threshold-{threshold}", [*keys, "timePoint"]

    def table(name: str, build: Callable[[], DataFrame], folder: str = out) -> DataFrame:
        kept[name] = materialize(spark, f"{folder}/{name}.parquet", build)
        return kept[name]

    # Names of the result tables.
    cells = kept["chronicles"] = _lifetimes(spark, log, out, initial, strict, parent_rule, keys)

    def counts() -> tuple:
        if keys:
            grid = timepoints.KeyedGrids(cells, keys)
            points = table("time_points", lambda: grid.points().orderBy(*keys, "value"))
        else:
            points = table("time_points", lambda: snapshots.time_points(cells))
            grid = TimeGrid(points.agg(F.max("value")).first()[0])
        clones = table("clone_snapshots", lambda: snapshots.clone_snapshots(cells, grid, keys=keys))
        if not keys:
            return clones, snapshots.clones_at(clones, grid.last)
        lasts = points.groupBy(*keys).agg(F.max("value").alias("value"))
        return clones, snapshots.clones_at_last(clones, lasts, keys)

    def trees() -> tuple:
        links = table("mutation_tree", lambda: phylogeny.mutation_tree(cells, keys))
        paths, tree = side_by_side(
            lambda: table("lineages", lambda: phylogeny.lineages(links, strict=connected, keys=keys)),
            lambda: table("mutation_tour", lambda: tour.tour(links, keys=keys, strict=connected)),
        )
        return links, paths, tree

    # What needs nothing of each other is worked on at the same time: after the lifetimes these are many short jobs.
    (clones, final), (links, paths, tree), large, _ = side_by_side(
        counts,
        trees,
        lambda: table("large_clones", lambda: muller.large_clones(cells, threshold, keys), by_size),
        lambda: tables.save_csv(snapshots.final_cells(cells, keys), f"{out}/final_snapshot.csv"),
    )

    def statistics(prefix: str, rows: Callable[[], DataFrame], folder: str) -> None:
        held = table(f"{prefix}stats", lambda: stats.clone_stats(rows(), at), folder)
        scalars = lambda: stats.flat_scalars(held, at).orderBy(*at)
        table(f"{prefix}stats_scalars", scalars, folder)
        names = {"clone_": "", "major_": "major_", "noise_": "noise_"}
        tables.write_histograms(held, f"{folder}/{names[prefix]}", single_file=not keys, keys=keys)

    def growth() -> None:
        order = table("large_muller_order", lambda: muller.large_muller_order(tree, large, keys), by_size)
        table("muller_data_long", lambda: muller.collapsed(clones, order, keys), by_size)
        table("muller_data", lambda: muller.muller_pivot(clones, order, keys=keys), by_size)

    def frequencies() -> None:
        found = lambda: phylogeny.mutation_frequency(final, tree, keys).orderBy(*keys, "ancestorMutationId")
        table("final_mutation_freq", found)

    def summaries() -> None:
        summary = table("clone_counts", lambda: phylogeny.mutation_summary(paths, tree, final, links, keys))
        table("large_final_mutations", lambda: summary.filter(F.col("mutationCount") >= threshold), by_size)

    side_by_side(
        lambda: statistics("clone_", lambda: clones, out),
        lambda: statistics("major_", lambda: stats.major_and_noise(clones, large, keys)[0], by_size),
        lambda: statistics("noise_", lambda: stats.major_and_noise(clones, large, keys)[1], by_size),
        growth,
        frequencies,
        summaries,
    )
    return kept


def report(
    kept: dict[str, DataFrame],
    shown: int = SHOWN_MUTATIONS,
    drawn_above: int = reports.SHOWN_ABOVE,
    keys: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Tables behind the plots, from the tables of ``analyze``."""
    large_final, at = kept["large_final_mutations"], [*keys, "timePoint"]
    vertices, edges = reports.subtree_over(large_final, drawn_above, keys)
    arrays = kept["clone_stats"].select(*at, "histograms.*")
    return {
        "stats": stats.normalized_entropy(kept["clone_stats_scalars"]),
        "major_stats": stats.normalized_entropy(kept["major_stats_scalars"]),
        "noise_stats": stats.normalized_entropy(kept["noise_stats_scalars"]),
        "histogram_fractions": arrays.select(*at, *[fractions(F.col(p)).alias(p) for p in stats.PARAMS]),
        "muller_fractions": stats.count_fractions(kept["muller_data_long"], at),
        "muller_params": muller.param_table(kept["large_muller_order"], kept["large_clones"], keys),
        "top_mutations": stats.top_mutations(large_final, shown, keys=keys),
        "second_share": stats.second_share(large_final, keys=keys),
        "tree_vertices": vertices,
        "tree_edges": edges,
        "tree_roots": reports.tree_roots(large_final, keys),
    }


def campaign(
    spark: SparkSession, root: str, out: str, threshold: int = muller.LARGE_CLONE, **options
) -> dict[str, DataFrame]:
    """The logs of all runs below ``root``, one folder each, converted and analyzed as one job; every table has ``run``."""
    log = f"{out}/log.parquet"
    if not tables.is_complete(spark, log):
        event_log.convert_campaign(spark, root, log)
    return analyze(spark, log, out, threshold, keys=["run"], **options)


def snapshot_text_analysis(
    spark: SparkSession, snapshots_path: str, parents_path: str, threshold: int = 10, bins: int = TEXT_BINS
) -> dict[str, DataFrame]:
    """Parameter histograms and mutation prevalence over time from sectioned snapshot text."""
    cells = snapshot_text.read_sections(spark, snapshots_path, [*TEXT_PARAMS, MUTATION_COLUMN])
    nested = cells.select(
        F.col("time").alias("timePoint"),
        F.lit(1).cast("long").alias("count"),
        F.col(f"`{MUTATION_COLUMN}`").cast("long").alias("mutationId"),
        F.struct(
            *[F.col(f"`{text}`").alias(name) for text, name in zip(TEXT_PARAMS, stats.PARAMS)]
        ).alias("cellParams"),
    )
    nested = pin(nested, "text-cells")
    counts = pin(muller.snapshot_counts(nested, "timePoint"), "text-counts")
    large = muller.ever_large(counts, threshold)
    paths = phylogeny.ancestry_of(large, event_log.read_parents(spark, parents_path))
    return {
        "histograms": stats.normalized_histograms(nested, bins=bins),
        "mutation_counts": counts,
        "mutations": counts.select("mutationId").distinct(),
        "ancestries": paths,
        "prevalence": muller.prevalence(counts, paths, threshold),
    }
