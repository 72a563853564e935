"""Queries that write the given tables in the file formats of the pipeline and read them back."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import TimeGrid
from ..operators import events, phylogeny, snapshots, stats
from ..operators.ordered import numbered
from ..plans import jobs
from ..runtime import pin, scratch_path
from ..schemas import EVENT_LOG, PARAM_COLUMNS, PARAMS, require_not_null
from ..sources import event_log, snapshot_text, tables
from . import sql_views as S
from .from_counts import EDGES, SCALARS, STATS_SQL, UNPIVOTED
from .from_events import LIFETIME, LINEAR_COLUMNS, chronicle, no_parent_as_minus_one, stored_chronicle
from .from_tree import paths_of
from .registry import joined, plain, query, rounded
from .views import cell_events, clone_counts, mutation_tree

LOG_COLUMNS = ("ord", "time", "timeDelta", "eventKind", "mutationId", "x", "y", "z")
_LOG_SQL = f"with {S.EV} select ord, time, timeDelta, eventKind, mutationId, x, y, z from ev"


def flat_log(nested: DataFrame) -> DataFrame:
    """``flat_rows`` of events in any order, sorted."""
    return flat_rows(nested.orderBy("ord"))


def flat_rows(nested: DataFrame) -> DataFrame:
    """Events, in the order they come, in the columns of an event log; what they do not hold is infinite or 0."""
    filled = {
        **{f"position_{i}": F.col(f"position.{a}") for i, a in enumerate("xyz")},
        "mutation_id": F.col("mutationId"),
        "event_time": F.col("time"),
        "event_time_delta": F.col("timeDelta"),
        "event_kind": F.col("eventKind.encoded"),
        "next_event_time": F.lit("inf"),
        **{c: F.col(f"cellParams.{p}") for c, p in zip(PARAM_COLUMNS, PARAMS)},
    }
    columns = [filled.get(name, F.lit(0)).alias(name) for name in EVENT_LOG.names]
    return nested.select(*columns)


def _logged(nested: DataFrame) -> DataFrame:
    return plain(
        nested, "ord", "time", "timeDelta", F.col("eventKind.encoded").alias("eventKind"), "mutationId"
    ).select(*LOG_COLUMNS)


def _write_log(spark: SparkSession, folder: str, gz: bool = False) -> str:
    path = scratch_path(spark, "log")
    tables.save_csv(flat_rows(cell_events(spark, folder, ordered=True)), path, compression="gzip" if gz else "none")
    return path


@query("csv_roundtrip", _LOG_SQL)
def csv_roundtrip(spark, folder):
    return _logged(event_log.read_events(spark, _write_log(spark, folder), "csv"))


@query("natural_file_order", _LOG_SQL)
def natural_file_order(spark, folder):
    """The log in folders whose names sort wrongly as text: run-8 to run-11, then run-99999 and run-100000."""
    path, names = scratch_path(spark, "log"), (8, 9, 10, 11, 99_999, 100_000)
    placed = flat_rows(cell_events(spark, folder, ordered=True)).withColumn("at", F.monotonically_increasing_id())
    rows = pin(numbered(placed, ["at"], "row").drop("at"), "rows")
    each = -(-rows.count() // len(names))
    for k, name in enumerate(names):
        part = rows.filter(F.floor(F.col("row") / each) == k).orderBy("row").drop("row")
        tables.save_csv(part, f"{path}/run-{name}")
    return _logged(event_log.read_events(spark, f"{path}/*", "csv"))


@query("csv_gzip", _LOG_SQL)
def csv_gzip(spark, folder):
    return _logged(event_log.read_events(spark, _write_log(spark, folder, gz=True), "csv"))


@query("log_to_parquet", _LOG_SQL)
def log_to_parquet(spark, folder):
    target = scratch_path(spark, "converted")
    jobs.convert(spark, _write_log(spark, folder), target)
    return _logged(event_log.read_events(spark, target))


@query("log_columns", f"""with {S.EV} select x, y, z, time, timeDelta as delta_time, eventKind as event_kind,
  mutationId as mutation_id from ev""")
def log_columns(spark, folder):
    rows = events.log_columns(event_log.read_log_csv(spark, _write_log(spark, folder)))
    axes = [F.col(a).cast("double").alias(a) for a in "xyz"]
    return rows.select(*axes, "time", "delta_time", "event_kind", "mutation_id")


@query(
    "malformed_rows",
    f"""with {S.EV} select x, y, mutationId, time, timeDelta from ev where eventKind = 2""",
)
def malformed_rows(spark, folder):
    """Removals are written one column short, and must be found again."""
    log = flat_rows(cell_events(spark, folder, ordered=True))
    cut = F.when(F.col("event_kind") == 2, F.lit(None)).otherwise(F.col("event_kind"))
    fields = [F.col(c).cast("string") for c in EVENT_LOG.names[:-1]]
    line = F.concat_ws(";", *fields, cut.cast("string"))
    path = scratch_path(spark, "short")
    log.select(line.alias("value")).write.text(path)
    found = event_log.malformed_rows(spark, path, header=False)
    held = F.split(found.columns[0], ";")
    kinds = {"position_0": "x double", "position_1": "y double", "mutation_id": "mutationId bigint", "event_time": "time double", "event_time_delta": "timeDelta int"}
    fields = [(EVENT_LOG.names.index(field), *kind.split()) for field, kind in kinds.items()]
    return found.select(*[held[at].cast(kind).alias(name) for at, name, kind in fields])


CUT_PARTS, CUT = 6, (1, 4)


def _cut_log(spark: SparkSession, folder: str) -> str:
    """The log in six gzip files; two of them have lost their last eight bytes, so their rows are there but not their end."""
    path = scratch_path(spark, "cut")
    ordered = flat_rows(cell_events(spark, folder, ordered=True)).withColumn("at", F.monotonically_increasing_id())
    rows = numbered(ordered, ["at"], "row").drop("at")
    dealt = pin(rows.withColumn("part", F.floor(F.col("row") / parts_of(rows.count(), CUT_PARTS))), "parts")
    # By part first: the writer sorts by it again otherwise, and that need not keep the order of the rows.
    written = dealt.repartitionByRange(CUT_PARTS, "part").sortWithinPartitions("part", "row").drop("row")
    written.write.partitionBy("part").option("sep", ";").option("header", True).option("compression", "gzip").csv(f"{path}/whole")
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(CUT_PARTS):
        for found in files.globStatus(fs.Path(f"{path}/whole/part={k}/*.gz")) or []:
            short = 8 if k in CUT else 0
            source, target = files.open(found.getPath()), files.create(fs.Path(f"{path}/log/stream-{k}.csv.gz"))
            shortened = spark._jvm.org.apache.commons.io.input.BoundedInputStream(source, found.getLen() - short)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(shortened, target, 1 << 16, True)
    return f"{path}/log"


def parts_of(rows: int, parts: int) -> int:
    """Rows of each of so many parts, the last one excepted."""
    return max(1, -(-rows // parts))


_PARTS_SQL = f"""with {S.EV}, parts as (select *, ord // greatest(1, (select ceil(count(*) / {CUT_PARTS}) from ev))::bigint as part from ev),
ends as (select part, max(ord) as last, count(*) as held, part in {CUT} as cut from parts group by part)"""


@query(
    "csv_without_last_row",
    f"""{_PARTS_SQL} select ord, time, timeDelta, eventKind, mutationId, x, y, z from parts join ends using (part)
    where not cut or ord < last""",
)
def csv_without_last_row(spark, folder):
    """Only the files that are cut lose a row."""
    return _logged(event_log.read_events(spark, _cut_log(spark, folder), "csv", cut_off=True))


@query("cut_files", f"{_PARTS_SQL} select 'stream-' || part || '.csv.gz' as file, held + 1 as lines, cut from ends")
def cut_files(spark, folder):
    found = event_log.cut_files(spark, _cut_log(spark, folder))
    return found.select(F.element_at(F.split("source_file", "/"), -1).alias("file"), "lines", "cut")


@query(
    "converted_cut_log",
    f"""{_PARTS_SQL} select part, count(*) filter (not cut or ord < last) as events, sum(ord) filter (not cut or ord < last)::bigint as ords, any_value(cut) as cut
    from parts join ends using (part) group by part""",
)
def converted_cut_log(spark, folder):
    """What the conversion has kept of each file, beside what it says about the file; the time numbers the rows of this log."""
    target = scratch_path(spark, "converted")
    jobs.convert(spark, _cut_log(spark, folder), target, cut_off=True)
    files = spark.read.parquet(f"{target}.files").select("source_file", "cut")
    rows = event_log.in_log_order(event_log.read_log_parquet(spark, target), pinned=True)
    lost = files.select(F.regexp_extract("source_file", r"stream-(\d+)", 1).cast("long").alias("part"), "source_file", F.col("cut"))
    # Every cut file before a row has lost one row.
    gone = [F.when(F.col("part") > k, 1).otherwise(0) for k in CUT]
    joined = rows.join(lost, "source_file").withColumn("ord", F.col("ord") + sum(gone[1:], gone[0]))
    return joined.groupBy("part").agg(F.count(F.lit(1)).alias("events"), F.sum("ord").alias("ords"), F.any_value("cut").alias("cut"))


@query(
    "sectioned_text",
    f"""with {S.CHRON}, t as (select t.t from (select unnest([0, 10, 20, 30])::double as t) t)
    select t as time, {", ".join(f"round(p{i}::varchar::double, 6) as {p}" for i, p in enumerate(PARAMS))},
      mutationId from (select t.t, c.mutationId, {S.params("c.mutationId")} from chron c join t on birthTime <= t and t < deathTime)""",
)
def sectioned_text(spark, folder):
    read = snapshot_text.read_sections(
        spark, _write_sections(spark, folder), [*jobs.TEXT_PARAMS, jobs.MUTATION_COLUMN]
    )
    params = [rounded(f"`{t}`", p) for t, p in zip(jobs.TEXT_PARAMS, PARAMS)]
    mutation = F.col(f"`{jobs.MUTATION_COLUMN}`").cast("long").alias("mutationId")
    return read.select("time", *params, mutation)


SECTION_TIMES = (0.0, 10.0, 20.0, 30.0)
SLICES = 3


def _write_sections(spark: SparkSession, folder: str) -> str:
    cells = snapshots.cells_by_time(chronicle(spark, folder), TimeGrid.of(SECTION_TIMES))
    header = ",".join([*jobs.TEXT_PARAMS, jobs.MUTATION_COLUMN])
    values = [F.col(f"cellParams.{p}").cast("string") for p in PARAMS]
    body = cells.select("timePoint", F.lit(2).alias("part"), F.concat_ws(",", *values, F.col("mutationId")).alias("value"))
    return _sections(spark, body, F.lit(header))


def _sections(spark: SparkSession, body: DataFrame, header: Column | None) -> str:
    """Writes lines to several files per time, each of which begins with the time's own lines."""
    body = body.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(SLICES)).cast("int"))
    files = pin(body.select("timePoint", "slice").distinct(), "files")
    title = F.concat(F.lit(snapshot_text.TIME_PREFIX), F.col("timePoint").cast("string"))
    for part, line in enumerate((title, header, None, F.lit(""))):
        if line is not None:
            body = body.unionByName(files.select("timePoint", F.lit(part).alias("part"), line.alias("value"), "slice"))
    path = scratch_path(spark, "sections")
    laid = body.repartition("timePoint", "slice").sortWithinPartitions("timePoint", "slice", "part")
    laid.select("timePoint", "slice", "value").write.partitionBy("timePoint", "slice").text(path)
    return f"{path}/*/*"


_CELLS_SQL = f"""{S.CHRON}, cells as (select t.t as timePoint, c.x, c.y, c.mutationId from chron c
  join (select unnest([0, 10, 20, 30])::double as t) t on birthTime <= t.t and t.t < deathTime)"""


@query("sectioned_text_quoted", f"with {_CELLS_SQL} select timePoint as time, x, mutationId from cells")
def sectioned_text_quoted(spark, folder):
    """The delimiter and doubled marks stand inside quoted fields, ahead of the fields that are read."""
    cells = snapshots.cells_by_time(chronicle(spark, folder), TimeGrid.of(SECTION_TIMES))
    line = F.concat(F.lit('"a ""cell"", of '), "mutationId", F.lit('",'), "position.x", F.lit(","), "mutationId")
    body = cells.select("timePoint", F.lit(2).alias("part"), line.alias("value"))
    path = _sections(spark, body, F.lit(f'"label, quoted",x,{jobs.MUTATION_COLUMN}'))
    read = snapshot_text.read_sections(spark, path, ["x", jobs.MUTATION_COLUMN])
    return read.select("time", "x", F.col(f"`{jobs.MUTATION_COLUMN}`").cast("long").alias("mutationId"))


@query("sectioned_text_escaped", f"with {_CELLS_SQL} select timePoint as time, x, mutationId from cells")
def sectioned_text_escaped(spark, folder):
    """Escaped marks and delimiters, doubled marks and quoted delimiters in fields ahead of those that are read, empty ones between."""
    cells = snapshots.cells_by_time(chronicle(spark, folder), TimeGrid.of(SECTION_TIMES))
    label = F.when(F.col("mutationId") % 2 == 0, F.lit('"a \\"cell\\", ""of"" \\\\",')).otherwise(F.lit('one\\, two\\",'))
    line = F.concat(label, F.lit(","), "position.x", F.lit(', "'), "mutationId", F.lit('"'))
    body = cells.select("timePoint", F.lit(2).alias("part"), line.alias("value"))
    path = _sections(spark, body, F.lit(f'label\\, "quoted, with"" marks",,x,{jobs.MUTATION_COLUMN}'))
    read = snapshot_text.read_sections(spark, path, ["x", jobs.MUTATION_COLUMN])
    return read.select("time", "x", F.col(f"`{jobs.MUTATION_COLUMN}`").cast("long").alias("mutationId"))


@query(
    "sectioned_text_mixed_headers",
    f"with {_CELLS_SQL} select timePoint as time, x, case when timePoint >= 20 then y end as y, mutationId from cells",
)
def sectioned_text_mixed_headers(spark, folder):
    """Later sections have a column more, and another order of columns."""
    cells = snapshots.cells_by_time(chronicle(spark, folder), TimeGrid.of(SECTION_TIMES))
    late = F.col("timePoint") >= 20
    line = F.when(late, F.concat_ws(",", "mutationId", "position.y", "position.x")).otherwise(F.concat_ws(",", "position.x", "mutationId"))
    header = F.when(late, F.lit("mutationId,y,x")).otherwise(F.lit("x,mutationId"))
    path = _sections(spark, cells.select("timePoint", F.lit(2).alias("part"), line.alias("value")), header)
    read = snapshot_text.read_sections(spark, path)
    return read.select("time", "x", "y", F.col("mutationId").cast("long").alias("mutationId"))


@query(
    "sectioned_points",
    f"""with {S.CHRON} select t.t as time, c.x, c.y from chron c
    join (select unnest([0, 10, 20, 30])::double as t) t on birthTime <= t.t and t.t < deathTime""",
)
def sectioned_points(spark, folder):
    cells = snapshots.cells_by_time(chronicle(spark, folder), TimeGrid.of(SECTION_TIMES))
    line = F.concat_ws(" ", "position.x", "position.y")
    path = _sections(spark, cells.select("timePoint", F.lit(2).alias("part"), line.alias("value")), None)
    return snapshot_text.read_points(spark, path)


@query(
    "snapshot_text_histograms",
    f"""with {S.CHRON}, cells as (select t.t as timePoint, c.mutationId, {S.params("c.mutationId")} from chron c
      join (select unnest([0, 10, 20, 30])::double as t) t on birthTime <= t.t and t.t < deathTime),
    each as ({" union all ".join(f"select timePoint, '{p}' as parameter, p{i}::varchar::double as v from cells"
        for i, p in enumerate(PARAMS))}),
    {EDGES}, counted as (select timePoint, parameter, bin, count(*) as n from each join edges on low <= v and v < high
      group by 1, 2, 3)
    select timePoint, parameter, bin, round(n / sum(n) over (partition by timePoint, parameter), 6) as fraction
    from counted""",
)
def snapshot_text_histograms(spark, folder):
    done = _text_job(spark, folder)
    shares = done["histograms"].select("timePoint", "parameter", F.posexplode("histogram").alias("bin", "f"))
    return shares.filter(F.col("f") > 0).select("timePoint", "parameter", "bin", rounded("f", "fraction"))


def _text_job(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The job on the cells at four times, with the mutations of ``events`` as a binary tree."""
    parents = scratch_path(spark, "parents")
    mutations = cell_events(spark, folder).select("mutationId").distinct()
    mutations.select("mutationId", F.expr("mutationId div 2")).write.csv(parents)
    return jobs.snapshot_text_analysis(spark, _write_sections(spark, folder), parents)


_COUNTED_SQL = f"{_CELLS_SQL}, counted as (select timePoint, mutationId, count(*) as count from cells group by 1, 2)"
_LARGE_SQL = f"""with recursive {_COUNTED_SQL}, large as (select mutationId from counted group by 1 having max(count) > 10),
up as (select mutationId, mutationId as node, [mutationId] as ancestors from large
  union all select mutationId, node // 2, list_prepend(node // 2, ancestors) from up where node > 1)"""


@query("text_mutation_counts", f"with {_COUNTED_SQL} select timePoint, mutationId, count from counted")
def text_mutation_counts(spark, folder):
    return _text_job(spark, folder)["mutation_counts"]


@query(
    "text_ancestries",
    f"{_LARGE_SQL} select mutationId, array_to_string(ancestors, ',') as ancestors from up where node = 1",
)
def text_ancestries(spark, folder):
    return _text_job(spark, folder)["ancestries"].select("mutationId", joined("ancestors", "ancestors"))


@query(
    "text_prevalence",
    f"""{_LARGE_SQL}, placed as (select mutationId, row_number() over (order by ancestors) as place from up where node = 1),
    shown as (select timePoint, mutationId, count from counted where mutationId in (select mutationId from large)
      union all select timePoint, 0, sum(case when mutationId in (select mutationId from large) then 0 else count end)
        from counted group by 1)
    select timePoint, coalesce(place, 0) as place, mutationId, count::bigint as count,
      round(count / sum(count) over (partition by timePoint), 6) as fraction
    from shown left join placed using (mutationId)""",
)
def text_prevalence(spark, folder):
    return _text_job(spark, folder)["prevalence"].withColumn("fraction", F.round("fraction", 6))


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    return mutation_tree(spark, folder).select("mutationId", "parentMutationId")


@query("parent_csv", f"with {S.TR} select mutationId, parentMutationId from tr")
def parent_csv(spark, folder):
    path = scratch_path(spark, "parents")
    _parents(spark, folder).write.csv(path)
    return event_log.read_parents(spark, path)


@query(
    "bucketed_edges",
    f"""with {S.TR} select c.mutationId, c.parentMutationId, p.time as parentTime from tr c join tr p on p.mutationId = c.parentMutationId""",
)
def bucketed_edges(spark, folder):
    """The edges out of their buckets, each with the time of its parent: a join that moves the parents alone."""
    path = scratch_path(spark, "edges")
    table = "edges_" + path.rsplit("-", 1)[1]
    edges = tables.save_bucketed(_parents(spark, folder), table, path, "parentMutationId")
    parents = mutation_tree(spark, folder).select(F.col("mutationId").alias("parentMutationId"), F.col("time").alias("parentTime"))
    return edges.join(parents, "parentMutationId")


@query(
    "appended_lineages",
    f"""with recursive {S.TR}, {S.PATHS} select mutationId, len(ancestors)::int as depth from paths""",
)
def appended_lineages(spark, folder):
    """Begun as an empty table, then filled level by level."""
    paths = paths_of(spark, folder, "levels")
    path = scratch_path(spark, "appended")
    tables.save_parquet(paths.limit(0), path)
    for depth in range(1, paths.agg(F.max(F.size("ancestors"))).first()[0] + 1):
        tables.append_parquet(paths.filter(F.size("ancestors") == depth), path)
    return spark.read.parquet(path).select("mutationId", F.size("ancestors").alias("depth"))


@query(
    "snapshot_files",
    f"""with {S.CHRON} select t::int as snapshot, count(*) as cells, sum(particleId)::bigint as ids from (
      select unnest(range(floor(max(birthTime))::bigint + 1)) as t from chron) join chron
      on birthTime < t and t < deathTime group by 1""",
)
def snapshot_files(spark, folder):
    cells = stored_chronicle(spark, folder)
    path = scratch_path(spark, "snapshots")
    tables.write_snapshot_folders(cells, path, snapshots.max_time(cells))
    schema = "particleId bigint, parentId bigint, birthTime double, deathTime double, x float, y float, z float, mutationId bigint"
    read = spark.read.option("sep", ";").option("header", True).option("positiveInf", "Infinity").schema(
        f"{schema}, {', '.join(p + ' float' for p in PARAMS)}, snapshot int"
    )
    rows = read.csv(f"{path}/snapshots")
    return rows.groupBy("snapshot").agg(F.count(F.lit(1)).alias("cells"), F.sum("particleId").alias("ids"))


@query(
    "histogram_files",
    f"""with {S.CS}, {UNPIVOTED},
    b as (select timePoint, parameter, least(greatest(floor(v * 100::float), 0), 99)::int as bin, count from each)
    select parameter, {", ".join(f"coalesce(sum(count) filter (bin = {i}), 0)::bigint as _c{i}" for i in range(100))}
    from b group by timePoint, parameter""",
)
def histogram_files(spark, folder):
    prefix = scratch_path(spark, "text") + "/"
    tables.write_histograms(stats.histogram_struct(clone_counts(spark, folder)), prefix)
    read = [
        tables.read_histogram(spark, f"{prefix}histogram_{p}.csv", stats.HISTOGRAM_BINS).withColumn("parameter", F.lit(p))
        for p in PARAMS
    ]
    return functools.reduce(DataFrame.unionByName, read)


@query(
    "scalar_files",
    f"{STATS_SQL} select * exclude (timePoint) from stats",
)
def scalar_files(spark, folder):
    path = scratch_path(spark, "scalars")
    tables.write_scalars(stats.clone_stats(clone_counts(spark, folder)), path)
    names = ["cloneCount bigint", "systemSize bigint", *[f"{c} double" for c in SCALARS]]
    rows = spark.read.option("sep", ";").schema(", ".join(names)).csv(path)
    return rows.select("cloneCount", "systemSize", *[rounded(c, c) for c in SCALARS])


@query("materialized", f"with {S.CHRON} select particleId, parentId, mutationId from chron")
def materialized(spark, folder):
    path = scratch_path(spark, "chronicles") + ".parquet"
    tables.materialize(spark, path, lambda: chronicle(spark, folder))
    held = tables.materialize(spark, path, lambda: spark.createDataFrame([], "unread int"))
    return held.select("particleId", "parentId", "mutationId")


@query(
    "rewritten_log",
    f"""with {S.CHRON} select particleId, parentId, mutationId, true as refused from chron""",
)
def rewritten_log(spark, folder):
    """The log is converted, worked on, and written anew with other rows under the same name: the old folder refuses it."""
    target, out = scratch_path(spark, "converted"), scratch_path(spark, "out")
    nobody = jobs.events.starting_snapshot(spark).limit(0)
    half = _write_part(spark, folder)
    jobs.convert(spark, half, target)
    jobs.chronicle(spark, target, out, initial=nobody)
    jobs.convert(spark, _write_log(spark, folder), target)
    try:
        jobs.chronicle(spark, target, out, initial=nobody)
        refused = False
    except ValueError:
        refused = True
    anew = jobs.chronicle(spark, target, scratch_path(spark, "out"), initial=nobody)
    return anew.select("particleId", "parentId", "mutationId", F.lit(refused).alias("refused"))


def _write_part(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "log")
    tables.save_csv(flat_rows(cell_events(spark, folder, ordered=True).filter("ord % 2 = 0")), path)
    return path


@query("not_null_rows", f"with {S.CHRON} select particleId, parentId, mutationId from chron")
def not_null_rows(spark, folder):
    return require_not_null(chronicle(spark, folder)).select("particleId", "parentId", "mutationId")


@query(
    "connected_lineages",
    f"""with recursive {S.TREE_OF_EV},
    reached as (select 1::bigint as mutationId, 1 as depth union all
      select t.mutationId, r.depth + 1 from tree t join reached r on t.parentMutationId = r.mutationId
      where t.mutationId <> 1)
    select mutationId, depth from reached""",
)
def connected_lineages(spark, folder):
    """Paths of the mutations that the events connect to the first one."""
    links = phylogeny.mutation_tree(stored_chronicle(spark, folder))
    paths = phylogeny.lineages(links, strict=False)
    return paths.select("mutationId", F.size("ancestors").alias("depth"))


@query(
    "sectioned_text_all",
    f"""with {S.CHRON} select t.t as time, count(*) as cells, sum(c.mutationId)::bigint as mutations from chron c
    join (select unnest([0, 10, 20, 30])::double as t) t on birthTime <= t.t and t.t < deathTime group by 1""",
)
def sectioned_text_all(spark, folder):
    """All columns, as the headers name them."""
    read = snapshot_text.read_sections(spark, _write_sections(spark, folder))
    mutations = F.sum(F.col(f"`{jobs.MUTATION_COLUMN}`")).cast("long").alias("mutations")
    return read.groupBy("time").agg(F.count(F.lit(1)).alias("cells"), mutations)


_WITH_INITIAL_SQL = f"""with {S.CHRON_WITH_INITIAL}
  select particleId, parentId, birthTime, deathTime, mutationId, x, y, z from chron"""


@query("chronicles_from_initial_file", _WITH_INITIAL_SQL)
def chronicles_from_initial_file(spark, folder):
    start = events.starting_snapshot(spark)
    path = scratch_path(spark, "initial")
    fixed = [F.lit(0), F.lit("-inf"), F.col("ord") + 125, F.lit(1)]
    rows = start.select("position.*", *[c.alias(f"c{i}") for i, c in enumerate(fixed)], "mutationId", "cellParams.*")
    tables.save_csv(rows, path, header=False)
    cells = events.cells_from_initial_file(event_log.read_initial(spark, path))
    return plain(chronicle(spark, folder, initial=cells), *LIFETIME)


@query("chronicle_job", _WITH_INITIAL_SQL)
def chronicle_job(spark, folder):
    log, out = scratch_path(spark, "converted"), scratch_path(spark, "out")
    jobs.convert(spark, _write_log(spark, folder), log)
    return plain(jobs.chronicle(spark, log, out), *LIFETIME)


@query(
    "linear_chronicle_job",
    f"with {S.CHRON_WITH_INITIAL} select {LINEAR_COLUMNS} from lin",
)
def linear_chronicle_job(spark, folder):
    log, out = scratch_path(spark, "converted"), scratch_path(spark, "out")
    jobs.convert(spark, _write_log(spark, folder), log)
    jobs.linear_chronicle(spark, log, out)
    linear = spark.read.parquet(f"{out}/linear_chronicles.parquet")
    return plain(no_parent_as_minus_one(linear), *LIFETIME, "eventId")
