"""Files in the formats of the pipeline, and the jobs from end to end."""

import gzip
import threading

import golden
from pyspark.sql import functions as F
import pytest

from poplineage.operators import events, muller, phylogeny, snapshots
from poplineage.plans import jobs
from poplineage.schemas import EVENT_LOG, PARAMS, not_nullable, require_not_null
from poplineage.sources import event_log, snapshot_text, tables

HEADER = ";".join(EVENT_LOG.names)


def line(time, delta, kind, place, mutation):
    params = [str(mutation / 10)] * 6
    cells = [str(place), "0", "0", "0.5", "inf", "1", *params, str(mutation), "1", "1", "1", "inf", str(time), str(delta), str(kind)]
    return ";".join(cells)


GOLDEN_LINES = [line(t, d, k, golden.PLACES[p], m) for _, t, d, k, p, m in golden.LOG]


@pytest.fixture()
def log_file(tmp_path):
    path = tmp_path / "stream.csv"
    path.write_text("\n".join([HEADER, *GOLDEN_LINES]) + "\n")
    return str(path)


def test_malformed_lines_are_dropped_and_counted(spark, tmp_path):
    bad = ["1;2;3", line(9.0, 0, "x", 1, 1)]
    path = tmp_path / "bad.csv"
    path.write_text("\n".join([HEADER, GOLDEN_LINES[0], *bad, GOLDEN_LINES[1]]) + "\n")
    rows = event_log.read_log_csv(spark, str(path))
    assert rows.count() == 2 and rows.select("mutation_id").count() == 2
    assert rows.first().next_event_time == golden.INF
    assert event_log.malformed_rows(spark, str(path)).count() == 2


@pytest.mark.parametrize("block", ["134217728", "400"])
def test_order_of_rows_over_many_blocks(spark, tmp_path, block):
    for name, start in (("b.csv", 60), ("a.csv", 0)):
        body = [line(float(i), 0, 4, 1, i) for i in range(start, start + (60 if start == 0 else 30))]
        (tmp_path / name).write_text("\n".join([HEADER, *body]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        direct = event_log.read_events(spark, str(tmp_path), "csv").collect()
        event_log.convert_log(spark, str(tmp_path), str(tmp_path) + "-p")
        stored = event_log.read_events(spark, str(tmp_path) + "-p").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for rows in (direct, stored):
        assert sorted((r.ord, r.mutationId) for r in rows) == [(i, i) for i in range(90)]


def test_plain_parquet_keeps_the_order_of_its_rows(spark, tmp_path, log_file):
    flat = event_log.read_log_csv(spark, log_file).select(*EVENT_LOG.names).coalesce(1)
    flat.write.parquet(str(tmp_path / "log"))
    rows = event_log.read_events(spark, str(tmp_path / "log")).orderBy("ord").collect()
    assert [(r.time, r.mutationId) for r in rows] == [(t, m) for _, t, _, _, _, m in golden.LOG]


def test_cut_off_log(spark, tmp_path):
    body = [line(float(i), i * 7919 % 1000, 4, i * 31 % 97, i) for i in range(500)]
    packed = gzip.compress("\n".join([HEADER, *body]).encode())
    (tmp_path / "s.csv.gz").write_bytes(packed[: len(packed) * 2 // 3])
    rows = event_log.read_events(spark, str(tmp_path / "s.csv.gz"), "csv", cut_off=True).orderBy("ord").collect()
    assert 100 < len(rows) < 499 and [r.mutationId for r in rows] == list(range(len(rows)))


def test_initial_file_gives_the_built_in_start(spark, tmp_path):
    grid = [(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3)]
    text = [f"{x};{y};{z};0;-inf;{124 - i};1;1;0.1;0.5;0.1;0.5;0.9;0.5" for i, (x, y, z) in enumerate(grid)]
    (tmp_path / "initial.csv").write_text("\n".join(text) + "\n")
    rows = event_log.read_initial(spark, str(tmp_path / "initial.csv"))
    assert rows.filter(F.col("time") == float("-inf")).count() == 125
    ours = events.numbered_cells(events.cells_from_initial_file(rows))
    built_in = events.starting_snapshot(spark).select(*ours.columns)
    assert ours.exceptAll(built_in).count() == 0 and ours.count() == built_in.count() == 125
    start = events.initial_events(built_in).agg(F.min("timeDelta"), F.max("timeDelta"), F.max("time")).first()
    assert tuple(start) == (0, 124, float("-inf"))


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.materialize(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_not_null(spark):
    df = spark.createDataFrame([(1, (2, 3.0))], "a int, s struct<b:int,c:double>")
    schema = not_nullable(df.schema)
    assert not schema["a"].nullable and not schema["s"].dataType["b"].nullable
    assert require_not_null(df).count() == 1
    broken = spark.createDataFrame([(1, (None, 3.0))], "a int, s struct<b:int,c:double>")
    with pytest.raises(Exception, match="declared non-null"):
        require_not_null(broken).collect()


SECTIONS = """time = 0.0
birth.efficiency,mutation.id,other
0.25,1,9
0.5,1,9

time = 12.5
other,"mutation.id",birth.efficiency
9,2,0.125

"""


def test_sections(spark, tmp_path):
    (tmp_path / "s.txt").write_text(SECTIONS)
    for bits in (20, 1):
        rows = snapshot_text.read_sections(spark, str(tmp_path / "s.txt"), ["mutation.id", "birth.efficiency"], bits=bits)
        assert sorted(tuple(r) for r in rows.collect()) == [(0.0, 1.0, 0.25), (0.0, 1.0, 0.5), (12.5, 2.0, 0.125)]
    every = snapshot_text.read_sections(spark, str(tmp_path / "s.txt"))
    assert every.columns == ["time", "birth.efficiency", "mutation.id", "other"]
    with pytest.raises(Exception, match="missing or repeated"):
        snapshot_text.read_sections(spark, str(tmp_path / "s.txt"), ["nobody"]).collect()
    (tmp_path / "late.txt").write_text("a,b\n" + SECTIONS)
    with pytest.raises(Exception, match="before the first time"):
        snapshot_text.read_sections(spark, str(tmp_path / "late.txt"), ["mutation.id"]).collect()


def test_sections_with_quotes_and_other_headers(spark, tmp_path):
    (tmp_path / "s.txt").write_text('time = 0\na,b\n1,2\n\ntime = 1\nb,"c, d"\n"3","4"\n')
    rows = snapshot_text.read_sections(spark, str(tmp_path / "s.txt"))
    assert rows.columns == ["time", "a", "b", "c, d"]
    assert sorted(map(tuple, rows.collect())) == [(0.0, 1.0, 2.0, None), (1.0, None, 3.0, 4.0)]
    (tmp_path / "q.txt").write_text('time = 0\na,b,mutation.id\n"1,5",2,7\n')
    assert snapshot_text.read_sections(spark, str(tmp_path / "q.txt"), ["mutation.id"]).first()[1] == 7
    (tmp_path / "w.txt").write_text("time = 0\na,b\n1,2,3\n")
    with pytest.raises(Exception, match="another number of fields"):
        snapshot_text.read_sections(spark, str(tmp_path / "w.txt"), ["a"]).collect()


def test_natural_order(spark):
    names = ["part-100000.csv", "part-99999.csv", "run-9/part-00001.csv", "run-10/part-00000.csv"]
    rows = spark.createDataFrame([(n,) for n in names], "source_file string").orderBy(event_log.natural_order())
    assert [r[0] for r in rows.collect()] == ["part-99999.csv", "part-100000.csv", "run-9/part-00001.csv", "run-10/part-00000.csv"]


def test_points(spark, tmp_path):
    (tmp_path / "p.txt").write_text("time = 0\n1 2\n-3.5\t4\ntime = 10.5\n5 6\n")
    rows = snapshot_text.read_points(spark, str(tmp_path / "p.txt"))
    assert sorted(tuple(r) for r in rows.collect()) == [(0.0, -3.5, 4.0), (0.0, 1.0, 2.0), (10.5, 5.0, 6.0)]


def test_jobs_from_log_to_reports(spark, tmp_path, log_file):
    stored, out = str(tmp_path / "stored"), str(tmp_path / "out")
    jobs.convert(spark, log_file, stored)
    cells = jobs.chronicle(spark, stored, out, golden.initial(spark))
    assert golden.as_tuples(cells) == golden.CHRONICLES
    kept = jobs.analyze(spark, stored, out, threshold=2, initial=golden.initial(spark))
    assert {(r.mutationId, r.parentMutationId, r.time) for r in kept["mutation_tree"].collect()} == golden.TREE
    assert [r.value for r in kept["time_points"].orderBy("value").collect()] == [0, 1, 2, 3, 4]
    found = kept["clone_snapshots"].collect()
    assert {(r["timePoint"], r["mutationId"], r["count"]) for r in found} == golden.CLONES
    assert {r.mutationId for r in kept["large_final_mutations"].collect()} == {1, 2, 3}
    assert [r.ids for r in kept["muller_data"].collect()] == [[0, 1, 3]] * 5
    with pytest.raises(ValueError, match="holds results made from"):
        jobs.chronicle(spark, stored, out)
    major = {r.timePoint: r.systemSize for r in kept["major_stats_scalars"].collect()}
    noise = {r.timePoint: r.systemSize for r in kept["noise_stats_scalars"].collect()}
    for time, (_, size, _) in golden.STATS.items():
        assert major.get(time, 0) + noise.get(time, 0) == size
    lines = spark.read.text(f"{out}/histogram_birthEfficiency.csv").collect()
    assert len(lines) == 5 and all(r.value.count(";") == 99 for r in lines)
    other = jobs.analyze(spark, stored, out, threshold=1, initial=golden.initial(spark))
    assert {r.mutationId for r in other["large_clones"].collect()} == {1, 2, 3}

    reports = jobs.report(kept, shown=2, drawn_above=1)
    assert [r.mutationId for r in reports["top_mutations"].collect()] == [1, 2]
    assert reports["second_share"].first().percent == 100.0
    assert {r.mutationId for r in reports["tree_vertices"].collect()} == {1, 2, 3}
    assert reports["muller_params"].count() == 2
    assert "normalized_entropy" in reports["stats"].columns
    shares = reports["muller_fractions"].groupBy("timePoint").agg(F.sum("fraction").alias("f")).collect()
    assert all(r.f == pytest.approx(1.0) for r in shares)
    assert reports["histogram_fractions"].count() == 5 and reports["tree_roots"].count() == 1


def test_tables_that_need_nothing_of_each_other_are_built_at_the_same_time(spark, tmp_path, log_file, monkeypatch):
    """Each of a group waits for the others, so that building one after another would fail."""
    stored = str(tmp_path / "stored")
    jobs.convert(spark, log_file, stored)

    def meeting(*builders):
        meet = threading.Barrier(len(builders))
        for module, name in builders:
            build = getattr(module, name)
            monkeypatch.setattr(module, name, lambda *given, build=build, **more: (meet.wait(60), build(*given, **more))[1])

    meeting((snapshots, "clone_snapshots"), (phylogeny, "mutation_tree"), (muller, "large_clones"))
    meeting((muller, "large_muller_order"), (phylogeny, "mutation_frequency"), (phylogeny, "mutation_summary"))
    kept = jobs.analyze(spark, stored, str(tmp_path / "out"), threshold=2, initial=golden.initial(spark))
    assert {(r.mutationId, r.parentMutationId, r.time) for r in kept["mutation_tree"].collect()} == golden.TREE
    assert {r.mutationId for r in kept["large_final_mutations"].collect()} == {1, 2, 3}


def test_histograms_of_all_parameters_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    """Each file waits for the others, so that writing one after another would fail."""
    arrays = ", ".join(f"'{p}', array({k}, {k + 1})" for k, p in enumerate(PARAMS))
    counted = spark.sql(f"select cast(timePoint as double) as timePoint, named_struct({arrays}) as histograms from values (2), (1) as t(timePoint)")
    meet, join = threading.Barrier(len(PARAMS)), tables.F.array_join
    monkeypatch.setattr(tables.F, "array_join", lambda *given: (meet.wait(60), join(*given))[1])
    tables.write_histograms(counted, f"{tmp_path}/", single_file=True)
    for k, name in enumerate(PARAMS):
        assert [r.value for r in spark.read.text(f"{tmp_path}/histogram_{name}.csv").collect()] == [f"{k};{k + 1}"] * 2


def test_linear_job(spark, tmp_path, log_file):
    stored, out = str(tmp_path / "stored"), str(tmp_path / "out")
    jobs.convert(spark, log_file, stored)
    jobs.linear_chronicle(spark, stored, out)
    rows = spark.read.parquet(f"{out}/linear_chronicles.parquet")
    assert rows.count() == 125 + 8 and rows.filter("eventId = 0").count() == 125


def test_snapshot_text_job(spark, tmp_path):
    header = ",".join([*jobs.TEXT_PARAMS, jobs.MUTATION_COLUMN])

    def cell(value, mutation):
        return ",".join([str(value)] * 6 + [str(mutation)])

    first = [cell(0.25, 1)] * 12 + [cell(0.5, 2)] * 3
    second = [cell(0.25, 1)] * 5 + [cell(0.5, 3)] * 11 + [cell(1.0, 2)] * 4
    text = "\n".join(["time = 0.0", header, *first, "", "time = 1.0", header, *second, "", ""])
    (tmp_path / "s.txt").write_text(text)
    (tmp_path / "parent_mutations.csv").write_text("1,0\n2,1\n3,2\n")
    done = jobs.snapshot_text_analysis(spark, str(tmp_path / "s.txt"), str(tmp_path / "parent_mutations.csv"))
    rows = {(r["timePoint"], r["place"]): (r["mutationId"], r["count"], r["fraction"]) for r in done["prevalence"].collect()}
    assert rows == {
        (0.0, 0): (0, 3, 0.2),
        (0.0, 1): (1, 12, 0.8),
        (1.0, 0): (0, 4, 0.2),
        (1.0, 1): (1, 5, 0.25),
        (1.0, 2): (3, 11, 0.55),
    }
    assert {r.mutationId for r in done["mutations"].collect()} == {1, 2, 3}
    late = done["histograms"].filter("timePoint = 1.0 and parameter = 'birthEfficiency'").first().histogram
    # The four cells at 1.0 lie outside and count neither above nor below the line.
    assert late[250] == 5 / 16 and late[500] == 11 / 16 and len(late) == 1000


def test_rows_of_a_cut_log_keep_their_order(spark):
    """At this size the writer's own sort by file put the rows of one file in another order."""
    from poplineage.catalog import from_files

    rows = event_log.read_events(spark, from_files._cut_log(spark, "/root/testdata/sf0.1"), "csv", cut_off=True)
    times = rows.select("ord", "time").orderBy("ord").toArrow().column("time").to_pylist()
    assert len(times) == 99_998 and times == sorted(times)
