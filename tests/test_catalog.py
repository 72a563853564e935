"""Every query against its SQL on the smallest tables."""

import os
import re

import oracle
import pytest

import __spark_entry__ as entry
from poplineage.catalog import QUERIES, SQL, from_jobs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|Python|ArrowEval", plan)
    assert oracle.difference(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_logs_of_a_campaign_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    """Each write waits for the others, so that writing one after another would fail."""
    import shutil
    import threading

    from poplineage.catalog import from_campaign as campaign

    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    meet, save = threading.Barrier(campaign.RUNS), campaign.tables.save_csv
    monkeypatch.setattr(campaign.tables, "save_csv", lambda df, path: (meet.wait(60), save(df, path)))
    monkeypatch.setattr(campaign.jobs, "campaign", lambda spark, root, out, *more, **options: {"root": root})
    root = campaign.analysis(spark, str(tmp_path))[0]["root"]
    assert spark.read.option("header", True).csv(f"{root}/*").count() == spark.read.parquet(str(tmp_path)).count()


class Caught(Exception):
    """Carries what would have been written."""


def test_the_log_is_sorted_before_its_columns_are_made(spark, monkeypatch):
    """One task reads a table of one row group, so what follows from its columns belongs behind the exchange."""

    def caught(rows, path):
        raise Caught(rows)

    monkeypatch.setattr(from_jobs.tables, "save_csv", caught)
    with pytest.raises(Caught) as held:
        from_jobs._analysis.__wrapped__(spark, FOLDER, "")
    plan = held.value.args[0]._jdf.queryExecution().executedPlan().toString()
    behind, ahead = plan.split("Exchange rangepartitioning")
    assert "regexp_extract" in behind and "regexp_extract" not in ahead
