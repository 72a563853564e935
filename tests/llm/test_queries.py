"""Queries with SQL against DuckDB, and where others are registered."""

import oracle
import pytest

import __spark_entry__ as entry
from poplineage.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(sql.SQL))
def test_same_as_sql(spark, name):
    assert oracle.difference(queries.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), sql.SQL[name]) is None


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_native_mix(spark):
    plan = queries.op8_source_mix(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
