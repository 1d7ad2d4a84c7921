"""Every registered query runs, and equals its DuckDB twin where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__
from vellum.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_its_twin(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_runs_without_a_twin(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "text"]
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert catalog.SQL.keys() <= __spark_entry__.oracle_sql().keys()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["page_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
