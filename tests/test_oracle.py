"""Every registered query against DuckDB on the smallest tables."""

import functools

import compare
import pytest

import __spark_entry__ as entry
from formloom.plans.queries import registry
from formloom.sources import tables
from oracle.registry import registry as oracle_registry

SF = "/root/testdata/sf0.001"
ORACLE = oracle_registry()


def test_every_query_has_an_oracle():
    assert set(registry()) == set(ORACLE)
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert set(registry()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    con = compare.connect(SF)
    assert compare.difference(entry.queries()[name](spark, SF), con, ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["q_sheet", "q_lines", "q_top_candidates"])
def test_spread_inputs_give_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "read", functools.partial(tables.read, spread=True))
    assert tables.read(spark, SF, "orders").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert compare.difference(entry.queries()[name](spark, SF), compare.connect(SF), ORACLE[name]) == ""
