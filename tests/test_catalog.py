"""The registered queries, their twins, and a few plans."""

import __spark_entry__ as entry
from tradewright.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(entry.oracle_sql()) - set(entry.queries()) == set()
    assert set(catalog.QUERIES) - set(oracle.SQL) == {"e10_random_entry_baseline"}


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["weight"] <= 0.2 for r in rows)


def test_joins_with_candles_form_no_nested_loops(spark):
    for name in ("j9_as_of", "j10_interval_excursions", "a2_leave_self_out"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_scans_are_pruned(spark):
    plan = entry.queries()["q8_key_uniqueness"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
