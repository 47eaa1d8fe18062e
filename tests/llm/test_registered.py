"""Registered training-data queries: SQL equivalents on the smallest tables, and what runs natively."""

import os
import sys
from pathlib import Path

import pytest

from canopyframe.llm import registry

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import DATA, both  # noqa: E402

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    got, want = both(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.split("_")[0] in ("op8", "op9", "op10")))
def test_native_queries_run_no_python(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert {*registry.QUERIES, "pipeline", "q_layer_temperature"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
