"""Every registered query against its reference SQL, and the shape of their plans."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import compare
from tablepulse import catalog

QUERIES = catalog.callables()
SQL = catalog.reference_sql()

# Inventory ids that the registered queries must cover.
IDS = (
    ["prj_01", "prj_02", "set_01", "win_01", "lin_01", "lin_02", "lin_03", "src_01", "src_02", "src_03", "src_05", "src_06", "src_07"]
    + [f"flt_{i:02}" for i in range(1, 7)]
    + [f"jn_{i:02}" for i in range(1, 9)]
    + [f"agg_{i:02}" for i in range(1, 8)]
    + [f"top_{i:02}" for i in range(1, 6)]
    + [f"fn_{i:02}" for i in range(1, 18) if i != 15]
    + [f"reg_{i:02}" for i in range(1, 12)]
    + [f"sch_{i:02}" for i in range(2, 10)]
    + [f"med_{i:02}" for i in range(1, 7)]
    + [f"dq_{i:02}" for i in range(1, 17)]
    + [f"dr_{i:02}" for i in range(1, 14)]
    + [f"co_{i:02}" for i in range(1, 10)]
    + [f"he_{i:02}" for i in range(1, 11)]
    + [f"mq_{i:02}" for i in range(1, 45)]
    + [f"snk_{i:02}" for i in (1, 5, 6, 7, 8, 9)]
    + [f"st_{i:02}" for i in range(1, 10)]
    + [f"ext_{i:02}" for i in range(1, 4)]
)


# These run streams or write files before they return, so only their last read shows.
EAGER = ("st_01", "st_05", "st_07", "st_09", "jn_08", "src_0", "sch_09", "lin_03_layer", "snk_06", "snk_07", "snk_09_heal_facts", "ext_03",
         "snk_01_rerun", "lin_03_rerun", "snk_05_upload", "he_07_status", "he_08_status", "he_09_outbox", "he_05_actions_of", "mq_02_recent_runs_of",
         "mq_23_windows_of", "mq_28_cost_history_of")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_reference_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    if not name.startswith(EAGER):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
        assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    assert compare.differences(df, duck, SQL[name]) == []


def test_inventory_is_covered():
    assert [i for i in IDS if not any(name.startswith(i) for name in QUERIES)] == []


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_returns_scores(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize(
    "name", ["dq_score_by_event_type", "dr_13_drift_run", "med_01_silver_additions", "sch_04_sample_values", "reg_02_latest_values"]
)
def test_no_window_over_one_partition(spark, folder, name):
    """A single partition only ever receives counts that were summed before."""
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for block in plan.split("Exchange SinglePartition")[1:]:
        assert re.match(r"[^\n]*\n[^\n]*(HashAggregate|LocalLimit|GlobalLimit|ObjectHashAggregate|Project)", block), block[:300]
