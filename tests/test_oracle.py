"""Registered queries against their SQL; ORACLE_ALL=1 takes all of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from catalog import registry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = """history_stats list_runs run_distribution expanded_summary read_items search_tasks ewma default_estimate concurrency_timeline
renumber_results slowest natural_order overlap_count run_details blocking_sessions fan_out_predecessors expand_wildcards read_task_lines
results_to_cells taskfile_json_out validate_tasks levels ready_tasks skip_closure runtime_estimates concurrency_ceiling contention_report
task_signature task_state_fold history_append settled_states levels_stages ready_stages cycle_path read_task_text detect_text_mode
read_checkpoint_files merged_workflow_stats""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES) and len(registry.QUERIES) == 148
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registry.QUERIES) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
