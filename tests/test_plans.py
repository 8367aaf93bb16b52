"""What the plans must and must not contain."""

import re

import pytest

from hazardflow.checks import load

QUERIES = load().QUERIES
PYTHON_OK = {"prediction_reuse", "reuse_stats", "shared_predictions", "user_model", "routing_load", "triage_response"}
# These run jobs while they are built.
EAGER = {n for n in QUERIES if n.startswith("stream_")} | {
    "severity_training", "severity_scoring", "severity_scoring_distinct", "feature_importances", "escalation_training",
    "escalation_scoring", "sequence_table",
}


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_row_python_and_no_cross_join(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        assert "Python" not in plan and "MapInPandas" not in plan


def windows_without_grouping(plan: str) -> list[str]:
    """Window operators fed by a single partition that holds ungrouped rows."""
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            above = [x for x in lines[max(0, i - 4) : i] if "Window" in x]
            below = "\n".join(lines[i + 1 : i + 6])
            if above and "Aggregate" not in below and "Window" not in below:
                found.append(line)
    return found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_window_over_all_rows_in_one_task(spark, small, name):
    assert windows_without_grouping(plan_of(QUERIES[name](spark, small))) == []


@pytest.mark.parametrize("name", ["prior_event_count", "hours_since_last", "historical_severity_avg", "escalation_labels"])
def test_rows_move_once(spark, small, name):
    """Row-level data is shuffled only by (key, slice); grouped tables are small."""
    plan = plan_of(QUERIES[name](spark, small))
    for line in plan.splitlines():
        if re.search(r"(?<!Broadcast)Exchange hashpartitioning\(event_type[^,]*, \d+\)", line):
            after = plan[plan.index(line) + len(line) :].splitlines()[1]
            assert "HashAggregate" in after


def test_scan_reads_only_needed_columns(spark, small):
    plan = plan_of(QUERIES["feed_item_counts"](spark, small))
    assert "ReadSchema: struct<event_id:bigint>" in plan
    plan = plan_of(QUERIES["latency_histogram"](spark, small))
    assert "props" not in plan.split("ReadSchema")[1]


def test_triage_is_one_stage(spark, small):
    plan = plan_of(QUERIES["untrained_severity"](spark, small))
    assert "Exchange" not in plan


def test_filters_reach_the_scan(spark, small):
    """A condition on a stored column is read by the scan of a registered query, beside the derived condition."""
    plan = plan_of(QUERIES["seismic_filter"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,view\)", plan)


def test_traffic_split_needs_no_join(spark, small):
    assert "Join" not in plan_of(QUERIES["traffic_split"](spark, small))
    assert "Join" not in plan_of(QUERIES["forced_version"](spark, small))


def test_flagship_computes_the_features(spark, small):
    """The severity model reads all ten features, so none is pruned."""
    plan = plan_of(QUERIES["routing_load"](spark, small))
    assert "ArrowEvalPython" in plan and "wildfire" in plan.lower() and "cos(" in plan.lower()
