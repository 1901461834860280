"""Shape of the physical plans: one shuffle per ordered operator, no Python, measured broadcasts."""

import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
ONE_SHUFFLE = [
    "latest_event", "latest_three", "running_value", "replay_limit_1", "hourly_sessions",
    "menu_intervals", "threshold_changes", "panel_state", "expiry_times", "unexpired_values",
    "chart_styles",
]
NO_SHUFFLE = [
    "flat_menus", "returned_with_supplier", "priority_texts", "event_labels", "event_titles",
    "series_colours", "measure_rows", "scalar_values",
]
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas")


def plan(spark, name):
    df = entry_point.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, shuffles", [(n, 1) for n in ONE_SHUFFLE] + [(n, 0) for n in NO_SHUFFLE])
def test_shuffles(spark, name, shuffles):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == shuffles
    assert not [p for p in PYTHON if p in text]
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["returned_with_supplier", "priority_texts", "event_labels"])
def test_small_sides_are_broadcast(spark, name):
    text = plan(spark, name)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "hourly_sessions")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(spark, "expiry_times")


def test_newest_rows_are_limited_before_the_shuffle(spark):
    lines = plan(spark, "latest_three").splitlines()
    kinds = [k for line in lines for k in ("WindowGroupLimit", "Exchange") if k in line]
    assert kinds == ["WindowGroupLimit", "Exchange", "WindowGroupLimit"]


def test_cut_keys_are_spread(spark):
    assert "hashpartitioning(user_id" in plan(spark, "threshold_changes_cut")
    assert "_chunk" in plan(spark, "threshold_changes_cut")
