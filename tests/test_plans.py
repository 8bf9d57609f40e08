"""Physical plans: what must not appear, and what must."""

import pytest

from wiretally.plans import catalog

SF = "/root/testdata/sf0.001"
# these join a single-row total, page count or flag; every other nested loop would be a defect
ONE_ROW_JOINS = {
    "audit_page", "indicator_page", "match_page", "weekly_recommendations", "purged_indicators", "overview", "seeded_rules",
    "dashboard", "chosen_backends", "sticky_sessions", "split_stats", "routed_slots",
}


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_products_or_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert name in ONE_ROW_JOINS or "BroadcastNestedLoopJoin" not in text


def test_limits_reach_the_tasks(spark):
    assert "TakeOrderedAndProject" in plan(spark, "audit_page")
    assert "TakeOrderedAndProject" in plan(spark, "pattern_top10")


def test_scans_read_what_they_need(spark):
    text = plan(spark, "screen_severity_by_source")
    assert "ReadSchema: struct<text:string,source:string>" in text
    assert "PushedFilters: [IsNotNull(dest" not in text
    assert "GreaterThanOrEqual(ts" in plan(spark, "provider_costs") or "ts >=" in plan(spark, "provider_costs")


def test_sliced_windows_shuffle_rows_by_place(spark):
    """No shuffle of the log by its few (type, direction) groups; rows go by (group, slice)."""
    text = plan(spark, "routed_queries")
    assert "Exchange hashpartitioning(db_type#" not in text.split("Window [")[0]
    assert "Exchange hashpartitioning(_place" in text


@pytest.mark.parametrize("name", ["lru_evict", "training_half"])
def test_order_without_keys_gathers_no_rows(spark, name):
    """The one exchange to a single task is of a total, a row for each task."""
    gathered = {line.split("plan_id=")[1] for line in plan(spark, name).splitlines() if "Exchange SinglePartition" in line}
    assert len(gathered) <= 1


@pytest.mark.parametrize("name", ["blocked_access", "threat_matches", "screened_log", "custom_rule_hits"])
def test_matches_bring_their_reason(spark, name):
    """The log is shuffled by no id that most of its rows lack, and not by its text."""
    text = plan(spark, name)
    for column in ("rule_id", "indicator_id", "custom_rule", "low", "_text", "query"):
        assert f"Exchange hashpartitioning({column}#" not in text


def test_screening_goes_over_tests_in_the_row(spark):
    assert "hashpartitioning(gram" not in plan(spark, "threat_matches").split("FileScan parquet")[0]
