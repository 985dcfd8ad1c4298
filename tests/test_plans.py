"""The physical plans keep the shape they were designed to have."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.sources.adapters import clickstream_events, order_events

SF = "/root/testdata/sf0.001"
STEPS = ["signup", "view", "click", "purchase"]


@pytest.fixture(scope="module")
def clicks(spark):
    return clickstream_events(spark, SF)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_funnel_moves_events_once_and_joins_nothing(clicks):
    plan = plan_of(sw.funnel(clicks, STEPS))
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) == 1
    assert plan.count("FileScan") == 1
    assert "Join" not in plan and "CartesianProduct" not in plan
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "In(event_type, [click,purchase,signup,view])" in pushed
    assert "IsNotNull(user_id)" in pushed  # a NULL is no user
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_compare_costs_one_pass(clicks):
    plan = plan_of(sw.compare(clicks, STEPS))
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) == 1


def test_naive_funnel_combines_before_the_shuffle(clicks):
    plan = plan_of(sw.naive_funnel(clicks, STEPS))
    assert "partial_bit_or" in plan and plan.count("FileScan") == 1
    assert "Window" not in plan


def test_a_bucketed_table_moves_no_event(spark, clicks):
    clicks.write.mode("overwrite").bucketBy(4, "user_id").saveAsTable("bucketed_clicks")
    try:
        plan = plan_of(sw.step_times(spark.table("bucketed_clicks"), STEPS, colocated=True))
        assert "Exchange" not in plan and plan.count("FileScan") == 1
    finally:
        spark.sql("DROP TABLE bucketed_clicks")


def test_retention_scans_once_without_a_join(spark):
    events = order_events(spark, SF)
    plan = plan_of(
        sw.retention(events, period="month", signup_event="O", activity_event="F")
    )
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string" in plan
    # events are folded to (user, period) inside the scan stage
    below_first_exchange = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "HashAggregate" in below_first_exchange and "partial_max" in below_first_exchange


def test_filters_reach_the_scan(spark):
    events = order_events(spark, SF)
    plan = plan_of(
        sw.retention(
            events, signup_event="O", activity_event="F", filters={"platform": ["1-URGENT"]}
        )
    )
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def heavy_plan(spark, clicks, steps) -> str:
    heavy = spark.createDataFrame([(1, 3), (2, 5)], "user_id long, slices long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan_of(sw.step_times(clicks, steps, heavy=heavy))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_heavy_users_cost_the_same_rounds_for_any_number_of_steps(spark, clicks):
    shapes = set()
    for steps in (STEPS[:2], STEPS, [*STEPS, "error", "x", "y", "z"]):
        plan = heavy_plan(spark, clicks, steps)
        assert plan.count("FileScan") == 2  # light users, heavy users
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
        shapes.add((plan.count("Exchange hashpartitioning"), plan.count("BroadcastExchange")))
    assert len(shapes) == 1


def test_finding_heavy_users_is_one_job_of_bounded_shuffle(spark, clicks):
    from stepwell.operators.funnel import step_events
    from stepwell.plans import skew

    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    skew.heavy_keys(step_events(clicks, STEPS))
    assert len(set(tracker.getJobIdsForGroup(None)) - before) <= 2  # adaptive execution: shuffle, result
    found = step_events(clicks, STEPS).groupBy("user_id").count().filter("count > 60").collect()
    got = skew.heavy_keys(step_events(clicks, STEPS), rows_per_task=60).collect()
    assert {(r.user_id, -(-r["count"] // 60)) for r in found} == {(r.user_id, r.slices) for r in got}


def test_medians_of_wide_windows_need_no_window_per_step(clicks):
    narrow = plan_of(sw.funnel(clicks, STEPS, window_hours=72))
    wide = plan_of(sw.funnel(clicks, STEPS, window_hours=24 * 365))
    by_step = re.compile(r"windowspecdefinition\(step")
    assert by_step.search(narrow) and not by_step.search(wide)
    assert wide.count("FileScan") <= 2  # one, once adaptive execution has reused the exchange


def test_a_cube_repeats_events_behind_their_exchange(clicks):
    plan = plan_of(sw.funnel_cube(clicks, STEPS, ["platform"], rows_per_task=1 << 60))
    moved = plan.rindex("Exchange hashpartitioning(user_id")
    assert "Generate explode" in plan[:moved]
    assert "Generate explode" not in plan[moved : plan.index("FileScan", moved)]


def test_the_global_horizon_needs_no_second_scan(clicks):
    plan = plan_of(sw.retention(clicks, activity_event="purchase", by=["platform"], horizon="global"))
    assert plan.count("FileScan") == 1


def test_matrix_needs_no_job_to_find_its_columns(clicks, spark):
    long = sw.retention(clicks, activity_event="purchase", max_periods=3)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    sw.as_matrix(long, max_periods=3)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_results_do_not_depend_on_the_session_time_zone(spark, retention_events, funnel_events):
    def results():
        return (
            sw.retention(retention_events, max_periods=3).collect(),
            sw.funnel(funnel_events, ["visit", "basket"], window_hours=999).collect(),
            sw.cohort_sizes(sw.retention(retention_events)).collect(),
        )

    expected = results()
    for zone in ("America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert results() == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dst_gap_is_an_ordinary_hour(spark, table):
    """02:30 on the night clocks go forward exists in zone-less time."""
    from datetime import datetime

    events = table(
        ("u", datetime(2026, 3, 8, 1, 30), "a"), ("u", datetime(2026, 3, 8, 3, 30), "b")
    ).withColumn("event_ts", F.col("event_ts"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = sw.funnel(events, ["a", "b"], window_hours=2).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.users for r in rows] == [1, 1]
    assert rows[1].median_hours == 2.0
