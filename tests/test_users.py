"""Attributes of users as segments and filters equal the same columns joined to every event."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.sources.adapters import clickstream_events, order_events, user_channels

SF = "/root/testdata/sf0.001"
STEPS = ["signup", "view", "click", "purchase"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def users(spark):
    """Customers with a segment; one in five is missing, and two segments have no customer here."""
    known = user_channels(spark, SF).filter("user_id % 5 != 0")
    return known


@pytest.fixture(scope="module")
def clicks(spark):
    return clickstream_events(spark, SF)


@pytest.fixture(scope="module")
def joined(clicks, users):
    return clicks.join(users, "user_id", "left")


FILTERS = [
    None,
    {"channel": ["BUILDING", "AUTOMOBILE"]},
    {"channel": ["MACHINERY", "BUILDING"], "platform": ["ios", "web"]},
    {"channel": []},
]


@pytest.mark.parametrize("filters", FILTERS)
@pytest.mark.parametrize("by", [[], ["platform"]])
def test_filters(clicks, users, joined, filters, by):
    for operator in (sw.funnel, sw.naive_funnel, sw.compare, sw.overcount_reasons):
        got = operator(clicks, STEPS, filters=filters, by=by, users=users)
        assert rows_of(got) == rows_of(operator(joined, STEPS, filters=filters, by=by))
    options = {"activity_event": "purchase", "max_periods": 4, "filters": filters, "by": by}
    assert rows_of(sw.retention(clicks, users=users, **options)) == rows_of(sw.retention(joined, **options))


@pytest.mark.parametrize("by", [["channel"], ["platform", "channel"]])
def test_segments(clicks, users, joined, by):
    for operator in (sw.funnel, sw.naive_funnel, sw.compare, sw.overcount_reasons):
        got = operator(clicks, STEPS, by=by, users=users)
        assert rows_of(got) == rows_of(operator(joined, STEPS, by=by))
    for horizon in ("segment", "global"):
        options = {"activity_event": "purchase", "max_periods": 4, "by": by, "horizon": horizon}
        assert rows_of(sw.retention(clicks, users=users, **options)) == rows_of(sw.retention(joined, **options))


def test_segments_without_a_step_are_reported(clicks, users):
    new = clicks.limit(1).select(F.lit(-1).cast("long").alias("user_id"), "event_ts", F.lit("error").alias("event_name"), "platform")
    more = users.unionByName(users.limit(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("NEW").alias("channel")))
    for operator in (sw.funnel, sw.naive_funnel):
        rows = operator(clicks.unionByName(new), STEPS, by=["channel"], users=more).filter("channel = 'NEW'")
        assert [r.users for r in rows.collect()] == [0, 0, 0, 0]
        assert operator(clicks, STEPS, by=["channel"], users=more).filter("channel = 'NEW'").count() == 0


def test_events_of_no_user(spark, clicks, users):
    none = clicks.withColumn("user_id", F.when(F.col("user_id") != 3, F.col("user_id")))
    joined = none.join(users, "user_id", "left")
    options = {"activity_event": "purchase", "max_periods": 4, "by": ["channel"]}
    assert rows_of(sw.retention(none, users=users, **options)) == rows_of(sw.retention(joined, **options))


def test_values(clicks, users, joined):
    got = [r[0] for r in sw.distinct_attribute(clicks, "channel", users).collect()]
    assert got == [r[0] for r in sw.distinct_values(joined, "channel").collect()]


def test_a_column_of_both_is_refused(joined, users):
    with pytest.raises(ValueError, match="both events and users"):
        sw.funnel(joined, STEPS, by=["channel"], users=users)


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_events_move_once(spark, no_broadcast):
    """With tables too large to broadcast, events cross one exchange by user."""
    users = user_channels(spark, SF)
    plans = [
        sw.funnel(clickstream_events(spark, SF), STEPS, by=["channel"], users=users, median="none"),
        sw.funnel(
            clickstream_events(spark, SF), STEPS, filters={"channel": ["BUILDING"]}, users=users, median="none"
        ),
        sw.retention(order_events(spark, SF), signup_event="O", activity_event="F", by=["channel"], users=users),
    ]
    for df, reads in zip(plans, (2, 1, 1), strict=True):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"FileScan parquet \[(.*?)\] .*?(?:events|orders)\.parquet", plan)
        assert len(scans) == reads
        # a second read is of user ids only, folded to one row per user before it moves
        assert sum("ts#" in x or "o_orderdate#" in x for x in scans) == 1
