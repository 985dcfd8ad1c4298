"""Sketched durations: rank error against exact ranks, merging, and the flag of the funnel."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.operators.funnel import ACCURACY, step_times

STEPS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def events(spark):
    """20,000 users enter at one instant; b follows after id seconds, c after twice that for half."""
    users = spark.range(0, 20_000, 1, 4)
    start = F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz")

    def event(name, seconds):
        at = start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
        return users.filter(seconds.isNotNull()).select(
            F.col("id").alias("user_id"),
            at.alias("event_ts"),
            F.lit(name).alias("event_name"),
            F.when(F.col("id") % 10 < 3, "x").otherwise("y").alias("platform"),
        )

    parts = [F.lit(0), F.col("id") + 1, F.when(F.col("id") % 2 == 0, 2 * F.col("id") + 2)]
    table = event("a", parts[0]).unionByName(event("b", parts[1])).unionByName(event("c", parts[2]))
    return table.cache()


def rank_error(hours, probability, largest):
    return abs(hours * 3600 / largest - probability)


def test_rank_error(events):
    found = sw.funnel_quantiles(events, STEPS, [0.01, 0.5, 0.99], window_hours=100).collect()
    assert [r.users for r in found] == [20_000] * 6 + [10_000] * 3
    for r in found[3:]:
        largest = 20_000 if r.step_name == "b" else 40_000
        assert rank_error(r.hours, r.probability, largest) <= 4 / ACCURACY


def test_merged_sketches_answer_for_the_whole(events):
    times = step_times(events, STEPS, by=["platform"])
    parts = sw.duration_sketches(times, STEPS, window_hours=100, by=["platform"])
    assert parts.count() == 6
    merged = sw.merge_durations(parts)
    found = {(r.step_name, r.probability): r for r in sw.duration_quantiles(merged, STEPS, [0.25, 0.75]).collect()}
    assert found["b", 0.25].users == 20_000
    for p in (0.25, 0.75):
        assert rank_error(found["b", p].hours, p, 20_000) <= 4 / ACCURACY
    by_platform = sw.merge_durations(parts, by=["platform"])
    assert sorted(by_platform.filter("step_index = 1").select("users").collect()) == [(6000,), (14000,)]


def test_flag(events, funnel_events):
    exact = sw.funnel(events, STEPS, window_hours=100).collect()
    near = sw.funnel(events, STEPS, window_hours=100, median="sketch").collect()
    none = sw.funnel(events, STEPS, window_hours=100, median="none").collect()
    for a, b, c in zip(exact, near, none, strict=True):
        assert (a.users, a.dropped, a.step_conversion) == (b.users, b.dropped, b.step_conversion)
        assert b.median_hours == pytest.approx(a.median_hours, rel=0.02) and (c.median_hours or 0) == 0
    empty = sw.funnel(events.limit(0), STEPS, median="sketch").collect()
    assert [r.median_hours for r in empty] == [0.0, None, None]
    # few durations are all in the sketch
    small = sw.funnel(funnel_events, ["visit", "basket", "order"], window_hours=300, median="sketch")
    assert [r.median_hours for r in small.collect()][0] == 0.0
    plan = sw.funnel(events, STEPS, median="sketch")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(step" not in plan


def test_validation(events):
    for wrong in ([], [1.5], [-0.1]):
        with pytest.raises(ValueError, match="probabilities"):
            sw.funnel_quantiles(events, STEPS, wrong)
    with pytest.raises(ValueError, match="median must be one of"):
        sw.funnel(events, STEPS, median="guess")
