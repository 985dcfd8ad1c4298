"""Cubes from stored sets of users against the operators that read events."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import MONDAY
from pyspark.sql import functions as F

import stepwell as sw

DIMS = ["channel", "platform"]


@pytest.fixture(scope="module")
def events(spark, table):
    """Users who change channel and platform from event to event, some without id."""
    rng = random.Random(11)
    rows = [
        (
            f"u{rng.randrange(60)}",
            MONDAY + timedelta(hours=rng.randrange(24 * 7 * 6)),
            rng.choice(["signup", "lesson_start", "lesson_start", "other"]),
            rng.choice(["ads", "organic"]),
            rng.choice(["ios", "web", "android"]),
        )
        for _ in range(700)
    ]
    rows.append(("u1", MONDAY + timedelta(days=60), "other", "empty", "web"))
    none = F.when(F.crc32("user_id") % 13 != 0, F.col("user_id"))
    return table(*rows).withColumn("user_id", none).withColumn("channel", F.nullif("channel", F.lit("ads"))).cache()


@pytest.fixture(scope="module")
def sets(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sets") / "week")
    sw.user_sets(events, DIMS, "week").write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("horizon", ["segment", "global"])
@pytest.mark.parametrize("max_periods", [0, 3, 12])
def test_cohort_cube(events, sets, horizon, max_periods):
    options = {"max_periods": max_periods, "horizon": horizon}
    got = sw.cohort_cube(sets, DIMS, **options)
    expected = sw.retention_cube(events, DIMS, **options)
    assert got.columns == expected.columns
    assert rows_of(got) == rows_of(expected)


def test_naive_cube(events, sets):
    steps = ["signup", "lesson_start", "never"]
    got = sw.naive_funnel_cube(sets, steps, DIMS)
    expected = sw.naive_funnel(sw.with_levels(events, DIMS), steps, by=["level", *DIMS])
    assert rows_of(got) == rows_of(expected)


def test_months_and_no_dimension(events):
    sets = sw.user_sets(events, [], "month")
    got = sw.cohort_cube(sets, [], period="month", max_periods=2).drop("level")
    assert rows_of(got) == rows_of(sw.retention(events, period="month", max_periods=2))


def test_many_buckets(spark):
    users = spark.range(100_000).select(
        F.col("id").alias("user_id"),
        F.lit(MONDAY).cast("timestamp_ntz").alias("event_ts"),
        F.explode(F.array(F.lit("a"), F.when(F.col("id") % 4 == 0, "b"))).alias("event_name"),
        F.concat(F.lit("p"), F.col("id") % 3).alias("platform"),
    ).filter("event_name IS NOT NULL")
    numbers = sw.number_users(users)
    assert numbers.agg(F.min("number"), F.max("number"), F.countDistinct("number")).head() == (1, 100_000, 100_000)
    sets = sw.user_sets(users, ["platform"], "week", numbers)
    cube = sw.naive_funnel_cube(sets, ["a", "b"], ["platform"])
    whole = {r.step_name: r.users for r in cube.filter("level = 'all'").collect()}
    assert whole == {"a": 100_000, "b": 25_000}


def test_events_are_read_once_and_never_repeated(spark, events, sets):
    plan = sw.cohort_cube(sets, DIMS)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "user_id" not in plan
    base = sw.user_sets(events, DIMS, "week")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in base


def test_empty(events):
    sets = sw.user_sets(events.limit(0), DIMS, "week")
    assert sets.count() == 0 and sw.cohort_cube(sets, DIMS).count() == 0
    assert sw.naive_funnel_cube(sets, ["a", "b"], DIMS).count() == 0
