"""Both chain plans against a plain per-user loop, on random histories with many ties."""

from __future__ import annotations

import random
from datetime import timedelta
from statistics import median

import pytest
from conftest import MONDAY, column

import stepwell as sw
from stepwell.operators.funnel import step_events, step_times
from stepwell.plans.skew import heavy_keys

STEPS = ["a", "b", "c", "d"]
HOUR = timedelta(hours=1)


@pytest.fixture(scope="module")
def histories():
    """500 users with up to 14 events each, on a grid of 20 hours so that times collide."""
    rng = random.Random(7)
    return {
        f"u{u}": [
            (MONDAY + HOUR * rng.randrange(20), rng.choice([*STEPS, "x"]))
            for _ in range(rng.randrange(15))
        ]
        for u in range(500)
    }


@pytest.fixture(scope="module")
def random_events(table, histories):
    rows = [(user, ts, name) for user, events in histories.items() for ts, name in events]
    return table(*rows).cache()


def chain(history, window=None, window_from="entry"):
    """Times of the steps reached, one step at a time, straight from the definition."""
    reached = []
    for step in STEPS:
        times = [ts for ts, name in history if name == step]
        if reached:
            anchor = reached[0] if window_from == "entry" else reached[-1]
            times = [t for t in times if t > reached[-1] and (not window or t <= anchor + window)]
        if not times:
            break
        reached.append(min(times))
    return reached


@pytest.mark.parametrize("small", [0, 1 << 60], ids=["slices", "windows"])
def test_times_of_every_user(random_events, histories, small):
    times = step_times(random_events, STEPS, rows_per_task=small)
    got = {
        r.user_id: ([r[f"t{i}"] for i in range(4)], [r[f"ever{i}"] for i in range(4)])
        for r in times.collect()
    }
    expected = {}
    for user, history in histories.items():
        names = {name for _, name in history}
        if names & set(STEPS):
            reached = chain(history)
            padded = reached + [None] * (4 - len(reached))
            expected[user] = (padded, [step in names for step in STEPS])
    assert got == expected


@pytest.mark.parametrize("window_from", ["entry", "previous"])
@pytest.mark.parametrize("window_hours", [2, 5, 12])
def test_counts_and_medians(random_events, histories, window_hours, window_from):
    options = {"window_hours": window_hours, "window_from": window_from}
    rows = sw.funnel(random_events, STEPS, **options).collect()
    reasons = sw.overcount_reasons(random_events, STEPS, **options).collect()
    in_time = [chain(h, HOUR * window_hours, window_from) for h in histories.values()]
    in_order = [chain(h) for h in histories.values()]
    for i, (row, why) in enumerate(zip(rows, reasons, strict=True)):
        delays = [(c[i] - c[0]) / HOUR for c in in_time if len(c) > i]
        ordered = sum(len(c) > i for c in in_order)
        naive = sum(any(name == STEPS[i] for _, name in h) for h in histories.values())
        assert row.users == why.counted == len(delays)
        assert row.median_hours == (median(delays) if delays else None)
        assert why.users_naive == naive
        assert why.out_of_window == ordered - len(delays)
        assert why.out_of_order == naive - ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows: user 1 has a third of them, 5,000 users share the rest."""
    rows = spark.range(0, 20_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1L ELSE 100 + (id * 7919) % 5000 END AS user_id",
        "timestamp_ntz'2026-01-05 00:00:00' + make_dt_interval(0, 0, id % 4001, id % 59)"
        " AS event_ts",
        "element_at(array('a', 'b', 'c', 'd', 'x'), int(pmod(xxhash64(id), 5)) + 1) AS event_name",
    )
    return rows.cache()


def test_only_the_hot_user_is_heavy(skewed):
    rows = step_events(skewed, STEPS)
    heavy = heavy_keys(rows, rows_per_task=1000).collect()
    assert [r.user_id for r in heavy] == [1] and heavy[0].slices > 1
    assert heavy_keys(rows).count() == 0


@pytest.mark.parametrize("within", [None, 3600, 3 * 3600])
def test_a_hot_user_gives_the_same_result_on_either_plan(skewed, within):
    plain = step_times(skewed, STEPS, rows_per_task=1 << 60, within_seconds=within)
    expected = sorted(map(tuple, plain.collect()), key=str)
    for rows_per_task in (0, 4, 1000):  # every user, some users, the hot user
        split = step_times(skewed, STEPS, rows_per_task=rows_per_task, within_seconds=within)
        assert sorted(map(tuple, split.collect()), key=str) == expected


def test_a_wider_window_than_the_times_reach_is_refused(skewed):
    times = step_times(skewed, STEPS, within_seconds=3600)
    sw.funnel_from_times(times, STEPS, window_hours=1)
    with pytest.raises(ValueError, match="too short"):
        sw.funnel_from_times(times, STEPS, window_hours=2)
    with pytest.raises(ValueError, match="too short"):
        sw.compare(skewed, STEPS, window_hours=1, window_from="previous", times=times)
    with pytest.raises(ValueError, match="too short"):
        sw.overcount_reasons(skewed, STEPS, window_hours=1, times=times)


def test_windows_widen(skewed):
    times = step_times(skewed, STEPS).cache()
    naive = column(sw.naive_funnel(skewed, STEPS), "users")
    before = [0] * len(STEPS)
    for window_hours in (1, 10, 100, 1000):
        now = column(
            sw.funnel_from_times(times, STEPS, window_hours=window_hours), "users"
        )
        assert all(a <= b for a, b in zip(before, now, strict=True))
        assert all(a >= b for a, b in zip(now, now[1:], strict=False))
        assert all(a <= b for a, b in zip(now, naive, strict=True))
        before = now
