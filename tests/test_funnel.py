from __future__ import annotations

import math
from datetime import timedelta

import pytest
from conftest import MONDAY, SHOP, column, hours

import stepwell as sw

ABC = ["a", "b", "c"]
TWO_DAYS, LONG = 48, 300
#: Both ways of finding the chain: every user in windows, every user in rounds.
PATHS = [pytest.param(1 << 60, id="windows"), pytest.param(0, id="rounds")]


def users(events, steps, **options):
    return column(sw.funnel(events, steps, **options), "users")


@pytest.mark.parametrize("small", PATHS)
@pytest.mark.parametrize(
    ("window_hours", "window_from", "expected"),
    [
        (LONG, "entry", [6, 4, 3]),
        (TWO_DAYS, "entry", [6, 3, 1]),
        (50, "entry", [6, 4, 1]),
        (50, "previous", [6, 4, 2]),
    ],
)
def test_windows_and_anchors(funnel_events, small, window_hours, window_from, expected):
    got = users(
        funnel_events,
        SHOP,
        window_hours=window_hours,
        window_from=window_from,
        rows_per_task=small,
    )
    assert got == expected


def test_rates_and_medians(funnel_events):
    """Baskets come 3, 5, 6 and 50 hours after entry, orders 7, 51 and 180."""
    rows = sw.funnel(funnel_events, SHOP, window_hours=LONG).collect()
    assert [r.step_index for r in rows] == [0, 1, 2]
    assert [r.step_name for r in rows] == SHOP
    assert [r.step_conversion for r in rows] == [1.0, 4 / 6, 3 / 4]
    assert [r.overall_conversion for r in rows] == [1.0, 4 / 6, 3 / 6]
    assert [r.dropped for r in rows] == [0, 2, 1]
    assert [r.median_hours for r in rows] == [0.0, 5.5, 51.0]


def test_naive_counts_ignore_order_and_time(funnel_events):
    rows = sw.naive_funnel(funnel_events, SHOP).collect()
    assert [r.users for r in rows] == [6, 5, 5]
    assert [r.step_conversion for r in rows] == [1.0, 5 / 6, 1.0]
    assert [r.overall_conversion for r in rows] == [1.0, 5 / 6, 5 / 6]
    assert [r.dropped for r in rows] == [0, 1, 0]
    assert [r.median_hours for r in rows] == [None, None, None]


def test_compare(funnel_events):
    rows = sw.compare(funnel_events, SHOP, window_hours=TWO_DAYS).collect()
    assert [r.users_ordered for r in rows] == [6, 3, 1]
    assert [r.users_naive for r in rows] == [6, 5, 5]
    assert [r.overcount for r in rows] == [0, 2, 4]
    assert [r.overall_conversion_ordered for r in rows] == [1.0, 3 / 6, 1 / 6]
    assert [r.overall_conversion_naive for r in rows] == [1.0, 5 / 6, 5 / 6]


def test_overcount_reasons(funnel_events):
    """Too late: ``bo`` twice, ``cy``'s order. Out of order: ``gus`` twice, ``eli``'s order."""
    rows = sw.overcount_reasons(funnel_events, SHOP, window_hours=TWO_DAYS).collect()
    assert [r.counted for r in rows] == [6, 3, 1]
    assert [r.out_of_window for r in rows] == [0, 1, 2]
    assert [r.out_of_order for r in rows] == [0, 1, 2]


def test_step_zero_ignored_by_users_who_never_entered(table):
    events = table(("x", hours(0), "b"), ("x", hours(1), "c"), ("y", hours(0), "a"))
    rows = sw.overcount_reasons(events, ABC, window_hours=24).collect()
    assert [r.counted for r in rows] == [1, 0, 0]
    assert [r.out_of_order for r in rows] == [0, 1, 1]


#: case -> (events as (name, hour), window_from, users per step) under a window of 24 hours
EDGES = {
    "tie": ([("a", 0), ("b", 0)], "entry", [1, 0, 0]),
    "at the edge": ([("a", 0), ("b", 24)], "entry", [1, 1, 0]),
    "past the edge": ([("a", 0), ("b", 24 + 1 / 3600)], "entry", [1, 0, 0]),
    "first anchor counts": ([("a", 0), ("a", 48), ("b", 49)], "entry", [1, 0, 0]),
    "order, then again": ([("c", 5), ("a", 6), ("b", 10), ("c", 12)], "entry", [1, 1, 1]),
    "step skipped": ([("a", 0), ("c", 1), ("b", 2)], "entry", [1, 1, 0]),
    "late third step": ([("a", 0), ("b", 20), ("c", 30)], "entry", [1, 1, 0]),
    "each step in time": ([("a", 0), ("b", 20), ("c", 30)], "previous", [1, 1, 1]),
    "greedy": ([("a", 0), ("b", 12), ("b", 22), ("c", 43)], "previous", [1, 1, 0]),
    "broken by a gap": ([("a", 0), ("b", 30), ("c", 31)], "previous", [1, 0, 0]),
}


@pytest.fixture(scope="module")
def edge_events(table):
    """Every case is a channel of its own, so one segmented funnel runs them all."""
    return table(
        *[
            ("u", hours(hour), name, case)
            for case, (events, _, _) in EDGES.items()
            for name, hour in events
        ]
    ).cache()


@pytest.mark.parametrize("small", PATHS)
@pytest.mark.parametrize("window_from", ["entry", "previous"])
def test_edges(edge_events, small, window_from):
    rows = sw.funnel(
        edge_events,
        ABC,
        window_hours=24,
        window_from=window_from,
        by=["channel"],
        rows_per_task=small,
    ).collect()
    got = {r.channel: [] for r in rows}
    for row in rows:
        got[row.channel].append(row.users)
    expected = {case: users for case, (_, anchor, users) in EDGES.items() if anchor == window_from}
    assert {case: got[case] for case in expected} == expected


def test_seconds_are_cut_before_they_are_subtracted(table):
    events = table(
        ("u", MONDAY + timedelta(seconds=0.9), "a"), ("u", MONDAY + timedelta(seconds=1.1), "b")
    )
    rows = sw.funnel(events, ["a", "b"], window_hours=1).collect()
    assert rows[1].median_hours == 1 / 3600


def test_window_shorter_than_a_second_is_zero(table):
    events = table(("u", MONDAY, "a"), ("u", MONDAY + timedelta(microseconds=1), "b"))
    assert users(events, ["a", "b"], window_hours=0.5 / 3600) == [1, 0]


def test_median_is_measured_from_entry_with_window_from_previous(table):
    events = table(("u", hours(0), "a"), ("u", hours(10), "b"), ("u", hours(20), "c"))
    rows = sw.funnel(events, ABC, window_hours=12, window_from="previous").collect()
    assert [r.median_hours for r in rows] == [0.0, 10.0, 20.0]


def test_medians(table):
    cases = {"1": 1, "1 4": 2.5, "5 1 2": 2, "1 1 1 9": 1, "3 9 9 3": 6}
    rows = []
    for case in cases:
        for i, delay in enumerate(case.split()):
            user = f"{case}-{i}"
            rows += [(user, hours(i), "a", case), (user, hours(i + int(delay)), "b", case)]
    got = sw.funnel(table(*rows), ["a", "b"], window_hours=99, by=["channel"]).collect()
    assert {r.channel: r.median_hours for r in got if r.step_index == 1} == cases


def test_nobody_entered(funnel_events):
    rows = sw.funnel(funnel_events, SHOP, filters={"channel": ["radio"]}).collect()
    assert [r.users for r in rows] == [0, 0, 0]
    assert [r.step_conversion for r in rows] == [1.0, 1.0, 1.0]
    assert [r.overall_conversion for r in rows] == [0.0, 0.0, 0.0]
    assert [r.median_hours for r in rows] == [0.0, None, None]
    assert [r.dropped for r in rows] == [0, 0, 0]


def test_empty_table(table):
    assert users(table(), SHOP) == [0, 0, 0]
    assert users(table(), SHOP, rows_per_task=0) == [0, 0, 0]
    assert column(sw.naive_funnel(table(), SHOP), "users") == [0, 0, 0]


def test_naive_step_after_an_empty_one_is_infinite(table):
    rows = sw.naive_funnel(table(("u", hours(0), "c")), ABC).collect()
    assert [r.step_conversion for r in rows] == [1.0, 1.0, math.inf]
    assert [r.overall_conversion for r in rows] == [0.0, 0.0, 0.0]
    assert [r.dropped for r in rows] == [0, 0, -1]


def test_filters(funnel_events):
    by_mail = {"channel": ["email"]}
    assert users(funnel_events, SHOP, window_hours=LONG, filters=by_mail) == [3, 2, 2]
    empty_list = {"channel": [], "platform": ["web", "kiosk"]}
    assert users(funnel_events, SHOP, window_hours=LONG, filters=empty_list) == [6, 4, 3]
    without_basket = {"event_name": ["visit", "order"]}
    assert users(funnel_events, SHOP, window_hours=LONG, filters=without_basket) == [6, 0, 0]
    for column_name in ("shoe_size", "channel) --", "user_id"):
        with pytest.raises(ValueError, match="Not a filterable column"):
            sw.funnel(funnel_events, SHOP, filters={column_name: ["44"]})


def test_hostile_value_is_only_a_value(funnel_events):
    for value in ("email') --", "%", "em\\ail", "`channel`", ""):
        assert users(funnel_events, SHOP, filters={"channel": [value]}) == [0, 0, 0]


def test_hostile_step_name_is_only_a_value(table):
    odd = "b' OR 1=1 --"
    events = table(("u", hours(0), "a"), ("u", hours(1), odd), ("v", hours(0), "a"))
    assert users(events, ["a", odd], window_hours=2) == [2, 1]


@pytest.mark.parametrize(
    ("steps", "options", "message"),
    [
        (["visit"], {}, "at least two"),
        ([], {}, "at least two"),
        (["visit", "order", "visit"], {}, "distinct"),
        (["visit", ""], {}, "non-empty"),
        (["visit", 1], {}, "non-empty strings"),
        (["visit", "order"], {"window_hours": 0}, "positive"),
        (["visit", "order"], {"window_hours": -0.5}, "positive"),
        (["visit", "order"], {"window_from": "latest"}, "window_from"),
        (["visit"], {"window_hours": 0, "window_from": "latest"}, "at least two"),
        (["visit", "order"], {"window_hours": 0, "window_from": "latest"}, "positive"),
    ],
)
def test_validation(funnel_events, steps, options, message):
    with pytest.raises(ValueError, match=message):
        sw.funnel(funnel_events, steps, **options)
    if not options:
        with pytest.raises(ValueError, match=message):
            sw.naive_funnel(funnel_events, steps)


@pytest.fixture(scope="module")
def segmented(table):
    return table(
        ("u1", hours(0), "a", "paid", "ios"),
        ("u1", hours(1), "b", "paid", "ios"),
        ("u2", hours(0), "a", "paid", "web"),
        ("u2", hours(5), "b", "organic", "web"),
        ("u3", hours(0), "b", "organic", "ios"),
        ("u4", hours(0), "other", "social", "ios"),
    ).cache()


@pytest.mark.parametrize("small", PATHS)
def test_each_segment_equals_its_filtered_call(segmented, small):
    whole = sw.funnel(
        segmented, ["a", "b"], window_hours=24, by=["channel"], rows_per_task=small
    ).collect()
    channels = column(sw.distinct_values(segmented, "channel"), "channel")
    assert channels == ["organic", "paid", "social"]
    for channel in channels:
        alone = sw.funnel(
            segmented, ["a", "b"], window_hours=24, filters={"channel": [channel]}
        ).collect()
        assert [tuple(r)[1:] for r in whole if r.channel == channel] == [tuple(r) for r in alone]


def test_segmented_naive_and_compare(segmented):
    naive = sw.naive_funnel(segmented, ["a", "b"], by=["channel"]).collect()
    assert [(r.channel, r.step_index, r.users) for r in naive] == [
        ("organic", 0, 0),
        ("organic", 1, 2),
        ("paid", 0, 2),
        ("paid", 1, 1),
        ("social", 0, 0),
        ("social", 1, 0),
    ]
    both = sw.compare(segmented, ["a", "b"], window_hours=24, by=["channel"]).collect()
    assert [r.overcount for r in both] == [0, 2, 0, 0, 0, 0]


def test_cube_levels_equal_filtered_calls(segmented):
    cube = sw.funnel_cube(segmented, ["a", "b"], ["channel", "platform"], window_hours=24)
    rows = cube.collect()
    levels = {r.level for r in rows}
    assert levels == {"all", "channel", "platform", "channel+platform"}
    alone = {}
    for row in rows:
        key = (row.channel, row.platform)
        if key not in alone:
            filters = {
                d: [v] for d, v in zip(("channel", "platform"), key, strict=True) if v is not None
            }
            steps = sw.funnel(segmented, ["a", "b"], window_hours=24, filters=filters)
            alone[key] = steps.collect()
        assert tuple(row)[3:] == tuple(alone[key][row.step_index])


def test_one_table_of_times_serves_many_windows(funnel_events):
    times = sw.step_times(funnel_events, SHOP).cache()
    long = sw.funnel_from_times(times, SHOP, window_hours=LONG)
    short = sw.funnel_from_times(times, SHOP, window_hours=TWO_DAYS)
    assert column(long, "users") == [6, 4, 3]
    assert column(short, "users") == [6, 3, 1]
    both = sw.compare(funnel_events, SHOP, window_hours=TWO_DAYS, times=times)
    assert column(both, "overcount") == [0, 2, 4]


def test_an_attribute_of_the_user_joins_the_times(spark, segmented):
    plans = spark.createDataFrame(
        [("u1", "pro"), ("u2", "free"), ("u3", "free")], "user_id string, plan string"
    )
    times = sw.step_times(segmented, ["a", "b"]).join(plans, "user_id", "left")
    rows = sw.funnel_from_times(times, ["a", "b"], window_hours=24, by=["plan"]).collect()
    assert [(r.plan, r.users) for r in rows] == [("free", 1), ("free", 1), ("pro", 1), ("pro", 1)]
    listed = spark.createDataFrame([("free",), ("pro",), ("trial",)], "plan string")
    rows = sw.funnel_from_times(
        times, ["a", "b"], window_hours=24, by=["plan"], segments=listed
    ).collect()
    assert [(r.plan, r.users) for r in rows][4:] == [("trial", 0), ("trial", 0)]


def test_more_steps_than_bits_in_a_mask(table):
    steps = [f"s{i}" for i in range(130)]
    rows = [("u", hours(i), step) for i, step in enumerate(steps[:100])]
    counts = column(sw.naive_funnel(table(*rows, ("v", hours(0), "s129")), steps), "users")
    assert counts == [1] * 100 + [0] * 29 + [1]
