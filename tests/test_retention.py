from __future__ import annotations

from datetime import datetime

import pytest
from conftest import SHOP, at, column
from pyspark.sql import functions as F

import stepwell as sw

W0, W1 = datetime(2026, 1, 5), datetime(2026, 1, 12)
FEB16, MAR2 = datetime(2026, 2, 16), datetime(2026, 3, 2)


def test_long_form(retention_events):
    long = sw.retention(retention_events, max_periods=4)
    assert [tuple(r) for r in long.collect()] == [
        (FEB16, 4, 0, True, 1, 0.25),
        (FEB16, 4, 1, True, 2, 0.5),
        (FEB16, 4, 2, True, 2, 0.5),
        (FEB16, 4, 3, True, 0, 0.0),
        (FEB16, 4, 4, False, None, None),
        (MAR2, 2, 0, True, 1, 0.5),
        (MAR2, 2, 1, True, 1, 0.5),
        (MAR2, 2, 2, False, None, None),
        (MAR2, 2, 3, False, None, None),
        (MAR2, 2, 4, False, None, None),
    ]
    assert [f.dataType.simpleString() for f in long.schema] == [
        "timestamp_ntz",
        "bigint",
        "bigint",
        "boolean",
        "bigint",
        "double",
    ]


def test_blended_curve_weighs_by_size(retention_events):
    curve = sw.blended_curve(sw.retention(retention_events, max_periods=4))
    assert [tuple(r) for r in curve.collect()] == [
        (0, 2, 6, 2, 2 / 6),
        (1, 2, 6, 3, 0.5),
        (2, 1, 4, 2, 0.5),
        (3, 1, 4, 0, 0.0),
    ]


def test_matrix(retention_events):
    long = sw.retention(retention_events, max_periods=4)
    matrix = sw.as_matrix(long, max_periods=4)
    assert matrix.columns == ["cohort_period", "0", "1", "2", "3", "4"]
    assert [tuple(r) for r in matrix.collect()] == [
        (FEB16, 0.25, 0.5, 0.5, 0.0, None),
        (MAR2, 0.5, 0.5, None, None, None),
    ]
    counts = sw.as_matrix(long, "active_users", max_periods=4)
    assert [tuple(r)[1:] for r in counts.collect()] == [(1, 2, 2, 0, None), (1, 1, None, None, None)]


def test_month_grain(retention_events):
    rows = sw.retention(retention_events, period="month", max_periods=2).collect()
    assert [tuple(r)[1:] for r in rows if r.cohort_period == datetime(2026, 2, 1)] == [
        (4, 0, True, 2, 0.5),
        (4, 1, True, 2, 0.5),
        (4, 2, False, None, None),
    ]
    assert [tuple(r)[1:] for r in rows if r.cohort_period == datetime(2026, 3, 1)] == [
        (2, 0, True, 1, 0.5),
        (2, 1, False, None, None),
        (2, 2, False, None, None),
    ]
    assert len(rows) == 6


def test_months_count_across_years(table):
    events = table(
        ("u", datetime(2025, 11, 30, 23), "signup"),
        ("u", datetime(2026, 2, 1, 1), "lesson_start"),
    )
    rows = sw.retention(events, period="month", max_periods=4).collect()
    assert [r.active_users for r in rows] == [0, 0, 0, 1, None]


def test_sizes(retention_events):
    long = sw.retention(retention_events, max_periods=3)
    assert [tuple(r) for r in sw.cohort_sizes(long).collect()] == [
        ("2026-02-16", 4),
        ("2026-03-02", 2),
    ]


def test_filter_that_empties_the_table(retention_events):
    assert sw.retention(retention_events, filters={"platform": ["kiosk"]}).count() == 0


def test_empty_table(table):
    assert sw.retention(table()).count() == 0


def test_zero_periods(retention_events):
    assert column(sw.retention(retention_events, max_periods=0), "period_index") == [0, 0]


def test_arguments(retention_events):
    with pytest.raises(ValueError, match="period must be one of"):
        sw.retention(retention_events, period="fortnight")
    with pytest.raises(ValueError, match="max_periods"):
        sw.retention(retention_events, max_periods=-1)
    with pytest.raises(ValueError, match="Not a filterable column"):
        sw.retention(retention_events, filters={"shoe_size": ["44"]})


def test_activity_before_the_anchor(table):
    """In the anchor's own week it counts as period 0, in an earlier week not at all."""
    events = table(
        ("same", at("05 10:00"), "lesson_start"),
        ("same", at("06 10:00"), "signup"),
        ("earlier", at("06 10:00"), "lesson_start"),
        ("earlier", at("13 10:00"), "signup"),
    )
    rows = sw.retention(events, max_periods=1).collect()
    assert [(r.cohort_period, r.period_index, r.active_users) for r in rows] == [
        (W0, 0, 1),
        (W0, 1, 0),
        (W1, 0, 0),
        (W1, 1, None),
    ]


def test_first_anchor_wins_and_users_without_one_are_left_out(table):
    events = table(
        ("u", at("06 10:00"), "signup"),
        ("u", at("13 10:00"), "signup"),
        ("ghost", at("06 10:00"), "lesson_start"),
    )
    rows = sw.retention(events, max_periods=0).collect()
    assert [(r.cohort_period, r.cohort_size, r.active_users) for r in rows] == [(W0, 1, 0)]


def test_any_event_of_any_user_moves_the_horizon(table):
    """Period 2 is seen only through an unrelated event of a user without a cohort."""
    events = table(("u", at("06 10:00"), "signup"), ("ghost", at("20 10:00"), "banner"))
    assert column(sw.retention(events, max_periods=3), "observed") == [True, True, True, False]


def test_a_null_is_no_user_but_moves_the_horizon(spark):
    events = spark.createDataFrame(
        [("u", at("06 10:00"), "signup"), (None, at("06 10:00"), "signup"),
         (None, at("13 10:00"), "lesson_start")],
        "user_id string, event_ts timestamp_ntz, event_name string",
    )
    rows = sw.retention(events, max_periods=2).collect()
    assert [tuple(r)[1:5] for r in rows] == [(1, 0, True, 0), (1, 1, True, 0), (1, 2, False, None)]


def test_a_filter_moves_the_horizon(table):
    events = table(
        ("u", at("06 10:00"), "signup", "organic", "ios"),
        ("v", at("06 10:00"), "signup", "organic", "web"),
        ("v", at("20 10:00"), "lesson_start", "organic", "web"),
    )
    ios = sw.retention(events, max_periods=2, filters={"platform": ["ios"]})
    assert column(ios, "observed") == [True, False, False]
    by_platform = sw.retention(events, max_periods=2, by=["platform"])
    assert [tuple(r)[1:] for r in by_platform.filter("platform = 'ios'").collect()] == [
        tuple(r) for r in ios.collect()
    ]
    everywhere = sw.retention(events, max_periods=2, by=["platform"], horizon="global")
    assert column(everywhere, "observed") == [True] * 6


def test_a_user_with_two_channels_is_split_by_rows(table):
    events = table(
        ("u", at("06 10:00"), "signup", "paid"),
        ("u", at("13 10:00"), "signup", "organic"),
        ("u", at("14 10:00"), "lesson_start", "organic"),
    )
    rows = sw.retention(events, max_periods=1, by=["channel"]).collect()
    assert [(r.channel, r.cohort_period, r.period_index, r.active_users) for r in rows] == [
        ("organic", W1, 0, 1),
        ("organic", W1, 1, None),
        ("paid", W0, 0, 0),
        ("paid", W0, 1, None),
    ]


def test_consecutive_returns(table):
    events = table(
        ("u", at("06 10:00"), "signup"),
        ("u", at("06 11:00"), "lesson_start"),
        ("u", at("13 10:00"), "lesson_start"),
        ("u", at("27 10:00"), "lesson_start"),
        ("v", at("06 10:00"), "signup"),
        ("v", at("13 10:00"), "lesson_start"),
        ("w", at("01 10:00"), "lesson_start"),  # the week before its anchor: no part of a run
        ("w", at("06 10:00"), "signup"),
        ("w", at("06 10:00"), "lesson_start"),
    )
    unbounded = sw.retention(events, max_periods=3)
    assert column(unbounded, "active_users") == [2, 2, 0, 1]
    consecutive = sw.retention(events, max_periods=3, returns="consecutive")
    assert column(consecutive, "active_users") == [2, 1, 0, 0]


def test_anchor_and_activity_may_be_the_same_event(retention_events):
    rows = sw.retention(retention_events, activity_event="signup", max_periods=1)
    assert column(rows, "active_users") == [4, 0, 2, 0]


def test_wilson_interval(retention_events):
    rows = sw.with_confidence(sw.retention(retention_events, max_periods=4), z=2.0).collect()
    # 1 of 4, z = 2: centre 1 / 4 + 2 / 4, margin 2 * sqrt(3 / 64 + 4 / 64), all over 1 + 4 / 4
    margin = 2 * (7 / 64) ** 0.5
    assert rows[0].ci_low == pytest.approx((0.75 - margin) / 2)
    assert rows[0].ci_high == pytest.approx((0.75 + margin) / 2)
    assert rows[4].ci_low is None


@pytest.fixture(scope="module")
def two_channels(table):
    """Week 0: 2 of 4 organic and 0 of 2 paid return. Week 1: 1 of 2 organic, 1 of 8 paid."""
    rows = []
    plan = [("organic", 5, 4, 2), ("paid", 5, 2, 0), ("organic", 12, 2, 1), ("paid", 12, 8, 1)]
    for channel, day, size, returning in plan:
        for i in range(size):
            user = f"{channel}-{day}-{i}"
            rows.append((user, datetime(2026, 1, day, 9), "signup", channel))
            if i < returning:
                rows.append((user, datetime(2026, 1, day + 7, 9), "lesson_start", channel))
    return table(*rows).cache()


def test_segment_breakdowns(two_channels):
    long = sw.retention(two_channels, max_periods=1, by=["channel"], horizon="global").cache()
    summary = sw.segment_summary(long, "channel", periods=[1]).collect()
    assert [tuple(r) for r in summary] == [("organic", 6, 0.5), ("paid", 10, 0.1)]
    mix = sw.segment_mix(long, "channel").collect()
    assert [tuple(r)[1:] for r in mix] == [
        ("organic", 4, 4 / 6),
        ("paid", 2, 2 / 6),
        ("organic", 2, 0.2),
        ("paid", 8, 0.8),
    ]
    in_campaign = F.col("cohort_period") >= datetime(2026, 1, 12)
    shift = sw.mix_shift(long, "channel", in_campaign).collect()
    by_channel = {r.channel: r for r in shift}
    assert by_channel["organic"].mix_effect == pytest.approx((0.2 - 4 / 6) * 0.5)
    assert by_channel["organic"].rate_effect == pytest.approx(0.0)
    assert by_channel["paid"].rate_effect == pytest.approx(0.8 * 1 / 8)
    total = sum(r.mix_effect + r.rate_effect for r in shift)
    assert total == pytest.approx(2 / 10 - 2 / 6)

    whole = sw.retention(two_channels, max_periods=1)
    label = F.when(in_campaign, "campaign").otherwise("other")
    contrast = sw.cohort_contrast(whole, label).filter("period_index = 1").collect()
    assert [(r.cohort_group, r.retention) for r in contrast] == [
        ("campaign", 0.2),
        ("other", 2 / 6),
    ]


def test_mix_shift_with_a_segment_on_one_side_only(table):
    events = table(
        ("a", at("05 09:00"), "signup", "old"),
        ("a", at("13 09:00"), "lesson_start", "old"),
        ("b", at("12 09:00"), "signup", "new"),
        ("b", at("19 09:00"), "other", "new"),
    )
    long = sw.retention(events, max_periods=1, by=["channel"], horizon="global")
    rows = sw.mix_shift(long, "channel", F.col("cohort_period") >= W1).collect()
    assert [(r.channel, r.mix_effect, r.rate_effect) for r in rows] == [
        ("new", 0.0, 0.0),
        ("old", -1.0, 0.0),
    ]


def test_cube_levels_equal_filtered_calls(two_channels):
    options = {"max_periods": 1}
    cube = sw.retention_cube(two_channels, ["channel", "platform"], **options).collect()
    assert {r.level for r in cube} == {"all", "channel", "platform", "channel+platform"}
    alone = {}
    for row in cube:
        key = (row.channel, row.platform)
        if key not in alone:
            filters = {
                d: [v] for d, v in zip(("channel", "platform"), key, strict=True) if v is not None
            }
            rows = sw.retention(two_channels, filters=filters, **options).collect()
            alone[key] = {(r.cohort_period, r.period_index): tuple(r) for r in rows}
        assert tuple(row)[3:] == alone[key][(row.cohort_period, row.period_index)]


def test_kpi_row(funnel_events, retention_events, table):
    kpis = sw.kpi_row(
        sw.funnel(funnel_events, SHOP), sw.retention(retention_events, max_periods=3)
    )
    assert [tuple(r) for r in kpis.collect()] == [(6, 2, 2 / 6, 0.5)]
    nobody = sw.kpi_row(sw.funnel(table(), SHOP), sw.retention(table()))
    assert [tuple(r) for r in nobody.collect()] == [(0, 0, 0.0, None)]
