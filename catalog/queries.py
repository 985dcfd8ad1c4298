"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.operators.funnel import ACCURACY, step_facts, step_times
from stepwell.sources.adapters import (
    clickstream_events,
    fulfilment_events,
    order_events,
    read_table,
    user_channels,
)
from stepwell.sources.tables import scratch_path

CLICK_STEPS = ["signup", "view", "click", "purchase"]
ORDER_STEPS = ["O", "F", "P"]
SHIP_STEPS = ["order", "ship", "return"]
YEAR_HOURS = 24 * 365
EIGHT_STEPS = [f"{name}_{place}" for name in CLICK_STEPS for place in ("ios", "web")]

Query = Callable[[SparkSession, str], DataFrame]


def _clicks(channel: bool = False):
    return lambda spark, sf: clickstream_events(spark, sf, channel=channel)


def _orders(channel: bool = False):
    return lambda spark, sf: order_events(spark, sf, channel=channel)


def _fulfilment(channel: bool = False):
    return lambda spark, sf: fulfilment_events(spark, sf, channel=channel)


def _by_users(events, operator, *args, **options) -> Query:
    """The same with the customers' segments as attributes of the users."""
    return lambda spark, sf: operator(
        events(spark, sf), *args, users=user_channels(spark, sf), **options
    )


def _on(events, operator, *args, **options) -> Query:
    """The query that applies ``operator`` to an event table."""
    return lambda spark, sf: operator(events(spark, sf), *args, **options)


def _month_retention(events: DataFrame, **options) -> DataFrame:
    return sw.retention(
        events,
        period="month",
        signup_event="O",
        activity_event="F",
        max_periods=12,
        **options,
    )


def _week_retention(events: DataFrame, **options) -> DataFrame:
    return sw.retention(
        events, signup_event="signup", activity_event="purchase", max_periods=5, **options
    )


def _funnels() -> dict[str, Query]:
    some = {"platform": ["ios", "web"], "channel": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}
    return {
        "funnel_entry_72h": _on(_clicks(), sw.funnel, CLICK_STEPS, window_hours=72),
        "funnel_previous_72h": _on(
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=72, window_from="previous"
        ),
        "funnel_entry_6h": _on(_clicks(), sw.funnel, CLICK_STEPS, window_hours=6),
        "funnel_fractional_window": _on(
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=30.7501, window_from="previous"
        ),
        "funnel_heavy_users": _on(
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=72, rows_per_task=0
        ),
        "funnel_some_heavy_users": _on(  # about half the users have more rows than this
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=72, rows_per_task=53
        ),
        "funnel_heavy_eight_steps": _on(
            _named_clicks, sw.funnel, EIGHT_STEPS, window_hours=240, rows_per_task=0
        ),
        "funnel_quantiles": _on(_clicks(), _quantiles_within, [], 72),
        "funnel_quantiles_rolled_up": _on(_clicks(), _quantiles_within, ["platform"], 240),
        "funnel_filtered": _by_users(
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=72, filters=some
        ),
        "funnel_step_filtered_out": _on(
            _clicks(),
            sw.funnel,
            CLICK_STEPS,
            window_hours=168,
            filters={"event_name": ["signup", "view", "purchase"], "platform": []},
        ),
        "funnel_by_channel": _by_users(
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=72, by=["channel"]
        ),
        "funnel_by_platform": _on(
            _clicks(), sw.funnel, CLICK_STEPS, window_hours=168, by=["platform"]
        ),
        "funnel_by_user_channel": _by_user_channel,
        "funnel_report": _on(_clicks(), _funnel_report),
        "funnel_cube": _on(
            _clicks(channel=True),
            sw.funnel_cube,
            CLICK_STEPS,
            ["channel", "platform"],
            window_hours=168,
        ),
        "naive_funnel": _on(_clicks(), sw.naive_funnel, CLICK_STEPS),
        "naive_funnel_by_channel": _by_users(
            _clicks(), sw.naive_funnel, CLICK_STEPS, by=["channel"], filters={"platform": ["ios"]}
        ),
        "orders_compare_by_channel": _by_users(
            _orders(), sw.compare, ORDER_STEPS, window_hours=YEAR_HOURS, by=["channel", "platform"]
        ),
        "naive_funnel_cube": _naive_cube,
        "naive_funnel_by_priority": _on(
            _orders(), sw.naive_funnel, ["P", "O", "F"], by=["platform"]
        ),
        "funnel_compare_72h": _on(_clicks(), sw.compare, CLICK_STEPS, window_hours=72),
        "orders_compare": _on(
            _orders(), sw.compare, ORDER_STEPS, window_hours=YEAR_HOURS, window_from="previous"
        ),
        "overcount_reasons": _on(_clicks(), sw.overcount_reasons, CLICK_STEPS, window_hours=72),
        "orders_overcount_reasons": _on(
            _orders(), sw.overcount_reasons, ORDER_STEPS, window_hours=YEAR_HOURS
        ),
        "orders_funnel_ties": _on(_orders(), sw.funnel, ORDER_STEPS, window_hours=YEAR_HOURS),
        "orders_funnel_previous": _on(
            _orders(), sw.funnel, ORDER_STEPS, window_hours=YEAR_HOURS, window_from="previous"
        ),
        "ship_funnel": _on(_fulfilment(), sw.funnel, SHIP_STEPS, window_hours=24 * 60),
        "ship_funnel_by_channel": _by_users(
            _fulfilment(),
            sw.funnel,
            SHIP_STEPS,
            window_hours=24 * 60,
            window_from="previous",
            by=["channel"],
        ),
        "step_times": _on(_clicks(), _times_only, CLICK_STEPS),
        "window_sweep": _on(_clicks(), _window_sweep, CLICK_STEPS, [12, 24, 48, 96, 192]),
    }


def _named_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Events named by what happened and where, which makes 15 names."""
    events = clickstream_events(spark, sf)
    return events.withColumn("event_name", F.concat_ws("_", "event_name", "platform"))


def _quantiles_within(events: DataFrame, by: list[str], hours: int) -> DataFrame:
    """Quantiles from sketches (made per ``by``, then merged) and whether each lies within the
    sketches' rank error of the exact durations."""
    times = step_times(events, CLICK_STEPS, by=by)
    sketches = sw.duration_sketches(times, CLICK_STEPS, window_hours=hours, by=by)
    merged = sw.merge_durations(sketches)
    found = sw.duration_quantiles(merged, CLICK_STEPS, [0.1, 0.5, 0.9])
    exact = step_facts(times, len(CLICK_STEPS), hours, "entry").filter("in_time")
    seconds = F.round(F.col("hours") * 3600).cast("long")
    ranked = found.join(exact, F.col("step") == F.col("step_index")).groupBy(
        "step_index", "step_name", "users", "probability"
    ).agg(
        F.avg((F.col("seconds") < seconds).cast("double")).alias("below"),
        F.avg((F.col("seconds") <= seconds).cast("double")).alias("upto"),
    )
    error = 4 / ACCURACY
    within = (F.col("below") - error <= F.col("probability")) & (
        F.col("probability") <= F.col("upto") + error
    )
    return ranked.select("step_index", "step_name", "users", "probability", within.alias("within"))


def _stored_sets(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "user-sets")
    events = clickstream_events(spark, sf, channel=True)
    sw.user_sets(events, ["channel", "platform"], "week").write.parquet(path)
    return spark.read.parquet(path)


def _naive_cube(spark: SparkSession, sf: str) -> DataFrame:
    return sw.naive_funnel_cube(_stored_sets(spark, sf), CLICK_STEPS, ["channel", "platform"])


def _by_user_channel(spark: SparkSession, sf: str) -> DataFrame:
    """The channel belongs to the user, so it joins one row per user and not every event."""
    times = step_times(clickstream_events(spark, sf), CLICK_STEPS)
    return sw.funnel_from_times(
        times.join(user_channels(spark, sf), "user_id", "left"),
        CLICK_STEPS,
        window_hours=72,
        by=["channel"],
    )


def _funnel_report(events: DataFrame) -> DataFrame:
    return sw.for_display(
        sw.funnel(events, CLICK_STEPS, window_hours=72),
        digits={"step_conversion": 4, "median_hours": 2},
        percent={"overall_conversion": 1},
    )


def _times_only(events: DataFrame, steps: list[str]) -> DataFrame:
    times = step_times(events, steps)
    return times.select("user_id", *[f"t{i}" for i in range(len(steps))])


def _window_sweep(events: DataFrame, steps: list[str], hours: list[int]) -> DataFrame:
    """The same funnel under several windows, from one per-user table."""
    times = step_times(events, steps)
    each = F.explode(F.array(*[F.lit(h) for h in hours])).alias("window_hours")
    reached = times.select("*", each)
    limit = F.make_dt_interval(hours=F.col("window_hours"))
    flags = [F.col("t0").isNotNull()]
    for i in range(1, len(steps)):
        flags.append(flags[-1] & (F.col(f"t{i}") <= F.col("t0") + limit))
    return (
        reached.groupBy("window_hours")
        .agg(*[F.count_if(flag).alias(f"users_{i}") for i, flag in enumerate(flags)])
        .orderBy("window_hours")
    )


def _matrix_report(matrix: DataFrame) -> DataFrame:
    periods = [c for c in matrix.columns if c != "cohort_period"]
    return sw.for_display(matrix, digits=dict.fromkeys(periods, 3), dates=["cohort_period"])


def _retention() -> dict[str, Query]:
    month, week = _on(_orders(), _month_retention), _on(_clicks(), _week_retention)
    by_channel = _by_users(_orders(), _month_retention, by=["channel"])
    # columns need a running session, so they are made when the query is
    def in_1996():
        return F.year("cohort_period") == 1996

    def of(query: Query, operator, *args, **options) -> Query:
        return lambda spark, sf: operator(query(spark, sf), *args, **options)

    def kpis(spark: SparkSession, sf: str) -> DataFrame:
        events = clickstream_events(spark, sf)
        return sw.kpi_row(
            sw.funnel(events, CLICK_STEPS, window_hours=72), _week_retention(events)
        )

    def contrast(spark: SparkSession, sf: str) -> DataFrame:
        label = F.when(in_1996(), F.lit("campaign")).otherwise(F.lit("other"))
        return sw.cohort_contrast(month(spark, sf), label)

    def shift(spark: SparkSession, sf: str) -> DataFrame:
        return sw.mix_shift(by_channel(spark, sf), "channel", in_1996(), period_index=1)

    def stored_cube(spark: SparkSession, sf: str) -> DataFrame:
        """The cube from stored sets of users instead of events."""
        sets = _stored_sets(spark, sf)
        return sw.cohort_cube(sets, ["channel", "platform"], activity_event="purchase", max_periods=4)

    return {
        "retention_week": week,
        "retention_month": month,
        "retention_matrix": of(month, sw.as_matrix, max_periods=12),
        "retention_report": of(of(month, sw.as_matrix, max_periods=12), _matrix_report),
        "active_users_matrix": of(week, sw.as_matrix, "active_users", max_periods=5),
        "blended_curve": of(month, sw.blended_curve),
        "retention_filtered": _on(
            _orders(), _month_retention, filters={"platform": ["1-URGENT"]}
        ),
        "retention_by_channel": by_channel,
        "retention_filtered_by_user": _by_users(
            _clicks(), _week_retention, filters={"channel": ["BUILDING", "MACHINERY"]}
        ),
        "retention_global_horizon": _by_users(
            _clicks(),
            sw.retention,
            signup_event="signup",
            activity_event="click",
            max_periods=3,
            by=["channel", "platform"],
            horizon="global",
        ),
        "blended_by_channel": of(by_channel, sw.blended_curve, by=["channel"]),
        "segment_summary": of(by_channel, sw.segment_summary, "channel"),
        "channel_mix": of(by_channel, sw.segment_mix, "channel"),
        "cohort_contrast": contrast,
        "mix_shift": shift,
        "cohort_sizes": of(month, sw.cohort_sizes),
        "kpi_row": kpis,
        "retention_consecutive": _on(
            _clicks(), _week_retention, returns="consecutive"
        ),
        "retention_consecutive_month": _on(
            _orders(), _month_retention, returns="consecutive"
        ),
        "retention_ci": of(month, sw.with_confidence),
        "cohort_cube": _on(
            _clicks(channel=True),
            sw.retention_cube,
            ["channel", "platform"],
            signup_event="signup",
            activity_event="purchase",
            max_periods=4,
        ),
        "cohort_cube_stored": stored_cube,
        "fulfilment_retention": _on(
            _fulfilment(),
            sw.retention,
            period="month",
            signup_event="order",
            activity_event="return",
            max_periods=24,
        ),
    }


def _tables() -> dict[str, Query]:
    def incremental(spark: SparkSession, sf: str) -> DataFrame:
        """Three batches, the second of them delivered twice."""
        path = scratch_path(spark, "first-events")
        events = clickstream_events(spark, sf)
        ts = F.col("event_ts")
        first, second = datetime(2024, 1, 10), datetime(2024, 1, 20)
        batches = [ts < first, (ts >= first) & (ts < second), ts >= second]
        for batch_id in (2, 1, 0, 1):
            sw.add_first_events(events.filter(batches[batch_id]), path, batch_id, "load")
        return sw.read_first_events(spark, path)

    def compacted(spark: SparkSession, sf: str) -> DataFrame:
        path, target = scratch_path(spark, "first"), scratch_path(spark, "compact")
        events = order_events(spark, sf)
        ts = F.col("event_ts")
        early, middle = ts < datetime(1995, 1, 1), ts < datetime(1997, 1, 1)
        sw.add_first_events(events.filter(early), path, 0, "load")
        sw.compact_first_events(spark, path, target)
        # another job goes on with the compacted table, counting from 0 again
        sw.add_first_events(events.filter(~early & middle), target, 0, "daily")
        sw.add_first_events(events.filter(~middle), target, 1, "daily")
        return sw.read_first_events(spark, target)

    def rewritten(spark: SparkSession, sf: str) -> DataFrame:
        """Compacted in place between batches, old versions forgotten, the last batch repeated."""
        path = scratch_path(spark, "first")
        events = order_events(spark, sf)
        early = F.col("event_ts") < datetime(1995, 1, 1)
        sw.add_first_events(events.filter(~early), path, 0, "load")
        sw.compact_first_events(spark, path)
        sw.add_first_events(events.filter(early), path, 1, "load")
        sw.add_first_events(events.filter(early), path, 1, "load")
        sw.compact_first_events(spark, path)
        sw.forget_first_events(spark, path, keep=1)
        return sw.read_first_events(spark, path)

    def streamed(spark: SparkSession, sf: str) -> DataFrame:
        path, checkpoint = scratch_path(spark, "first"), scratch_path(spark, "stream")
        schema = read_table(spark, sf, "events").schema
        # a glob, since a streaming source wants a folder or a pattern
        source = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
        events = clickstream_events(spark, sf, source=source)
        sw.stream_first_events(events, path, checkpoint).awaitTermination()
        return sw.read_first_events(spark, path)

    def naive_from_first(spark: SparkSession, sf: str) -> DataFrame:
        return sw.naive_funnel(sw.first_events(order_events(spark, sf)), ORDER_STEPS)

    def built(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "events")
        rows = sw.build_event_table(clickstream_events(spark, sf), path)
        table = sw.open_event_table(spark, path)
        return table.groupBy("platform").agg(
            F.count(F.lit(1)).alias("events"),
            F.min("event_ts").alias("first_ts"),
            F.max("event_ts").alias("last_ts"),
            F.lit(rows).cast("long").alias("table_rows"),
        )

    def late(spark: SparkSession, sf: str) -> DataFrame:
        """Every tenth event comes late, and that batch twice."""
        path = scratch_path(spark, "events")
        events = clickstream_events(spark, sf)
        is_late = F.pmod(F.crc32(F.col("user_id").cast("string")), F.lit(10)) == 0
        sw.build_event_table(events.filter(~is_late), path)
        for _ in range(2):
            sw.add_events(events.filter(is_late), path, "late")
        rows = F.count(F.lit(1)).alias("events")
        table = sw.open_event_table(spark, path)
        day = F.date_format("event_ts", "yyyy-MM-dd")
        return table.groupBy(day.alias("event_date")).agg(rows)

    def load_checks(spark: SparkSession, sf: str) -> DataFrame:
        """The row checks of ``event_quality``, counted while the table is written."""
        path = scratch_path(spark, "events")
        events = clickstream_events(spark, sf)
        load = sw.load_event_table(events, path, vocabulary=vocabulary, horizon=horizon)
        rows = [(check, load.rows, n) for check, n in load.violations.items()]
        return spark.createDataFrame(rows, "check string, checked long, violations long")

    def bucketed(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "bucketed")
        name = "events_" + path.rsplit("/", 1)[-1].replace("-", "_")
        sw.build_bucketed_table(clickstream_events(spark, sf), name, path, 8)
        return sw.funnel(sw.open_bucketed_table(spark, name), CLICK_STEPS, window_hours=72)

    def reporting_window(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "events")
        sw.build_event_table(clickstream_events(spark, sf), path)
        events = sw.open_event_table(
            spark, path, start=date(2024, 1, 8), end=date(2024, 1, 15)
        )
        return sw.funnel(events, CLICK_STEPS, window_hours=48)

    vocabulary = ["signup", "view", "click", "purchase"]
    horizon = datetime(2024, 1, 29)
    return {
        "distinct_channels": lambda spark, sf: sw.distinct_attribute(
            clickstream_events(spark, sf), "channel", user_channels(spark, sf)
        ),
        "distinct_platforms": _on(_clicks(), sw.distinct_values, "platform"),
        "distinct_event_names": _on(_fulfilment(), sw.distinct_values, "event_name"),
        "event_quality": _on(_clicks(), sw.event_quality, vocabulary, horizon, "signup"),
        "event_histogram": _on(_clicks(), sw.event_histogram),
        "never_did": _on(_orders(), sw.did_without, did="O", never="P"),
        "late_activators": _on(
            _clicks(), sw.late_activators, anchor="signup", activity="purchase", hours=36
        ),
        "first_events": _on(_clicks(), sw.first_events),
        "first_events_incremental": incremental,
        "first_events_compacted": compacted,
        "first_events_rewritten": rewritten,
        "first_events_stream": streamed,
        "naive_from_first_events": naive_from_first,
        "event_table": built,
        "event_table_late_load": late,
        "event_table_load_checks": load_checks,
        "funnel_bucketed": bucketed,
        "reporting_window_funnel": reporting_window,
    }


def all_queries() -> dict[str, Query]:
    return {**_funnels(), **_retention(), **_tables()}
