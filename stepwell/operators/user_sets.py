"""Distinct users over any level of the dimensions, from stored sets of users.

Distinct users do not add up over dimensions that vary from row to row, but sets of users can be
united. Users get dense numbers once; the base table then holds, per combination of dimensions,
event name and period, the set of its users as bitmaps of 32,768 numbers each. Every level, naive
funnel and cohort cube is OR and counting over that table: events are read once, when it is
built, and never repeated per level.

Cohorts need differences of sets: with U(p) the users who fired the anchor in period p or before
it, cohort p is U(p) without U(p - 1), and what it shares with the active users B(q) is
|U(p)| - |U(p - 1)| - |U(p) or B(q)| + |U(p - 1) or B(q)|.

Users with neighbouring numbers come from the same partition of users, so a task that joins its
users' events with their numbers builds few bitmaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import period_start, periods_between
from ..plans.scratch import materialize
from .cubes import with_levels
from .funnel import each_step, funnel_columns, with_all_segments
from .retention import retention_of_cells
from .validation import check_retention, check_steps


def number_users(events: DataFrame) -> DataFrame:
    """``user_id, number``: every user with a dense number from 1. Written, since it fixes what a
    bit means; keep it beside the sets that use it."""
    users = events.filter(F.col("user_id").isNotNull()).select("user_id").distinct()
    placed = materialize(
        users.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    sizes = placed.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_users"))
    # one row per partition
    before = F.sum("_users").over(Window.orderBy("_part")) - F.col("_users")
    starts = sizes.select(F.col("_part").alias("_of"), "_first", before.alias("_before"))
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return materialize(
        placed.join(F.broadcast(starts), F.col("_part") == F.col("_of")).select("user_id", number.alias("number"))
    )


def user_sets(
    events: DataFrame, dimensions: Sequence[str], period: str, numbers: DataFrame | None = None
) -> DataFrame:
    """The base table: ``dimensions``..., event_name, period (its first day), bucket, users.

    ``users`` is the bitmap of the users of ``bucket``. Events of no user keep their period, for the
    horizon, with a NULL bucket. ``numbers`` takes a table of ``number_users`` that covers all users
    of ``events``.
    """
    check_retention(period, 0)
    numbers = number_users(events) if numbers is None else numbers
    keys = [*dimensions, "event_name", "period"]
    seen = events.select(
        "user_id", *dimensions, "event_name", period_start(F.col("event_ts"), period).alias("period")
    ).distinct()
    numbered = seen.join(numbers, "user_id", "left")
    bucket = F.bitmap_bucket_number("number")
    return numbered.groupBy(*keys, bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    )


def at_levels(sets: DataFrame, dimensions: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The sets of every level of ``dimensions``, united over all columns but ``keys``."""
    by = ["level", *dimensions, *keys, "bucket"]
    return with_levels(sets, dimensions).groupBy(*by).agg(F.bitmap_or_agg("users").alias("users"))


def naive_funnel_cube(sets: DataFrame, steps: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """``naive_funnel`` by ``level`` and dimensions, from ``user_sets`` of these dimensions."""
    check_steps(steps)
    by = ["level", *dimensions]
    of_steps = sets.filter(F.col("event_name").isin(list(steps)))
    step = (F.array_position(F.lit(list(steps)), F.col("event_name")) - 1).cast("int")
    counted = (
        at_levels(of_steps, dimensions, ["event_name"])
        .groupBy(*by, step.alias("step"))
        .agg(F.sum(F.bitmap_count("users")).alias("naive"))
    )
    entry = "struct(step, struct(0L AS users, naive, 0L AS ordered, CAST(NULL AS DOUBLE) AS median))"
    counts = counted.groupBy(*by).agg(F.expr(f"map_from_entries(collect_list({entry})) AS by_step"))
    segments = with_levels(sets.select(*dimensions).distinct(), dimensions)
    return (
        each_step(with_all_segments(counts, segments, by), steps, by)
        .select(*funnel_columns(by, "naive", "CAST(NULL AS DOUBLE)"))
        .orderBy(*by, "step_index")
    )


def cohort_cube(
    sets: DataFrame,
    dimensions: Sequence[str],
    *,
    period: str = "week",
    signup_event: str = "signup",
    activity_event: str = "lesson_start",
    max_periods: int = 8,
    horizon: str = "segment",
) -> DataFrame:
    """``retention`` by ``level`` and dimensions, from ``user_sets`` of these dimensions and period."""
    check_retention(period, max_periods)
    by = ["level", *dimensions]
    level = at_levels(sets, dimensions, ["event_name", "period"])
    in_bucket = level.filter(F.col("bucket").isNotNull())
    so_far = Window.partitionBy(*by, "bucket").orderBy("period")
    anchored = (
        in_bucket.filter(F.col("event_name") == signup_event)
        .withColumn("upto", F.bitmap_or_agg("users").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.lag("upto").over(so_far))
        .select(*by, "bucket", F.col("period").alias("cohort"), "upto", "before")
    )
    new = F.bitmap_count("upto") - F.coalesce(F.bitmap_count("before"), F.lit(0).cast("long"))
    sizes = anchored.select(*by, "cohort", F.col("cohort").alias("period"), new.alias("starters"), F.lit(0).cast("long").alias("active"))
    active = in_bucket.filter(F.col("event_name") == activity_event).select(
        *[F.col(c).alias(f"_{c}") for c in [*by, "bucket"]], F.col("period"), F.col("users").alias("now")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "bucket"]]
    k = periods_between(F.col("cohort"), F.col("period"), period)
    pairs = anchored.join(active, same).filter(k.between(0, max_periods))
    # |upto or now| and |before or now|: each set a row, as OR is an aggregate
    each = F.explode(
        F.array(
            F.struct(F.col("upto").alias("a"), F.col("before").alias("b")),
            F.struct(F.col("now").alias("a"), F.col("now").alias("b")),
        )
    ).alias("x")
    unions = (
        pairs.select(*by, "bucket", "cohort", "period", new.alias("starters"), each)
        .groupBy(*by, "bucket", "cohort", "period", "starters")
        .agg(F.bitmap_or_agg("x.a").alias("a"), F.bitmap_or_agg("x.b").alias("b"))
    )
    shared = F.col("starters") - F.bitmap_count("a") + F.bitmap_count("b")
    returned = unions.select(*by, "cohort", "period", F.lit(0).cast("long").alias("starters"), shared.alias("active"))
    cells = (
        sizes.unionByName(returned)
        .groupBy(*by, "cohort", "period")
        .agg(F.sum("starters").alias("starters"), F.sum("active").alias("active"))
    )
    people = Window.partitionBy(*by, "cohort")
    cells = cells.withColumn("_size", F.sum("starters").over(people)).filter("_size > 0").drop("_size")
    seen = with_levels(sets.select(*dimensions, "period").distinct(), dimensions)
    none = F.lit(0).cast("long")
    last = seen.groupBy(*by).agg(F.max("period").alias("period")).select(
        *by, F.lit(None).cast("date").alias("cohort"), "period", none.alias("starters"), none.alias("active")
    )
    return retention_of_cells(cells.unionByName(last), by, period, max_periods, horizon)
