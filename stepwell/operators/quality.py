"""Checks on an event table, and the populations its anomalies leave behind.

Each is one pass with one shuffle by user; rows are folded to one per user inside every task
first, so a user with a third of the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(name: str) -> Column:
    return F.min(F.when(F.col("event_name") == name, F.col("event_ts")))


def event_quality(
    events: DataFrame, vocabulary: Sequence[str], horizon: datetime, anchor: str
) -> DataFrame:
    """One row per check: ``check``, ``checked`` (rows or users) and ``violations``."""
    name, ts = F.col("event_name"), F.col("event_ts")
    columns = events.columns
    users = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~name.isin(list(vocabulary))).alias("unknown"),
        F.count_if(ts >= F.lit(horizon).cast("timestamp_ntz")).alias("late"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        F.min(ts).alias("first_ts"),
        _first(anchor).alias("anchor_ts"),
        F.count_if(name == anchor).alias("anchors"),
    )
    anchor_not_first = F.col("anchor_ts").isNull() | (F.col("anchor_ts") > F.col("first_ts"))
    totals = users.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"),
        F.count_if(anchor_not_first).alias("anchor_not_first"),
        F.count_if(F.col("anchors") != 1).alias("not_one_anchor"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in columns],
    )
    checks = [
        ("known_event_name", "rows", "unknown"),
        ("before_horizon", "rows", "late"),
        ("anchor_comes_first", "users", "anchor_not_first"),
        ("exactly_one_anchor", "users", "not_one_anchor"),
        *[(f"{c}_not_null", "rows", f"null_{c}") for c in columns],
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("check"),
                F.col(checked).alias("checked"),
                F.col(violations).alias("violations"),
            )
            for label, checked, violations in checks
        ]
    )
    return totals.select(F.inline(rows))


def event_histogram(events: DataFrame) -> DataFrame:
    """Events per name, most frequent first."""
    return (
        events.groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "event_name")
    )


def late_activators(
    events: DataFrame, *, anchor: str, activity: str, hours: float = 24 * 7
) -> DataFrame:
    """Users whose first activity came more than ``hours`` after their first anchor event."""
    users = (
        events.filter(F.col("event_name").isin(anchor, activity))
        .groupBy("user_id")
        .agg(_first(anchor).alias("anchor_ts"), _first(activity).alias("activity_ts"))
    )
    delay = F.make_dt_interval(secs=F.lit(hours * 3600))
    return users.filter(F.col("activity_ts") > F.col("anchor_ts") + delay)


def did_without(events: DataFrame, *, did: str, never: str) -> DataFrame:
    """Users who fired ``did`` and never ``never``."""
    name = F.col("event_name")
    return (
        events.filter(name.isin(did, never))
        .groupBy("user_id")
        .agg(F.count_if(name == did).alias("times"), F.max(name == never).alias("other"))
        .filter((F.col("times") > 0) & ~F.col("other"))
        .select("user_id", "times")
    )
