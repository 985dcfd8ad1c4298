"""Segments and filters by attributes of users.

An attribute belongs to the user, so it never has to be joined to every event. A filter keeps the
events of the users who pass, by a semi-join on their ids. A segment joins what operators have folded
events to: one row per user, or one per user and period. ``users`` is a table with one row per
``user_id`` and a column per attribute; users it does not have are in the NULL segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import Filters, apply_filters


def attributes_of(events: DataFrame, names: Sequence[str], users: DataFrame | None) -> list[str]:
    """Those of ``names`` that are attributes of users rather than columns of events."""
    if users is None:
        return []
    both = [c for c in users.columns if c != "user_id" and c in events.columns]
    if both:
        raise ValueError(f"both events and users have the columns {', '.join(both)}")
    return [c for c in names if c in users.columns]


def filter_users(
    events: DataFrame, filters: Filters, users: DataFrame | None
) -> tuple[DataFrame, DataFrame | None, bool]:
    """``events`` and ``users`` under ``filters``, and whether a semi-join took place (then events of
    a large table come out partitioned by user)."""
    filters = dict(filters or {})
    mine = attributes_of(events, list(filters), users)
    of_users = {c: filters.pop(c) for c in mine}
    events = apply_filters(events, filters)
    if not any(list(values) for values in of_users.values()):
        return events, users, False
    users = apply_filters(users, of_users, allowed=mine)
    return events.join(users.select("user_id"), "user_id", "left_semi"), users, True


def with_attributes(folded: DataFrame, users: DataFrame | None, names: Sequence[str]) -> DataFrame:
    """``folded`` (a column ``user_id``) with the attributes ``names``."""
    if not names:
        return folded
    own = users.select(F.col("user_id").alias("_user_id"), *names)
    return folded.join(own, F.col("user_id") == F.col("_user_id"), "left").drop("_user_id")


def distinct_attribute(events: DataFrame, column: str, users: DataFrame) -> DataFrame:
    """The sorted values of one attribute over the users who have events."""
    present = events.select("user_id").distinct()
    return with_attributes(present, users, [column]).select(column).distinct().orderBy(column)
