"""Calendar arithmetic on zone-less timestamps.

Everything goes through ``date`` or through whole epoch seconds, so no result depends on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("week", "month")


def period_start(ts: Column, period: str) -> Column:
    """The Monday, or the first of the month, of ``ts``, as a date."""
    return F.trunc(ts.cast("date"), period)


def periods_between(start: Column, end: Column, period: str) -> Column:
    """Number of periods from one period start to another; negative when ``end`` is earlier."""
    if period == "week":
        return F.floor(F.datediff(end, start) / 7)
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months.cast("long")


def whole_seconds_between(start: str, end: str) -> str:
    """SQL: seconds between two instants, each first cut to its whole second."""
    return f"(unix_timestamp({end}) - unix_timestamp({start}))"


def micros(ts: str) -> str:
    """SQL: microseconds since 1970 on the clock of a zone-less time, as a long."""
    since = f"CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return f"CAST(1000000 * CAST(CAST({since} AS INTERVAL SECOND) AS DECIMAL(20, 6)) AS BIGINT)"
