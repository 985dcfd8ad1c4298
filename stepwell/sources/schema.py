"""The canonical event table and ways to get one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType(), False),
        T.StructField("event_ts", T.TimestampNTZType(), False),
        T.StructField("event_name", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
    ]
)

# The dimensions of the canonical event table.
FILTERABLE = ("channel", "platform", "event_name")


def events_from_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """An event table from ``(user_id, event_ts, event_name, channel, platform)`` tuples."""
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)


def to_events(
    source: DataFrame,
    *,
    user_id: str | Column,
    event_ts: str | Column,
    event_name: str | Column,
    **dimensions: str | Column,
) -> DataFrame:
    """Map any source onto the canonical columns; each argument is a column or its name.

    The user key keeps the type of its source (a long key shuffles smaller than a string).
    """

    def column(value: str | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value

    return source.select(
        column(user_id).alias("user_id"),
        column(event_ts).cast("timestamp_ntz").alias("event_ts"),
        column(event_name).alias("event_name"),
        *[column(value).alias(name) for name, value in dimensions.items()],
    )
