"""The event table on disk: parquet, one directory per event date and load.

A load (the first build, or a later batch) owns its files below every date it has rows for, so late
events touch their own dates only and a load that comes again replaces its own rows. Checks on rows
are counted while they are written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import shared_folder

#: The columns that no event table lacks.
REQUIRED = ("user_id", "event_ts", "event_name")
#: The load that ``build_event_table`` writes.
BASE = "base"
#: Key of the column metadata that tells that rows are bucketed by that column.
BUCKETS = "buckets"


@dataclass(frozen=True)
class Load:
    """What a load wrote: its rows, and for each row check how many rows violate it."""

    rows: int
    violations: dict[str, int]


def _checked(events: DataFrame) -> DataFrame:
    """``events``, where a missing column is an error and a NULL in a required one fails the write."""
    missing = [c for c in REQUIRED if c not in events.columns]
    if missing:
        raise ValueError(f"An event table needs the columns {', '.join(missing)}")
    return events.withColumns(
        {
            c: F.coalesce(c, F.raise_error(F.lit(f"{c} is NULL")).cast(events.schema[c].dataType))
            for c in REQUIRED
        }
    )


def _write(
    events: DataFrame,
    path: str,
    load: str,
    overwrite: str,
    vocabulary: Sequence[str] | None,
    horizon: datetime | None,
) -> Load:
    dated = _checked(events).withColumns(
        {"event_date": F.col("event_ts").cast("date"), "load": F.lit(load)}
    )
    checks = {f"{c}_not_null": F.col(c).isNull() for c in events.columns}
    if vocabulary is not None:
        checks["known_event_name"] = ~F.col("event_name").isin(list(vocabulary))
    if horizon is not None:
        checks["before_horizon"] = F.col("event_ts") >= F.lit(horizon).cast("timestamp_ntz")
    counted = Observation(f"load-{uuid.uuid4().hex}")
    (
        # Busy dates are split over many files and quiet ones merged. Rows are counted in the stage
        # that writes them, where every row passes once.
        dated.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "event_name", "user_id", "event_ts")
        .observe(
            counted,
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(violated).alias(name) for name, violated in checks.items()],
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", overwrite)
        .partitionBy("event_date", "load")
        .parquet(path)
    )
    found = dict(counted.get)
    return Load(found.pop("rows"), found)


def load_event_table(
    events: DataFrame,
    path: str,
    *,
    vocabulary: Sequence[str] | None = None,
    horizon: datetime | None = None,
) -> Load:
    """(Re)write the table at ``path``, counting rows and violated checks on the way.

    Files are sorted by event name and user, so that a filter on the event name skips row groups.
    A missing column is an error, and so is a NULL in the columns that every event has: the write
    fails on the first one. ``vocabulary`` and ``horizon`` add the checks of the same names in
    ``event_quality``.
    """
    return _write(events, path, BASE, "static", vocabulary, horizon)


def build_event_table(events: DataFrame, path: str) -> int:
    """:func:`load_event_table`, returning the row count."""
    return load_event_table(events, path).rows


def add_events(
    events: DataFrame,
    path: str,
    load: str,
    *,
    vocabulary: Sequence[str] | None = None,
    horizon: datetime | None = None,
) -> Load:
    """Add a batch to the table at ``path`` under the name ``load``.

    Only the dates of ``events`` are touched, and there only files of the same load: the same batch
    again replaces itself, and other loads' files stay as they are.
    """
    if load == BASE or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", load):
        raise ValueError(f"Not a name of a load: {load!r}; use letters, digits, - _ .")
    return _write(events, path, load, "dynamic", vocabulary, horizon)


def open_event_table(
    spark: SparkSession,
    path: str,
    *,
    start: date | None = None,
    end: date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The events of ``path``, optionally from ``start`` up to but not including ``end``.

    The dates prune whole directories. ``schema`` spares the look into a file footer.
    """
    reader = spark.read
    if schema is not None:
        placed = [T.StructField("event_date", T.DateType()), T.StructField("load", T.StringType())]
        reader = reader.schema(T.StructType([*schema.fields, *placed]))
    try:
        table = reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(
            f"No event table at {path}. Build it first, with build_event_table."
        ) from error
    if start is not None:
        table = table.filter(F.col("event_date") >= F.lit(start))
    if end is not None:
        table = table.filter(F.col("event_date") < F.lit(end))
    return table.drop("event_date", "load")


def build_bucketed_table(events: DataFrame, name: str, path: str, buckets: int) -> None:
    """(Re)write ``events`` as the catalog table ``name`` at ``path``, bucketed by user and sorted by
    user and time, for many funnels over the same events: none of them moves an event.

    A bucket with more rows than a task should write becomes several files. Users with a large
    share of all rows are better served by :func:`build_event_table`, as a bucket is read by one
    task.
    """
    bucket = F.pmod(F.hash("user_id"), F.lit(buckets))
    order = ["user_id", "event_ts"]
    (
        _checked(events)
        .withColumn("_bucket", bucket)
        .hint("rebalance", "_bucket")
        .sortWithinPartitions("_bucket", *order)
        .drop("_bucket")
        .write.mode("overwrite")
        .bucketBy(buckets, "user_id")
        .sortBy(*order)
        .option("path", path)
        .saveAsTable(name)
    )


def open_bucketed_table(spark: SparkSession, name: str) -> DataFrame:
    """The events of ``name``; ``user_id`` carries the number of buckets, by which operators see
    that rows need not move. Should a later step move them after all, Spark moves them back."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()  # a few rows
    found = {r.col_name: r.data_type for r in described}
    columns = found.get("Bucket Columns", "").strip("[]`")
    if columns != "user_id":
        raise ValueError(f"{name} is not bucketed by user_id")
    mark = {BUCKETS: int(found["Num Buckets"])}
    table = spark.table(name)
    return table.select(
        *[F.col(c).alias(c, metadata=mark) if c == "user_id" else F.col(c) for c in table.columns]
    )


def is_colocated(events: DataFrame) -> bool:
    return "user_id" in events.columns and BUCKETS in events.schema["user_id"].metadata


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}-{name}"
