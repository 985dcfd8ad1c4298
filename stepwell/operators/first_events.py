"""The first time each user fired each event, kept up to date batch by batch.

Minima of minima are minima, so batches may come late, twice or out of order. The result has
the canonical columns: it serves cohorts, naive funnels and "never did" questions in place of
the raw events. It does not serve ordered funnels, which need the first event *after* the
previous step.

The table is a versioned list of folders (see ``plans.versions``): a batch, a repeated batch or a
compaction becomes visible in one step, and a reader never sees less than some earlier state.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import versions

#: Producer of the compacted past; no batch can have its name.
BASE = "_base"


def first_events(events: DataFrame) -> DataFrame:
    """One row per (user_id, event_name) with the earliest ``event_ts``."""
    return events.groupBy("user_id", "event_name").agg(F.min("event_ts").alias("event_ts"))


def add_first_events(batch: DataFrame, path: str, batch_id: int, producer: str) -> int:
    """Add one batch of ``producer`` (a job, a stream with its checkpoint) to ``path``; returns the
    version that shows it.

    A batch owns one entry of its producer's; adding it again replaces that entry, so a retried
    batch is harmless, and no batch replaces what another producer wrote. A job that starts
    counting batches anew (a stream with a new checkpoint) needs a new name.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", producer):
        raise ValueError(f"Not a producer name: {producer!r}; use letters, digits, - _ .")
    folder = versions.new_folder(path)
    first_events(batch).write.parquet(folder)
    entry = {"producer": producer, "batch": str(batch_id), "folder": folder}

    def change(now: list[versions.Entry]) -> list[versions.Entry]:
        same = (entry["producer"], entry["batch"])
        return [*[e for e in now if (e["producer"], e["batch"]) != same], entry]

    return versions.publish(batch.sparkSession, path, change)


def read_first_events(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of all batches added so far, or as of ``version``."""
    listed = versions.entries(spark, path, version)
    if not listed:
        raise FileNotFoundError(f"No first events at {path}. Add a batch first.")
    return first_events(spark.read.parquet(*[e["folder"] for e in listed]))


def compact_first_events(spark: SparkSession, path: str, target: str | None = None) -> int:
    """Fold all batches of ``path`` into one folder and return the version that shows it.

    In place, batches added meanwhile stay beside it, and a folded batch that comes again changes
    nothing. With ``target``, the state becomes the past of a new table there, to which any
    producer may go on adding batches, numbered as it likes.
    """
    at = versions.versions(spark, path)
    folded = versions.entries(spark, path, at[-1]) if at else []
    folder = versions.new_folder(target or path)
    read_first_events(spark, path, at[-1] if at else None).write.parquet(folder)
    entry = {"producer": BASE, "batch": "0", "folder": folder}
    gone = set() if target else {e["folder"] for e in folded}
    return versions.publish(
        spark, target or path, lambda now: [entry, *[e for e in now if e["folder"] not in gone]]
    )


def forget_first_events(spark: SparkSession, path: str, keep: int = 3) -> int:
    """Delete what only versions older than the newest ``keep`` need; returns the folders deleted."""
    return versions.forget(spark, path, keep)
