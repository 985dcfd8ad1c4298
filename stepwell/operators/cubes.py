"""Retention and funnels at every level of a set of filter dimensions, in one pass.

Distinct users do not add up over dimensions that vary from row to row, so no level is
summed from a finer one: each event is repeated once per level and the segmented operator
counts the users of each level afresh. Every row equals the call filtered to its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import ROWS_PER_TASK, heavy_keys
from .filters import apply_filters
from .funnel import (
    DEFAULT_WINDOW_HOURS,
    farthest_seconds,
    funnel_from_times,
    step_times,
)
from .retention import retention
from .validation import check_steps, check_window


def with_levels(events: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Repeat events per level. ``level`` names the dimensions kept; the others are NULL."""
    levels = [
        kept for size in range(len(dimensions) + 1) for kept in combinations(dimensions, size)
    ]
    rows = [
        F.struct(
            F.lit("+".join(kept) or "all").alias("level"),
            *[
                (F.col(d) if d in kept else F.lit(None).cast("string")).alias(d)
                for d in dimensions
            ],
        )
        for kept in levels
    ]
    others = [c for c in events.columns if c not in dimensions]
    return events.select(*others, F.explode(F.array(*rows)).alias("at")).select(*others, "at.*")


def retention_cube(events: DataFrame, dimensions: Sequence[str], **options) -> DataFrame:
    """``retention`` by ``level`` and dimensions; ``options`` are those of ``retention``."""
    return retention(with_levels(events, dimensions), by=["level", *dimensions], **options)


def funnel_cube(
    events: DataFrame, steps: Sequence[str], dimensions: Sequence[str], **options
) -> DataFrame:
    """``funnel`` by ``level`` and dimensions; ``options`` are those of ``funnel``."""
    check_steps(steps)
    window_hours = options.pop("window_hours", DEFAULT_WINDOW_HOURS)
    window_from = options.pop("window_from", "entry")
    check_window(window_hours, window_from)
    by = ["level", *dimensions]
    base = apply_filters(events, options.pop("filters", None))
    rows = base.filter(F.col("event_name").isin(list(steps)) & F.col("user_id").isNotNull()).select(
        "user_id", "event_ts", "event_name", *dimensions
    )
    within = farthest_seconds(len(steps), window_hours, window_from)
    heavy = heavy_keys(rows, rows_per_task=options.pop("rows_per_task", ROWS_PER_TASK))
    if options:
        raise TypeError(f"funnel_cube has no {', '.join(options)}")
    light = rows.join(F.broadcast(heavy), "user_id", "left_anti") if heavy.count() else rows
    # by user first, levels after: the exchange carries each event once, not once per level
    times = step_times(
        with_levels(light.repartition("user_id"), dimensions),
        steps,
        by=by,
        within_seconds=within,
        colocated=True,
        heavy=heavy.limit(0),
    )
    if heavy.count():
        hot = rows.join(F.broadcast(heavy.select("user_id")), "user_id", "left_semi")
        split = {"by": by, "within_seconds": within, "heavy": heavy}
        times = times.unionByName(step_times(with_levels(hot, dimensions), steps, **split))
    segments = with_levels(base.select(*dimensions).distinct(), dimensions)
    return funnel_from_times(
        times, steps, window_hours=window_hours, window_from=window_from, by=by, segments=segments
    )


def write_cube(cube: DataFrame, path: str) -> None:
    """Store a cube; a dashboard then reads one partition per level."""
    cube.write.mode("overwrite").partitionBy("level").parquet(path)
