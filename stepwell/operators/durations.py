"""How long users take to each step, from mergeable sketches.

A KLL sketch holds a few hundred of the durations and answers any quantile with a rank error of about
2 / ``ACCURACY`` of the users, whatever their number. Tasks sketch what they hold and sketches are
merged, so nothing is ordered and one short row per task, segment and step is shuffled. Sketches are
values: store them per segment and day, and merge them upwards later without the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import ROWS_PER_TASK
from .filters import Filters
from .funnel import (
    ACCURACY,
    DEFAULT_WINDOW_HOURS,
    check_reach,
    farthest_seconds,
    step_facts,
    step_times,
)
from .validation import check_probabilities, check_steps, check_window


def duration_sketches(
    times: DataFrame,
    steps: Sequence[str],
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    window_from: str = "entry",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per (segment, step) that any user of a ``step_times`` table reached in time.

    Columns: ``by``..., step_index, users, seconds_sketch (seconds from entry).
    """
    check_steps(steps)
    check_window(window_hours, window_from)
    check_reach(times, farthest_seconds(len(steps), window_hours, window_from))
    facts = step_facts(times, len(steps), window_hours, window_from, by)
    return (
        facts.filter("in_time")
        .groupBy(*by, F.col("step").alias("step_index"))
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.kll_sketch_agg_bigint("seconds", F.lit(ACCURACY)).alias("seconds_sketch"),
        )
    )


def merge_durations(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser segments: ``by`` names the columns kept."""
    return sketches.groupBy(*by, "step_index").agg(
        F.sum("users").alias("users"),
        F.kll_merge_agg_bigint("seconds_sketch", F.lit(ACCURACY)).alias("seconds_sketch"),
    )


def duration_quantiles(
    sketches: DataFrame, steps: Sequence[str], probabilities: Sequence[float] = (0.5, 0.9)
) -> DataFrame:
    """One row per (segment, step, probability): ``hours`` within which that share of the users who
    reached the step got there, approximately."""
    check_probabilities(probabilities)
    by = [c for c in sketches.columns if c not in ("step_index", "users", "seconds_sketch")]
    each = F.array(*[F.lit(float(p)) for p in probabilities])
    found = F.kll_sketch_get_quantile_bigint("seconds_sketch", each)
    pairs = F.explode(F.arrays_zip(each.alias("probability"), found.alias("seconds"))).alias("at")
    return (
        sketches.select(*by, "step_index", "users", pairs)
        .select(
            *by,
            "step_index",
            F.get(F.lit(list(steps)), F.col("step_index")).alias("step_name"),
            "users",
            "at.probability",
            (F.col("at.seconds") / 3600).alias("hours"),
        )
        .orderBy(*by, "step_index", "probability")
    )


def funnel_quantiles(
    events: DataFrame,
    steps: Sequence[str],
    probabilities: Sequence[float] = (0.5, 0.9),
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    window_from: str = "entry",
    filters: Filters = None,
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """:func:`duration_quantiles` straight from events."""
    check_steps(steps)
    check_window(window_hours, window_from)
    times = step_times(
        events,
        steps,
        filters=filters,
        by=by,
        within_seconds=farthest_seconds(len(steps), window_hours, window_from),
        rows_per_task=rows_per_task,
    )
    sketches = duration_sketches(
        times, steps, window_hours=window_hours, window_from=window_from, by=by
    )
    return duration_quantiles(sketches, steps, probabilities)
