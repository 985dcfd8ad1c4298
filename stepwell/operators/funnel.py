"""Step-ordered funnels with a conversion window.

A user's path is the greedy chain: the first event of step 0, then for every later step its
first event strictly after the one before. A conversion window never changes which event is
next. It only decides how far along the chain the user still counts. So the chain is found
once (:func:`step_times`), one row per user, and every window, anchor, naive count and
comparison is arithmetic on that row.

``step_times`` shuffles each event once, by user, and chains window minima over that one
partitioning; no join per step. Users with too many rows for one task (see ``plans.skew``)
are spread over tasks by time instead, once, and the slices' summaries are composed
(see ``plans.chains``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import overall_conversion, step_conversion
from ..functions.time import whole_seconds_between
from ..plans.chains import MAX_BROADCAST, times_by_slices
from ..plans.medians import with_medians
from ..plans.skew import ROWS_PER_TASK, heavy_keys
from ..sources.tables import is_colocated
from .filters import Filters, apply_filters
from .users import attributes_of, filter_users, with_attributes
from .validation import check_choice, check_steps, check_window

#: Fixed value: the window if none is given.
DEFAULT_WINDOW_HOURS = 24 * 7
#: Size parameter of duration sketches: rank error about 2 / ACCURACY.
ACCURACY = 1024
#: Tasks per heavy user where the caller names heavy users without their ``slices``.
DEFAULT_SLICES = 64


def window_seconds(window_hours: float) -> int:
    return int(window_hours * 3600)


def farthest_seconds(count: int, window_hours: float, window_from: str) -> int:
    """How long after entry the last step can lie."""
    return window_seconds(window_hours) * (1 if window_from == "entry" else count - 1)


# --------------------------------------------------------------------------- per user


def step_events(events: DataFrame, steps: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The events of the funnel, with the step number in place of the name. A NULL is no user."""
    steps = list(steps)
    number = F.array_position(F.lit(steps), F.col("event_name")) - 1
    of_steps = F.col("event_name").isin(steps) & F.col("user_id").isNotNull()
    return events.filter(of_steps).select(
        *by, "user_id", "event_ts", number.cast("int").alias("step")
    )


def step_times(
    events: DataFrame,
    steps: Sequence[str],
    *,
    filters: Filters = None,
    by: Sequence[str] = (),
    within_seconds: int | None = None,
    colocated: bool | None = None,
    heavy: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per (segment, user) with any step event: ``t0..`` and ``ever0..``.

    ``t<i>`` is the time the user reached step i in order, without a time limit; NULL when
    never. ``ever<i>`` tells whether the event was ever fired at all. Cache this table to
    evaluate many windows. ``within_seconds`` leaves out events later than that after entry,
    which drops most of them early when windows are short; the table remembers the limit, and
    a wider window asked of it later is an error. Set
    ``colocated`` when ``events`` is already partitioned by ``user_id`` (the result of a join on the
    user; tables of ``open_bucketed_table`` tell by themselves): then no event moves at all. ``heavy`` takes a table found
    earlier by ``plans.skew.heavy_keys``; else a job sketches the most frequent users first.
    """
    check_steps(steps)
    # The user first: rows are sorted by the first key's leading bytes, and segment names
    # would leave nearly all of them tied.
    entity, count = ["user_id", *by], len(steps)
    colocated = is_colocated(events) if colocated is None else colocated
    rows = step_events(apply_filters(events, filters), steps, by)
    if heavy is None:
        heavy = heavy_keys(rows, rows_per_task=rows_per_task)
    many = heavy.count()
    light = rows
    if many:
        slices = F.col("slices") if "slices" in heavy.columns else F.lit(DEFAULT_SLICES)
        heavy = heavy.select("user_id", slices.alias("slices"))
        known = heavy.select(F.col("user_id").alias("_user_id"))
        known = F.broadcast(known) if many <= MAX_BROADCAST else known
        light = rows.join(known, F.col("user_id") == F.col("_user_id"), "left_anti")
    # Spelled out, so that only the columns of ``rows`` cross the exchange: the arguments of
    # the windows are then made behind it.
    placed = light if colocated else light.repartition(*entity)
    times = _times_by_window(placed, entity, count, within_seconds)
    if many:
        sliced = times_by_slices(rows, entity, count, heavy, _fired(count))
        times = times.unionByName(_within(sliced, count, within_seconds))
    limit = {} if within_seconds is None else {"within_seconds": within_seconds}
    return times.select(
        *by,
        "user_id",
        F.col("t0").alias("t0", metadata=limit),
        *[f"t{i}" for i in range(1, count)],
        *_ever(count),
    )


def check_reach(times: DataFrame, farthest: int | None) -> None:
    """Refuse a ``step_times`` table that left out events the window needs (None: all)."""
    limit = times.schema["t0"].metadata.get("within_seconds")
    if limit is not None and (farthest is None or farthest > limit):
        raise ValueError(
            f"these times reach {limit} seconds after entry, too short for this window;"
            " make them with a larger within_seconds"
        )


def _time_of(step: int, after: str | None = None) -> Column:
    """Aggregate: the first event of ``step``, strictly after the time in column ``after``."""
    later = f" AND event_ts > {after}" if after else ""
    return F.expr(f"min(CASE WHEN step = {step}{later} THEN event_ts END)")


#: Steps per bit mask.
MASK_BITS = 62


def _fired(count: int) -> dict[str, Column]:
    """Aggregates: bit masks of the steps fired, one column per ``MASK_BITS`` steps."""
    return {
        f"fired{m}": F.expr(
            f"bit_or(CASE WHEN step div {MASK_BITS} = {m}"
            f" THEN shiftleft(1L, step % {MASK_BITS}) ELSE 0L END)"
        )
        for m in range((count - 1) // MASK_BITS + 1)
    }


def _ever(count: int) -> list[Column]:
    return [
        F.expr(f"getbit(fired{i // MASK_BITS}, {i % MASK_BITS}) = 1 AS ever{i}")
        for i in range(count)
    ]


def _times_by_window(
    rows: DataFrame, entity: list[str], count: int, within_seconds: int | None
) -> DataFrame:
    """One sort; each step is a window over the same partitioning by user.

    Once entry is known, only events after it can matter.
    """
    user = Window.partitionBy(*entity)
    per_user = {"t0": _time_of(0), "first_ts": F.min("event_ts"), **_fired(count)}
    rows = rows.withColumns(
        {name: aggregate.over(user) for name, aggregate in per_user.items()}
    )
    after_entry = "event_ts > t0"
    if within_seconds is not None:
        after_entry += f" AND event_ts <= t0 + make_dt_interval(0, 0, 0, {within_seconds})"
    # the first event stays for users who have no other row left
    rows = rows.filter(f"event_ts = first_ts OR ({after_entry})")
    for i in range(1, count):
        rows = rows.withColumn(f"t{i}", _time_of(i, f"t{i - 1}").over(user))
    kept = [*[f"t{i}" for i in range(count)], *_fired(count)]
    return rows.groupBy(*entity).agg(*[F.max(name).alias(name) for name in kept])


def _within(times: DataFrame, count: int, within_seconds: int | None) -> DataFrame:
    """Forget times later than ``within_seconds`` after entry."""
    if within_seconds is None:
        return times
    limit = f"t0 + make_dt_interval(0, 0, 0, {within_seconds})"
    late = {f"t{i}": F.expr(f"CASE WHEN t{i} <= {limit} THEN t{i} END") for i in range(1, count)}
    return times.withColumns(late)


# ------------------------------------------------------------------------- per segment


def reached(count: int, window_hours: float, window_from: str) -> list[str]:
    """For each step, the SQL condition that the user of a ``step_times`` row got there within
    the window. A comparison with a time that is NULL is NULL, which counts as no.

    Times increase along a chain, so from entry the last step in time vouches for those before
    it; from the previous step every gap has to be short enough.
    """
    limit = f"make_dt_interval(0, 0, 0, {window_seconds(window_hours)})"
    if window_from == "entry":
        return ["t0 IS NOT NULL", *[f"t{i} <= t0 + {limit}" for i in range(1, count)]]
    gaps = [f"t{i} <= t{i - 1} + {limit}" for i in range(1, count)]
    return ["t0 IS NOT NULL", *[" AND ".join(gaps[:i]) for i in range(1, count)]]


def step_facts(
    times: DataFrame, count: int, window_hours: float, window_from: str, by: Sequence[str] = ()
) -> DataFrame:
    """One row per (user, step) of a ``step_times`` table: ``by``..., step, in_time (reached in
    order and in time), ever, in_order, seconds (from entry, NULL unless in time)."""
    in_time = reached(count, window_hours, window_from)
    facts = ", ".join(
        f"named_struct('step', {i}, 'in_time', {in_time[i]}, 'ever', ever{i},"
        f" 'in_order', t{i} IS NOT NULL, 'seconds', {whole_seconds_between('t0', f't{i}')})"
        for i in range(count)
    )
    return (
        times.select(*by, F.expr(f"explode(array({facts})) AS fact"))
        .select(*by, "fact.*")
        .withColumn("seconds", F.expr("CASE WHEN in_time THEN seconds END"))
    )


#: How a median is found.
MEDIANS = ("exact", "sketch", "none")


def step_counts(
    times: DataFrame,
    count: int,
    *,
    window_hours: float,
    window_from: str,
    by: Sequence[str] = (),
    median: str = "exact",
) -> DataFrame:
    """One row per segment; ``by_step`` maps a step number to its counts.

    users: reached in order and in time; naive: ever fired; ordered: reached in order at any
    time; median: hours from entry (NULL with ``median="none"``, or when nobody got there).
    ``"sketch"`` takes it from a sketch of the durations: nothing is ordered or counted per second.
    """
    keys = [*by, "step"]
    per_user = step_facts(times, count, window_hours, window_from, by)
    counted = ["users", "naive", "ordered"]
    tally = [
        F.expr(f"count_if({flag}) AS {name}")
        for flag, name in zip(("in_time", "ever", "in_order"), counted, strict=True)
    ]
    if median == "exact":
        # Equal durations are combined first: at most one row per (step, second).
        per_second = per_user.groupBy(*keys, "seconds").agg(*tally)
        farthest = farthest_seconds(count, window_hours, window_from)
        per_step = with_medians(
            per_second, keys, "seconds", "users", counted, below=farthest
        ).withColumn("median", F.expr("median / 3600D"))
    elif median == "sketch":
        sketch = F.expr(f"kll_sketch_agg_bigint(seconds, {ACCURACY}) AS sketch")
        middle = "CASE WHEN users > 0 THEN kll_sketch_get_quantile_bigint(sketch, 0.5D) / 3600D END"
        sketched = per_user.groupBy(*keys).agg(*tally, sketch)
        per_step = sketched.select(*keys, *counted, F.expr(f"{middle} AS median"))
    else:
        per_step = per_user.groupBy(*keys).agg(*tally, F.lit(None).cast("double").alias("median"))
    return per_step.groupBy(*by).agg(
        F.expr(
            "map_from_entries(collect_list(struct(step, struct(users, naive, ordered, median))))"
            " AS by_step"
        )
    )


def with_all_segments(
    counts: DataFrame, base: DataFrame | None, by: Sequence[str]
) -> DataFrame:
    """Add the segments of ``base`` that have no step event at all."""
    if not by or base is None:
        return counts
    kind = counts.schema["by_step"].dataType
    segments = base.select(*by).distinct().withColumn("by_step", F.lit(None).cast(kind))
    return counts.unionByName(segments).groupBy(*by).agg(
        F.first("by_step", ignorenulls=True).alias("by_step")
    )


def each_step(counts: DataFrame, steps: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per (segment, step), steps without any user included.

    ``users``, ``naive``, ``ordered`` and ``median`` are those of the step; ``of_entry`` and
    ``of_previous`` hold the counts of the first step and the one before.
    """
    every_step = F.posexplode(F.lit(list(steps))).alias("step_index", "step_name")
    at = "try_element_at(by_step, {})".format
    none = "named_struct('users', 0L, 'naive', 0L, 'ordered', 0L, 'median', CAST(NULL AS DOUBLE))"
    return (
        counts.select(*by, "by_step", every_step)
        .select(
            *by,
            "step_index",
            "step_name",
            F.expr(f"coalesce({at('step_index')}, {none}) AS of_step"),
            F.expr(f"coalesce({at('0')}, {none}) AS of_entry"),
            F.expr(
                f"CASE WHEN step_index > 0 THEN coalesce({at('step_index - 1')}, {none}) END"
                " AS of_previous"
            ),
        )
        .select("*", "of_step.*")
    )


def funnel_columns(by: Sequence[str], field: str, median_hours: str) -> list[Column]:
    entered, previous = f"of_entry.{field}", f"of_previous.{field}"
    return [
        *[F.col(c) for c in by],
        F.col("step_index"),
        F.col("step_name"),
        F.col(field).alias("users"),
        F.expr(f"{median_hours} AS median_hours"),
        F.expr(f"{step_conversion(field, previous)} AS step_conversion"),
        F.expr(f"{overall_conversion(field, entered)} AS overall_conversion"),
        F.expr(f"coalesce({previous} - {field}, 0L) AS dropped"),
    ]


# --------------------------------------------------------------------------- operators


def funnel(
    events: DataFrame,
    steps: Sequence[str],
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    window_from: str = "entry",
    filters: Filters = None,
    by: Sequence[str] = (),
    users: DataFrame | None = None,
    median: str = "exact",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Step-ordered, time-windowed funnel, one row per (segment, step).

    Columns: ``by``..., step_index, step_name, users, median_hours, step_conversion,
    overall_conversion, dropped. Each step must come strictly after the one before and at
    most ``window_hours`` after the first step (``window_from="entry"``) or the step before
    (``"previous"``). ``filters`` and ``by`` may name attributes of ``users`` (see
    ``operators.users``). ``median="sketch"`` gives an approximate ``median_hours`` (see
    ``operators.durations``), ``"none"`` leaves it NULL.
    """
    check_steps(steps)
    check_window(window_hours, window_from)
    check_choice("median", median, MEDIANS)
    times, segments = segmented_times(
        events,
        steps,
        filters,
        by,
        users,
        farthest_seconds(len(steps), window_hours, window_from),
        rows_per_task,
    )
    return funnel_from_times(
        times,
        steps,
        window_hours=window_hours,
        window_from=window_from,
        by=by,
        median=median,
        segments=segments,
    )


def segmented_times(
    events: DataFrame,
    steps: Sequence[str],
    filters: Filters,
    by: Sequence[str],
    users: DataFrame | None,
    within_seconds: int | None,
    rows_per_task: int,
) -> tuple[DataFrame, DataFrame]:
    """``step_times`` by columns of events and attributes of ``users``, and a table whose ``by``
    columns hold all segments."""
    attributes = attributes_of(events, by, users)
    own = [c for c in by if c not in attributes]
    base, users, joined = filter_users(events, filters, users)
    times = step_times(
        base,
        steps,
        by=own,
        within_seconds=within_seconds,
        colocated=True if joined else None,
        rows_per_task=rows_per_task,
    )
    if not attributes:
        return times, base
    present = base.select("user_id", *own).distinct()  # one row per user and task is shuffled
    return with_attributes(times, users, attributes), with_attributes(present, users, attributes)


def funnel_from_times(
    times: DataFrame,
    steps: Sequence[str],
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    window_from: str = "entry",
    by: Sequence[str] = (),
    median: str = "exact",
    segments: DataFrame | None = None,
) -> DataFrame:
    """:func:`funnel` from a ``step_times`` table.

    Cache the table to try several windows. To segment by an attribute of the user, join the
    attribute to ``times`` (one row per user) rather than to the events. ``segments`` is any
    table whose ``by`` columns list the segments to report even when empty.
    """
    check_steps(steps)
    check_window(window_hours, window_from)
    check_reach(times, farthest_seconds(len(steps), window_hours, window_from))
    check_choice("median", median, MEDIANS)
    counts = step_counts(
        times, len(steps), window_hours=window_hours, window_from=window_from, by=by, median=median
    )
    median_hours = "CASE WHEN step_index = 0 THEN 0D ELSE median END"
    return (
        each_step(with_all_segments(counts, segments, by), steps, by)
        .select(*funnel_columns(by, "users", median_hours))
        .orderBy(*by, "step_index")
    )


def naive_funnel(
    events: DataFrame,
    steps: Sequence[str],
    *,
    filters: Filters = None,
    by: Sequence[str] = (),
    users: DataFrame | None = None,
) -> DataFrame:
    """Users who ever fired each event, in any order and at any time.

    Same columns as :func:`funnel`, ``median_hours`` NULL. Rows collapse to one per user
    inside each task, before the only large shuffle.
    """
    check_steps(steps)
    count = len(steps)
    fired = [aggregate.alias(name) for name, aggregate in _fired(count).items()]
    # Other events lose their user and fold to one row per segment in each task, so segments
    # without any step come from the same pass.
    number = F.array_position(F.lit(list(steps)), F.col("event_name")) - 1
    counts_as = F.col("event_name").isin(list(steps)) & F.col("user_id").isNotNull()
    attributes = attributes_of(events, by, users)
    own = [c for c in by if c not in attributes]
    base, users, _ = filter_users(events, filters, users)
    # ... and so do those of users' attributes, for which other events keep their user
    counted = F.lit(bool(attributes)) | counts_as
    rows = (base if by else base.filter(counts_as)).select(
        *own,
        F.when(counted, F.col("user_id")).alias("user_id"),
        F.when(counts_as, number).cast("int").alias("step"),
    )
    folded = with_attributes(rows.groupBy(*own, "user_id").agg(*fired), users, attributes)
    totals = (
        folded.select(*by, *_ever(count))
        .groupBy(*by)
        .agg(*[F.expr(f"count_if(ever{i}) AS n{i}") for i in range(count)])
    )
    entries = ", ".join(
        f"{i}, named_struct('users', 0L, 'naive', n{i}, 'ordered', 0L,"
        " 'median', CAST(NULL AS DOUBLE))"
        for i in range(count)
    )
    by_step = F.expr(f"map({entries})")
    return (
        each_step(totals.select(*by, by_step.alias("by_step")), steps, by)
        .select(*funnel_columns(by, "naive", "CAST(NULL AS DOUBLE)"))
        .orderBy(*by, "step_index")
    )


def _both_counts(
    events, steps, window_hours, window_from, filters, by, users, times, rows_per_task, bounded
) -> DataFrame:
    """``each_step`` rows that carry ordered and naive counts from one pass."""
    check_steps(steps)
    check_window(window_hours, window_from)
    count = len(steps)
    farthest = farthest_seconds(count, window_hours, window_from) if bounded else None
    if times is not None:
        check_reach(times, farthest)
        segments = apply_filters(events, filters)
    else:
        times, segments = segmented_times(
            events, steps, filters, by, users, farthest, rows_per_task
        )
    counts = step_counts(
        times, count, window_hours=window_hours, window_from=window_from, by=by, median="none"
    )
    return each_step(with_all_segments(counts, segments, by), steps, by)


def compare(
    events: DataFrame,
    steps: Sequence[str],
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    window_from: str = "entry",
    filters: Filters = None,
    by: Sequence[str] = (),
    users: DataFrame | None = None,
    times: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Ordered and naive counts side by side, and by how much the naive one is too high."""
    rows = _both_counts(
        events, steps, window_hours, window_from, filters, by, users, times, rows_per_task, True
    )
    return rows.select(
        *by,
        "step_index",
        "step_name",
        F.col("users").alias("users_ordered"),
        F.expr(
            f"{overall_conversion('users', 'of_entry.users')} AS overall_conversion_ordered"
        ),
        F.col("naive").alias("users_naive"),
        F.expr(f"{overall_conversion('naive', 'of_entry.naive')} AS overall_conversion_naive"),
        F.expr("naive - users AS overcount"),
    ).orderBy(*by, "step_index")


def overcount_reasons(
    events: DataFrame,
    steps: Sequence[str],
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    window_from: str = "entry",
    filters: Filters = None,
    by: Sequence[str] = (),
    users: DataFrame | None = None,
    times: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Why the naive count exceeds the ordered one, per step.

    Every user of the naive count falls into one class: ``counted`` (in order and in time),
    ``out_of_window`` (in order, too late) or ``out_of_order`` (an earlier step is missing or
    came later).
    """
    rows = _both_counts(
        events, steps, window_hours, window_from, filters, by, users, times, rows_per_task, False
    )
    return rows.select(
        *by,
        "step_index",
        "step_name",
        F.col("naive").alias("users_naive"),
        F.col("users").alias("counted"),
        F.expr("ordered - users AS out_of_window"),
        F.expr("naive - ordered AS out_of_order"),
    ).orderBy(*by, "step_index")
