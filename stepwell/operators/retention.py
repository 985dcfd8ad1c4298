"""Cohort retention.

One scan and no join: events collapse to one row per (user, period) before the first
shuffle, each user's cohort is the earliest period with an anchor event, and cohort sizes,
active users and the reporting horizon all come from the same rows.

    cohort           period of the user's first anchor event
    active in k      any activity event during the k-th period after the cohort period
    observed         period k lies within the table's last period; NULL beyond it, never 0
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import wilson_bound
from ..functions.time import period_start, periods_between
from .filters import Filters
from .users import attributes_of, filter_users, with_attributes
from .validation import check_choice, check_retention

# How a return counts, and over what the last seen period is taken.
RETURN_RULES = ("unbounded", "consecutive")
HORIZONS = ("segment", "global")


def user_periods(
    events: DataFrame,
    *,
    period: str,
    signup_event: str,
    activity_event: str,
    by: Sequence[str],
    keep_users: bool = False,
) -> DataFrame:
    """One row per (segment, user, period) with the flags ``anchored`` and ``active``.

    Events of other names, and of no user, matter for the horizon only. They lose their user
    here, so each task folds them into one row per period before the shuffle; with ``keep_users``
    they keep it, to be told apart by its attributes, and fold to one row per user and period.
    """
    name = F.col("event_name")
    relevant = name.isin(signup_event, activity_event) & F.col("user_id").isNotNull()
    return (
        events.select(
            *by,
            relevant.alias("relevant"),
            F.when(relevant | F.lit(keep_users), F.col("user_id")).alias("user_id"),
            period_start(F.col("event_ts"), period).alias("period"),
            (relevant & (name == signup_event)).alias("is_anchor"),
            (relevant & (name == activity_event)).alias("is_activity"),
        )
        .groupBy(*by, "relevant", "user_id", "period")
        .agg(F.max("is_anchor").alias("anchored"), F.max("is_activity").alias("active"))
    )


def retention(
    events: DataFrame,
    *,
    period: str = "week",
    signup_event: str = "signup",
    activity_event: str = "lesson_start",
    max_periods: int = 8,
    filters: Filters = None,
    by: Sequence[str] = (),
    users: DataFrame | None = None,
    horizon: str = "segment",
    returns: str = "unbounded",
) -> DataFrame:
    """One row per (cohort, period_index) for 0 .. ``max_periods`` inclusive.

    Columns: ``by``..., cohort_period, cohort_size, period_index, observed, active_users,
    retention. With ``by``, every segment equals a call filtered to it; ``horizon="global"``
    takes the last period over all segments instead. ``returns="consecutive"`` counts a user
    in period k only when active in every period 0 .. k. ``filters`` and ``by`` may name attributes
    of ``users`` (see ``operators.users``), which join one row per user and period.
    """
    check_retention(period, max_periods)
    check_choice("horizon", horizon, HORIZONS)
    check_choice("returns", returns, RETURN_RULES)
    by = list(by)
    attributes = attributes_of(events, by, users)
    base, users, _ = filter_users(events, filters, users)
    periods = user_periods(
        base,
        period=period,
        signup_event=signup_event,
        activity_event=activity_event,
        by=[c for c in by if c not in attributes],
        keep_users=bool(attributes),
    )
    cells = _cohort_cells(with_attributes(periods, users, attributes), by, period, returns)
    return retention_of_cells(cells, by, period, max_periods, horizon)


def retention_of_cells(
    cells: DataFrame, by: Sequence[str], period: str, max_periods: int, horizon: str
) -> DataFrame:
    """The result of :func:`retention` from counted cells: ``by``..., cohort, period, starters
    and active, one row for each. Cells with a NULL cohort count for the horizon only."""
    by = list(by)
    k = periods_between(F.col("cohort"), F.col("period"), period)
    in_spine = k.between(0, max_periods)
    per_cohort = cells.groupBy(*by, "cohort").agg(
        F.sum("starters").alias("cohort_size"),
        F.max("period").alias("last_period"),
        F.map_from_entries(
            F.collect_list(F.when(in_spine, F.struct(k.alias("k"), F.col("active"))))
        ).alias("active_by_k"),
    )
    # one row per (segment, cohort): the newest period of all is found without another scan
    scope = Window.partitionBy(*by) if horizon == "segment" else Window.partitionBy()
    last_seen = F.max("last_period").over(scope)

    spine = (
        per_cohort.withColumn("last_seen", last_seen)
        .filter(F.col("cohort").isNotNull())
        .withColumn("periods_seen", periods_between(F.col("cohort"), F.col("last_seen"), period))
        .withColumn(
            "period_index",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_periods).cast("long"))),
        )
    )
    observed = F.col("period_index") <= F.col("periods_seen")
    active = F.coalesce(
        F.try_element_at("active_by_k", F.col("period_index")), F.lit(0).cast("long")
    )
    return spine.select(
        *by,
        F.col("cohort").cast("timestamp_ntz").alias("cohort_period"),
        "cohort_size",
        "period_index",
        observed.alias("observed"),
        F.when(observed, active).alias("active_users"),
        F.when(observed, active / F.col("cohort_size")).alias("retention"),
    ).orderBy(*by, "cohort_period", "period_index")


def _cohort_cells(periods: DataFrame, by: list[str], period: str, returns: str) -> DataFrame:
    """(segment, cohort, period) -> ``starters`` and ``active`` users.

    A user's window holds one row per calendar period, so it stays short for any user. The
    group with a NULL cohort (users without an anchor, events of other names) is kept: its
    periods count for the horizon.
    """
    # The user first: rows are sorted by the first key's leading bytes, and flags or segment
    # names would leave nearly all of them tied.
    user = Window.partitionBy("user_id", *by, "relevant")
    cohort = F.min(F.when(F.col("anchored"), F.col("period"))).over(user)
    users = periods.withColumn("cohort", cohort)
    counts = F.col("active")
    if returns == "consecutive":
        since_anchor = F.when(F.col("active") & (F.col("period") >= F.col("cohort")), 1)
        so_far = user.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        users = users.withColumn("streak", F.count(since_anchor).over(so_far))
        k = periods_between(F.col("cohort"), F.col("period"), period)
        counts = counts & (F.col("streak") == k + 1)
    return users.groupBy(*by, "cohort", "period").agg(
        F.count(F.when(F.col("period") == F.col("cohort"), 1)).alias("starters"),
        F.count(F.when(counts, 1)).alias("active"),
    )


def as_matrix(
    long: DataFrame,
    value: str = "retention",
    *,
    max_periods: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cohorts down, periods 0 .. ``max_periods`` across (columns named "0", "1", ...).

    ``max_periods`` spells the columns out, which spares a job to look up the last period; a
    period beyond it is an error, never left out.
    """
    if max_periods is None:
        max_periods = long.agg(F.max("period_index")).head()[0] or 0
    beyond = F.raise_error(F.lit(f"as_matrix: there are periods beyond max_periods={max_periods}"))
    index = F.when(F.col("period_index") > max_periods, beyond.cast("long")).otherwise(
        F.col("period_index")
    )
    return (
        long.withColumn("period_index", index)
        .groupBy(*by, "cohort_period")
        .pivot("period_index", list(range(max_periods + 1)))
        .agg(F.first(value))
        .orderBy(*by, "cohort_period")
    )


def blended_curve(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size-weighted retention per period over the cohorts observed at that period.

    ``long`` is the result of :func:`retention`: one row per (segment, cohort, period).
    """
    return (
        long.filter("observed")
        .groupBy(*by, "period_index")
        .agg(
            F.countDistinct("cohort_period").alias("cohorts"),
            F.sum("cohort_size").alias("users"),
            F.sum("active_users").alias("active_users"),
        )
        .withColumn("retention", F.col("active_users") / F.col("users"))
        .orderBy(*by, "period_index")
    )


def cohort_sizes(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(cohort as yyyy-MM-dd, signups), one row per cohort."""
    return (
        long.groupBy(*by, F.col("cohort_period").cast("date").cast("string").alias("cohort"))
        .agg(F.max("cohort_size").alias("signups"))
        .orderBy(*by, "cohort")
    )


def with_confidence(long: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Add the Wilson score interval of every observed rate as ``ci_low`` and ``ci_high``."""
    ends = {"ci_low": False, "ci_high": True}
    return long.select(
        "*",
        *[
            F.expr(wilson_bound("active_users", "cohort_size", z, upper=upper)).alias(name)
            for name, upper in ends.items()
        ],
    )
