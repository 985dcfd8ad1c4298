"""Breakdowns of retention by segment and by groups of cohorts.

All of these are small aggregations over the long result of ``retention(..., by=[segment])``,
so one pass over the events serves every segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retention import blended_curve


def segment_summary(
    long: DataFrame, segment: str, periods: Sequence[int] = (1, 2)
) -> DataFrame:
    """One row per segment: signups and the blended retention at the given periods."""
    curve = blended_curve(long, by=[segment])
    return (
        curve.groupBy(segment)
        .agg(
            F.max(F.when(F.col("period_index") == 0, F.col("users"))).alias("signups"),
            *[
                F.max(F.when(F.col("period_index") == k, F.col("retention"))).alias(f"period_{k}")
                for k in periods
            ],
        )
        .orderBy(segment)
    )


def cohort_contrast(long: DataFrame, label: Column) -> DataFrame:
    """Blended curve per label; ``label`` maps ``cohort_period`` to a group of cohorts."""
    return blended_curve(long.withColumn("cohort_group", label), by=["cohort_group"])


def segment_mix(long: DataFrame, segment: str) -> DataFrame:
    """Signups and share of each segment within each cohort."""
    cohort = Window.partitionBy("cohort_period")
    return (
        long.groupBy("cohort_period", segment)
        .agg(F.max("cohort_size").alias("signups"))
        .withColumn("share", F.col("signups") / F.sum("signups").over(cohort))
        .orderBy("cohort_period", segment)
    )


def mix_shift(long: DataFrame, segment: str, in_target: Column, period_index: int = 1) -> DataFrame:
    """Split the retention gap between two groups of cohorts into mix and rate.

    ``in_target`` tells target cohorts from baseline cohorts. Over all segments, ``mix_effect``
    (the segment shares moved) plus ``rate_effect`` (the segments' own rates moved) is the
    difference of the blended rates. A segment missing on one side moves the mix only.
    """
    cells = long.filter(F.col("observed") & (F.col("period_index") == period_index))

    def total(column: str, side: Column) -> Column:
        return F.sum(F.when(side, F.col(column)).otherwise(F.lit(0)))

    sides = {"base": ~in_target, "target": in_target}
    sums = cells.groupBy(segment).agg(
        *[total("cohort_size", side).alias(f"users_{name}") for name, side in sides.items()],
        *[total("active_users", side).alias(f"active_{name}") for name, side in sides.items()],
    )
    everyone = Window.partitionBy()  # one row per segment value here
    for name in sides:
        users, all_users = F.col(f"users_{name}"), F.sum(f"users_{name}").over(everyone)
        sums = sums.withColumn(
            f"share_{name}", F.when(all_users > 0, users / all_users)
        ).withColumn(f"rate_{name}", F.when(users > 0, F.col(f"active_{name}") / users))
    rate_base = F.coalesce("rate_base", "rate_target")
    rate_target = F.coalesce("rate_target", "rate_base")
    return sums.select(
        segment,
        "share_base",
        "share_target",
        "rate_base",
        "rate_target",
        ((F.col("share_target") - F.col("share_base")) * rate_base).alias("mix_effect"),
        (F.col("share_target") * (rate_target - rate_base)).alias("rate_effect"),
    ).orderBy(segment)
