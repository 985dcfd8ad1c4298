"""Results as people read them: headline figures, rounded numbers, percentages, dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retention import blended_curve


def kpi_row(funnel_rows: DataFrame, long: DataFrame) -> DataFrame:
    """entered, converted, end_to_end_conversion, period_1_retention.

    Takes the results of ``funnel`` and ``retention`` (no segments). The conversion is 0.0
    when nobody entered; the retention is NULL when no cohort has been seen for a period.
    """
    ends = funnel_rows.agg(
        F.max(F.when(F.col("step_index") == 0, F.col("users"))).alias("entered"),
        F.max_by("users", "step_index").alias("converted"),
        F.max_by("overall_conversion", "step_index").alias("end_to_end_conversion"),
    )
    first_period = (
        blended_curve(long)
        .filter(F.col("period_index") == 1)
        .agg(F.max("retention").alias("period_1_retention"))
    )
    names = [*ends.columns, *first_period.columns]
    return ends.unionByName(first_period, allowMissingColumns=True).agg(
        *[F.max(name).alias(name) for name in names]
    )


def for_display(
    result: DataFrame,
    *,
    digits: Mapping[str, int] | None = None,
    percent: Mapping[str, int] | None = None,
    dates: Sequence[str] = (),
) -> DataFrame:
    """Round, format as percentages and cut times to dates; other columns stay as they are.

    ``digits`` and ``percent`` map a column to its decimals. Halves go to the even neighbour.
    """
    shown = {name: F.bround(name, n) for name, n in (digits or {}).items()}
    for name, n in (percent or {}).items():
        number = F.format_number(F.col(name) * 100, n)
        shown[name] = F.concat(F.replace(number, F.lit(","), F.lit("")), F.lit("%"))
    for name in dates:
        shown[name] = F.col(name).cast("date").cast("string")
    return result.withColumns(shown)
