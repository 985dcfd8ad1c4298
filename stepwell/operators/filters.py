"""Row filters by an allowlisted column -> values mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import FILTERABLE

Filters = Mapping[str, Sequence[str]] | None


def dimensions(events: DataFrame) -> list[str]:
    """The canonical dimensions and every other text column a table declares, but the user."""
    own = [c for c, kind in events.dtypes if kind == "string" and c != "user_id"]
    return list(dict.fromkeys([*FILTERABLE, *own]))


def check_column(column: str, allowed: Sequence[str]) -> None:
    if column not in allowed:
        raise ValueError(
            f"Not a filterable column: {column!r}; choose from {', '.join(allowed)}"
        )


def apply_filters(
    events: DataFrame, filters: Filters, allowed: Sequence[str] | None = None
) -> DataFrame:
    """Keep rows whose value is listed, for every column named. An empty list is no filter.

    ``allowed`` narrows the columns; default: the :func:`dimensions` of the table.
    """
    allowed = dimensions(events) if allowed is None else allowed
    for column, values in (filters or {}).items():
        check_column(column, allowed)
        values = list(values)
        if values:
            events = events.filter(F.col(column).isin(values))
    return events


def distinct_values(
    events: DataFrame, column: str, allowed: Sequence[str] | None = None
) -> DataFrame:
    """The sorted distinct values of one filterable column."""
    check_column(column, dimensions(events) if allowed is None else allowed)
    return events.select(column).distinct().orderBy(column)
