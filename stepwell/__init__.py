"""Cohort retention and conversion funnels on Spark DataFrames."""

from .operators.cubes import funnel_cube, retention_cube, with_levels, write_cube
from .operators.durations import (
    duration_quantiles,
    duration_sketches,
    funnel_quantiles,
    merge_durations,
)
from .operators.filters import apply_filters, distinct_values
from .operators.first_events import (
    add_first_events,
    compact_first_events,
    first_events,
    forget_first_events,
    read_first_events,
)
from .operators.funnel import (
    compare,
    funnel,
    funnel_from_times,
    naive_funnel,
    overcount_reasons,
    step_times,
)
from .operators.quality import did_without, event_histogram, event_quality, late_activators
from .operators.reports import for_display, kpi_row
from .operators.retention import (
    as_matrix,
    blended_curve,
    cohort_sizes,
    retention,
    with_confidence,
)
from .operators.segments import cohort_contrast, mix_shift, segment_mix, segment_summary
from .operators.user_sets import cohort_cube, naive_funnel_cube, number_users, user_sets
from .session import get_spark
from .sources.schema import EVENT_SCHEMA, FILTERABLE, events_from_rows, to_events
from .operators.users import distinct_attribute
from .plans.scratch import clear_scratch
from .sources.tables import (
    add_events,
    build_bucketed_table,
    build_event_table,
    load_event_table,
    open_bucketed_table,
    open_event_table,
)
from .streaming.first_events import stream_first_events

__version__ = "0.1.0"

__all__ = [
    "EVENT_SCHEMA",
    "FILTERABLE",
    "add_events",
    "add_first_events",
    "apply_filters",
    "as_matrix",
    "blended_curve",
    "build_bucketed_table",
    "build_event_table",
    "clear_scratch",
    "cohort_contrast",
    "cohort_cube",
    "cohort_sizes",
    "compact_first_events",
    "compare",
    "did_without",
    "distinct_attribute",
    "distinct_values",
    "duration_quantiles",
    "duration_sketches",
    "event_histogram",
    "event_quality",
    "events_from_rows",
    "first_events",
    "forget_first_events",
    "for_display",
    "funnel",
    "funnel_cube",
    "funnel_from_times",
    "funnel_quantiles",
    "get_spark",
    "kpi_row",
    "late_activators",
    "load_event_table",
    "merge_durations",
    "mix_shift",
    "naive_funnel",
    "naive_funnel_cube",
    "number_users",
    "open_bucketed_table",
    "open_event_table",
    "overcount_reasons",
    "read_first_events",
    "retention",
    "retention_cube",
    "segment_mix",
    "segment_summary",
    "step_times",
    "stream_first_events",
    "to_events",
    "user_sets",
    "with_confidence",
    "with_levels",
    "write_cube",
]
