"""The checks, alerts and visit counts as Structured Streaming jobs."""

from cohortry.streaming.jobs import (
    alert_stream,
    check_key_stream,
    count_windows,
    keep_totals,
    run_to_table,
    run_validation,
    running_mean_stream,
    sketch_days,
    users_per_window,
    visits_per_window,
    with_event_time,
)

__all__ = [
    "alert_stream", "check_key_stream", "count_windows", "keep_totals", "run_to_table", "run_validation", "running_mean_stream", "sketch_days",
    "users_per_window", "visits_per_window", "with_event_time",
]
