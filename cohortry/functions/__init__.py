"""Column expressions: numbers, text, dates, bands and derived measures. All built-in, no UDFs."""

from cohortry.functions.bands import (
    Band,
    at_least,
    band,
    band_by,
    band_gaps,
    below,
    between,
    bin_label,
    bin_start,
    bucket_label,
    bucket_number,
    within_limits,
)
from cohortry.functions.dates import (
    age_on,
    birth_year,
    date_text,
    decade_label,
    hour_between,
    in_month,
    in_period,
    in_year,
    is_leap_birth,
    month_name,
    time_text,
    time_text_12h,
    timestamp_text,
    week_label,
)
from cohortry.functions.measures import (
    distance_per_minute,
    feet_and_inches,
    mean_arterial_pressure,
    weight_from_bmi,
)
from cohortry.functions.numbers import cents, decimal_mean, exact_mean, exact_sum, mean, percent, ratio, round_half_up
from cohortry.functions.text import (
    concat_null,
    concat_skip_null,
    csv_line,
    derived_id,
    failed_names,
    full_name,
    id_number,
    map_label,
    prefixed,
)

__all__ = [
    "Band", "age_on", "at_least", "band", "band_by", "band_gaps", "below", "between", "bin_label", "bin_start",
    "birth_year", "bucket_label", "bucket_number", "cents", "concat_null", "concat_skip_null", "csv_line",
    "date_text", "decade_label", "decimal_mean", "derived_id", "distance_per_minute", "exact_mean", "exact_sum",
    "failed_names", "feet_and_inches", "full_name", "hour_between", "id_number", "in_month", "in_period",
    "in_year", "is_leap_birth", "map_label", "mean", "mean_arterial_pressure", "month_name", "percent",
    "prefixed", "ratio", "round_half_up", "time_text", "time_text_12h", "timestamp_text", "week_label", "weight_from_bmi",
    "within_limits",
]
