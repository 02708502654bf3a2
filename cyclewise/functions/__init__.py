"""Column -> Column functions (dates, durations, labels) and the fixed catalogue."""

from .timefmt import (  # noqa: F401
    boundary_text, calendar_epoch, dataset_name, elapsed_calendar_approx,
    elapsed_seconds, event_timestamp, format_days, format_hms, format_hms_floor,
    ipl_date_label, ipled_text, ipled_timestamp, is_datetime, julian_to_date,
    normalize_time, parse_datetime_text, short_host,
)
