"""Column -> Column scalar functions: dates, times, durations, labels.

All are built from ``pyspark.sql.functions`` so they stay JVM-side, inside
whole-stage codegen, and are null-safe under ANSI mode (``try_*`` / ``get``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogue import SECONDS_PER_MONTH_APPROX, SECONDS_PER_YEAR_APPROX

# Text layout of boundary datetimes in result rows: the parser emits an
# unpadded month and day with a padded clock time (e.g. ``2022-10-6 03:14:15``).
BOUNDARY_TEXT_FORMAT = "yyyy-M-d HH:mm:ss"
# Layout of ``SYSTEM IPLED`` datetimes, rebuilt from MM/DD/YYYY and HH.MM.SS.
IPLED_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- C6 / C7 / C8
def julian_to_date(col) -> Column:
    """``YYYYDDD`` or ``YYDDD`` (century 20) -> DATE; NULL when invalid."""
    full = F.regexp_replace(F.trim(_c(col)), "^([0-9]{5})$", "20$1")
    seven = F.regexp_extract(full, "^([0-9]{7})$", 1)
    return F.to_date(F.try_to_timestamp(seven, F.lit("yyyyDDD")))


def normalize_time(col) -> Column:
    """``HH:MM:SS.ff`` or ``HHMMSSth`` -> ``HH:MM:SS`` text (NULL stays NULL)."""
    c = _c(col)
    with_colons = F.regexp_replace(c, "^([^:]*):([^:]*):?([^:.]*).*$", "$1:$2:$3")
    packed = F.regexp_replace(c, "^(.{0,2})(.{0,2})(.{0,2}).*$", "$1:$2:$3")
    return F.when(c.contains(":"), with_colons).otherwise(packed)


def event_timestamp(date_col, time_col) -> Column:
    """DATE + ``HH:MM:SS`` text -> TIMESTAMP (NULL when either is missing/invalid)."""
    d = _c(date_col)
    t = _c(time_col)
    text = F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), t)
    return F.when(d.isNotNull() & t.isNotNull(),
                  F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:m:s")))


def ipled_timestamp(time_word, date_word) -> Column:
    """``HH.MM.SS`` and ``MM/DD/YYYY`` words of a SYSTEM IPLED line -> TIMESTAMP."""
    text = F.concat_ws(" ", _c(date_word), _c(time_word))
    return F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH.mm.ss"))


# ----------------------------------------------------------------------- D2
def parse_datetime_text(col) -> Column:
    """Parse ``%Y-%m-%d %H:%M:%S`` text like Python's strptime: 1- or 2-digit
    fields, 4-digit year, runs of inner blanks allowed, nothing else around."""
    c = _c(col)
    collapsed = F.regexp_replace(c, "(\\S)\\s+(\\S)", "$1 $2")
    return F.try_to_timestamp(collapsed, F.lit("yyyy-M-d H:m:s"))


def is_datetime(col) -> Column:
    """Non-null and parses as ``%Y-%m-%d %H:%M:%S`` (never NULL itself)."""
    return F.coalesce(parse_datetime_text(col).isNotNull(), F.lit(False))


# ------------------------------------------------------------------ J1 / J2
def elapsed_seconds(start, end) -> Column:
    """Exact seconds end - start of two TIMESTAMPs (NULL if either NULL)."""
    return F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))


def calendar_epoch(ts) -> Column:
    """J2 helper: pseudo-epoch (y-1970)*31557600 + m*2629800 + d*86400 + h*3600 + min*60 + s."""
    t = _c(ts)
    return ((F.year(t) - 1970).cast("bigint") * SECONDS_PER_YEAR_APPROX
            + F.month(t).cast("bigint") * SECONDS_PER_MONTH_APPROX
            + F.dayofmonth(t).cast("bigint") * 86400
            + F.hour(t).cast("bigint") * 3600
            + F.minute(t).cast("bigint") * 60
            + F.second(t).cast("bigint"))


def elapsed_calendar_approx(start, end) -> Column:
    """Approximate elapsed seconds by the calendar pseudo-epoch.  Wrong
    across month ends (kept only as a parity option, never the default)."""
    return calendar_epoch(end) - calendar_epoch(start)


# ------------------------------------------------------------- J3 / J4 / J5
def format_hms(seconds) -> Column:
    """Seconds -> ``HH:MM:SS``, hours unbounded; negative n -> ``00:00:n``."""
    n = _c(seconds).cast("bigint")
    positive = F.format_string("%02d:%02d:%02d", F.floor(n / 3600).cast("bigint"),
                               F.floor((n % 3600) / 60).cast("bigint"), n % 60)
    return F.when(n.isNull(), F.lit(None).cast("string")) \
        .when(n < 0, F.concat(F.lit("00:00:"), n.cast("string"))) \
        .otherwise(positive)


def format_hms_floor(seconds) -> Column:
    """Floor-division variant: -5 -> ``-1:59:55``."""
    n = _c(seconds).cast("bigint")
    h = F.floor(n / 3600).cast("bigint")
    rem = F.pmod(n, F.lit(3600).cast("bigint"))
    return F.when(n.isNotNull(), F.format_string(
        "%02d:%02d:%02d", h, F.floor(rem / 60).cast("bigint"),
        F.pmod(rem, F.lit(60).cast("bigint"))))


def format_days(seconds) -> Column:
    """``[ d day(s), h hour(s), m minute(s), s second(s) ]``; a negative
    span keeps the whole (negative) count in the seconds slot."""
    n = _c(seconds).cast("bigint")
    pos = n >= 0
    d = F.when(pos, F.floor(n / 86400)).otherwise(0).cast("bigint")
    h = F.when(pos, F.floor((n % 86400) / 3600)).otherwise(0).cast("bigint")
    m = F.when(pos, F.floor((n % 3600) / 60)).otherwise(0).cast("bigint")
    s = F.when(pos, n % 60).otherwise(n).cast("bigint")
    return F.when(n.isNotNull(), F.format_string(
        "[ %d day(s), %d hour(s), %d minute(s), %d second(s) ]", d, h, m, s))


# ---------------------------------------------------------------- C10 / C11
def ipl_date_label(ts) -> Column:
    """C11: ``Jan 12, 2023`` label of a TIMESTAMP."""
    return F.date_format(_c(ts), "MMM dd, yyyy")


def boundary_text(ts) -> Column:
    """TIMESTAMP -> boundary text as the parser writes it (``2022-10-6 03:14:15``)."""
    return F.date_format(_c(ts), BOUNDARY_TEXT_FORMAT)


def ipled_text(ts) -> Column:
    """TIMESTAMP -> SYSTEM IPLED text (``2022-10-05 03:14:15``)."""
    return F.date_format(_c(ts), IPLED_TEXT_FORMAT)


def dataset_name(system, file_name) -> Column:
    """``<system>_<dataset>`` with the ``.CSV`` suffix removed."""
    return F.regexp_replace(F.concat_ws("_", _c(system), _c(file_name)), "\\.CSV$", "")


def short_host(hostname) -> Column:
    """Lower-cased host name up to the first dot."""
    return F.lower(F.substring_index(_c(hostname), ".", 1))
