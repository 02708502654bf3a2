"""Resume rows (F4) and phase durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import (boundary_text, elapsed_calendar_approx,
                                 elapsed_seconds, format_hms, ipled_text)
from ..schemas import RESUME_COLUMNS

# (column, start boundary, end boundary) of the resume's elapsed columns
PHASES = [
    ("elapsed_before_shutdown", "pre_ipl_ts", "shutdown_begin_ts"),
    ("elapsed_after_shutdown", "shutdown_begin_ts", "shutdown_end_ts"),
    ("elapsed_btn_shut_ipl", "shutdown_end_ts", "ipl_begin_ts"),
    ("elapsed_ipl", "ipl_begin_ts", "ipl_end_ts"),
    ("elapsed_after_ipl", "ipl_end_ts", "post_ipl_ts"),
    ("total_elapsed", "pre_ipl_ts", "post_ipl_ts"),
]

# (duration, start boundary, end boundary)
SPANS = [("shutdown_duration", "shutdown_begin_ts", "shutdown_end_ts"),
         ("poweroff_duration", "shutdown_end_ts", "ipl_begin_ts"),
         ("load_ipl", "ipl_begin_ts", "ipl_end_ts"),
         ("total_duration", "shutdown_begin_ts", "ipl_end_ts")]

SIX = ["pre_ipl_ts", "shutdown_begin_ts", "shutdown_end_ts", "ipl_begin_ts",
       "ipl_end_ts", "post_ipl_ts"]


def _elapsed(start: str, end: str, mode: str) -> Column:
    if mode == "calendar":
        return elapsed_calendar_approx(start, end)
    return elapsed_seconds(start, end)


def resume_rows(boundaries: DataFrame, mode: str = "exact") -> DataFrame:
    """F4 + J7: one 15-column text row per dataset.

    When any of the six boundaries is set they are emitted with their elapsed
    times and ``last_ipl`` stays empty; otherwise only ``last_ipl`` (possibly
    empty).  ``mode='calendar'`` uses the pseudo-epoch (J2) for parity.
    """
    any_set = F.lit(False)
    for c in SIX:
        any_set = any_set | F.col(c).isNotNull()
    cols = [F.col("sysname"), F.col("log_dataset")]
    for c in SIX:
        cols.append(boundary_text(c).alias(c[:-3]))
    cols.append(F.when(~any_set, ipled_text("last_ipl_ts")).alias("last_ipl"))
    for name, s, e in PHASES:
        cols.append(format_hms(_elapsed(s, e, mode)).alias(name))
    out = boundaries.select(*cols)
    return out.select(*RESUME_COLUMNS)


def phase_durations(frame: DataFrame) -> DataFrame:
    """Shutdown / poweroff / load / total durations of typed boundaries.

    Adds ``*_seconds`` (BIGINT) and the formatted ``HH:MM:SS`` text.
    """
    timed = frame.withColumns({f"{name}_seconds": elapsed_seconds(s, e) for name, s, e in SPANS})
    return timed.withColumns({name: format_hms(f"{name}_seconds") for name, _, _ in SPANS})
