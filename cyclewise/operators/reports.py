"""Reports over the result tables: C12-C15, D12, H1, H3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DONE_COLUMNS, FAIL_COLUMNS
from .routing import dedupe_last_ipl

DATETIME_COLUMNS = {"shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end",
                    "pre_ipl", "pos_ipl", "last_ipl"}


def report_done(done: DataFrame) -> DataFrame:
    """The done view's columns."""
    return done.select(*DONE_COLUMNS)


def report_fail(fail: DataFrame) -> DataFrame:
    """C13."""
    return fail.select(*FAIL_COLUMNS)


def report_last_ipl(last: DataFrame) -> DataFrame:
    """C14: (sysname, last_ipl), one row per pair."""
    return dedupe_last_ipl(last).select("sysname", "last_ipl")


def _displayed(c: str) -> Column:
    """A report's cell as it is shown."""
    if c == "sysname":
        return F.upper(F.coalesce(F.col(c), F.lit("")))
    if c in DATETIME_COLUMNS:
        return F.coalesce(F.expr(f"right({c}, 8)"), F.lit(""))
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def report_format(report: DataFrame) -> DataFrame:
    """System upper-cased, datetimes shown as their last 8 characters
    (the clock time), missing values as ''.  Durations are not cut (Q14)."""
    return report.select(*[_displayed(c).alias(c) for c in report.columns])


def report_search(report: DataFrame, pattern: str, displayed: bool = False) -> DataFrame:
    """Case-insensitive regex search over all columns (``displayed``: as ``report_format`` shows them)."""
    text = F.concat_ws(" ", *[_displayed(c) if displayed else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns])
    return report.filter(text.rlike("(?i)" + pattern))


def sort_last_ipl(last: DataFrame) -> DataFrame:
    """H1."""
    return last.orderBy("sysname", "last_ipl")


def page(report: DataFrame, order_cols, page_size: int, after=None) -> DataFrame:
    """H3: the page that follows the key ``after`` (values of ``order_cols`` of
    the last row seen; None for the first page) in a total order, NULL before any value; ``order_cols``
    must form a unique key.  A page of any depth costs one filter
    and a top-``page_size``, no offset is held by a task.  The first column alone bounds the
    filter, so files sorted by it leave out row groups before the page."""
    if after is not None:
        beyond = F.lit(False)
        for k in reversed(range(len(order_cols))):
            c, v = F.col(order_cols[k]), after[k]
            more = c.isNotNull() if v is None else c > F.lit(v)
            beyond = more | (c.eqNullSafe(F.lit(v)) & beyond)
        if after[0] is not None:
            report = report.filter(F.col(order_cols[0]) >= F.lit(after[0]))
        report = report.filter(F.coalesce(beyond, F.lit(False)))
    return report.orderBy(*[F.col(c).asc_nulls_first() for c in order_cols]).limit(page_size)
