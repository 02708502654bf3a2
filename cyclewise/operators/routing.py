"""Routing of resume rows to result tables, idempotent ingest and dedupe.

D3-D6 route rows, E1-E3 keep only unseen datasets (anti/semi joins, never a
driver-side key list), F6-F9/F12 dedupe.  One routing rule partitions all
rows (done / fail / garbage / last_ipl); the three historical variants are
available through ``rule=``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import ipl_date_label, is_datetime, parse_datetime_text
from ..schemas import DONE_COLUMNS, FAIL_COLUMNS, LAST_IPL_COLUMNS
from .resume import SPANS, phase_durations

FOUR = ["shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end"]
RULES = ("unified", "spark", "pandas", "refactor")


def _nonempty(c: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))


def _all(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def _any(cols) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def done_condition() -> Column:
    """D3: all four boundaries are valid datetimes."""
    return _all([is_datetime(c) for c in FOUR])


def fail_condition(rule: str = "unified") -> Column:
    """D4 under each rule (see module doc)."""
    some_invalid = ~done_condition()
    if rule == "spark":
        return some_invalid & ~is_datetime("last_ipl")
    if rule == "pandas":
        return some_invalid
    # unified / refactor: any invalid and at least one of the four non-empty
    return some_invalid & _any([_nonempty(c) for c in FOUR])


def garbage_condition(rule: str = "unified") -> Column:
    """D5 under each rule."""
    none_set = ~_any([_nonempty(c) for c in FOUR])
    if rule == "pandas":
        return F.lit(False)          # unreachable in that variant
    if rule == "spark":
        return F.lit(False)          # that variant has no garbage sink
    if rule == "refactor":
        return none_set
    return none_set & ~is_datetime("last_ipl")


def last_ipl_condition(rule: str = "unified") -> Column:
    """last_ipl valid (unified: only for rows with no boundary at all)."""
    if rule == "unified":
        return ~_any([_nonempty(c) for c in FOUR]) & is_datetime("last_ipl")
    return is_datetime("last_ipl")


def route(resume: DataFrame, rule: str = "unified") -> DataFrame:
    """Add ``route`` in {done, fail, garbage, last_ipl} (unified rule: a
    partition of all rows)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    r = (F.when(done_condition(), "done")
         .when(fail_condition(rule), "fail")
         .when(garbage_condition(rule), "garbage")
         .when(last_ipl_condition(rule), "last_ipl"))
    return resume.withColumn("route", r)


def done_rows(resume: DataFrame) -> DataFrame:
    """D3 + J6 + C11: rows for ``results_done`` (durations exact, J1)."""
    typed = resume.filter(done_condition()).withColumns({f"{c}_ts": parse_datetime_text(c) for c in FOUR})
    return phase_durations(typed).select(
        "sysname", ipl_date_label("shutdown_begin_ts").alias("ipl_date"), "log_dataset", *FOUR, "pre_ipl",
        F.col("post_ipl").alias("pos_ipl"), *[name for name, _, _ in SPANS]).select(*DONE_COLUMNS)


def _boundary_rows(resume: DataFrame, cond: Column) -> DataFrame:
    return (resume.filter(cond)
            .select("sysname", "log_dataset", *FOUR, "pre_ipl",
                    F.col("post_ipl").alias("pos_ipl"))
            .select(*FAIL_COLUMNS))


def fail_rows(resume: DataFrame, rule: str = "unified") -> DataFrame:
    """Rows for ``results_fail``."""
    return _boundary_rows(resume, fail_condition(rule))


def garbage_rows(resume: DataFrame, rule: str = "unified") -> DataFrame:
    """Rows for ``results_garb``."""
    return _boundary_rows(resume, garbage_condition(rule))


def last_ipl_rows(resume: DataFrame, rule: str = "unified") -> DataFrame:
    """Rows for ``results_last_ipl``."""
    return resume.filter(last_ipl_condition(rule)).select(*LAST_IPL_COLUMNS)


# ------------------------------------------------------------- E1 / E2 / E3
def same_key(a: DataFrame, b: DataFrame, keys=("sysname", "log_dataset")) -> Column:
    """Null-safe equality of the key columns."""
    return _all([a[k].eqNullSafe(b[k]) for k in keys])


def unseen_rows(new: DataFrame, known: DataFrame, key="log_dataset") -> DataFrame:
    """Rows of ``new`` whose key (one column or several) is not in
    ``known``, each row once.

    A left-anti join on the key: the known side is projected to its distinct
    keys first (partial aggregation before the shuffle); AQE turns the join
    into a broadcast only when the measured key set is small.  NULL keys are
    equal to each other.  Q8: rows of one batch that repeat exactly are stored once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    seen = known.select(*keys).distinct()
    return new.join(seen, same_key(new, seen, keys), "left_anti").dropDuplicates()


def rows_for_systems(raw: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Raw rows of the systems that received new data (left-semi join; a
    missing system name is a system of its own)."""
    systems = new_rows.select("sysname").distinct()
    return raw.join(systems, same_key(raw, systems, ["sysname"]), "left_semi")


RAW_SCAN_COLUMNS = ["sysname", "log_dataset", "shutdown_begin", "shutdown_end",
                    "ipl_begin", "ipl_end", "last_ipl", "pre_ipl", "post_ipl"]


def scan_raw_results(raw: DataFrame, systems=None) -> DataFrame:
    """The nine columns of raw results, for a list of systems or all."""
    out = raw.select(*RAW_SCAN_COLUMNS)
    if systems is not None:
        if isinstance(systems, DataFrame):
            out = rows_for_systems(out, systems)
        else:
            out = out.filter(F.col("sysname").isin(list(systems)))
    return out


# --------------------------------------------------------------- F6-F9 / F12
def dedupe_rows(frame: DataFrame) -> DataFrame:
    """whole-row duplicate removal."""
    return frame.dropDuplicates()


def dedupe_last_ipl(last: DataFrame) -> DataFrame:
    """one row per (sysname, last_ipl), keeping the smallest dataset name."""
    return (last.groupBy("sysname", "last_ipl")
            .agg(F.min("log_dataset").alias("log_dataset"))
            .select(*LAST_IPL_COLUMNS))


def distinct_datasets(frame: DataFrame) -> DataFrame:
    """F8."""
    return frame.select("log_dataset").distinct()


def distinct_systems(frame: DataFrame) -> DataFrame:
    """F9."""
    return frame.select("sysname").distinct()


def distinct_last_ipl(frame: DataFrame) -> DataFrame:
    """F12."""
    return frame.select(*LAST_IPL_COLUMNS).distinct()


def route_counts(resume: DataFrame, rule: str = "unified") -> DataFrame:
    """Rows per route (partial aggregation)."""
    return route(resume, rule).groupBy("route").agg(F.count(F.lit(1)).alias("n_rows"))
