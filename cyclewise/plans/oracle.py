"""DuckDB SQL for each registered query (the driver's correctness oracle).

The SQL is an independent formulation: it reduces every dataset with a plain
window cascade over the whole dataset (no chunks), parses with list indexing
and regular expressions, and formats with ``strftime`` / ``printf``.
"""

from __future__ import annotations

from ..functions import catalogue as cat

W = "(PARTITION BY log_dataset ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _contains_any(tokens, col="line"):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in tokens) + ")"


def _w(i):
    """Word i (0-based) of the line, '' when missing."""
    return f"coalesce(w[{i + 1}], '')"


DIGITS = "'^[0-9]+$'"

BASE = f"""
ev AS (
  SELECT event_id, ts, 'SYS' || CAST(user_id % 5 AS VARCHAR) AS sysname, event_id % 40 AS k,
         CAST(floor(value) AS BIGINT) AS v, event_type,
         CAST((dayofyear(ts) - 1) // 7 AS BIGINT) AS wk
  FROM events),
msgs AS (
  SELECT *, sysname || '.' || CASE k WHEN 36 THEN 'G' WHEN 37 THEN 'S' WHEN 38 THEN 'L' WHEN 39 THEN 'P' ELSE '' END
      || 'W' || CAST(wk AS VARCHAR) AS log_dataset,
    CASE WHEN event_id % 41 = 3 THEN 'ZZ9' ELSE sysname END AS word,
    CASE WHEN event_id % 37 = 5 THEN strftime(ts, '%y%j') ELSE strftime(ts, '%Y%j') END AS day,
    CASE WHEN event_id % 43 = 9 THEN '99:99:99' ELSE strftime(ts, '%H:%M:%S') END AS clock,
    CASE WHEN k = 36 THEN 'IPLTRK01I START'
      WHEN k = 37 THEN 'TSO IS SHUTTING DOWN'
      WHEN k = 38 THEN 'SYSTEM IPLED'
      WHEN k = 39 THEN CASE WHEN (event_id // 40) % 2 = 0 THEN 'TSO IS SHUTTING DOWN' ELSE 'IEA371I PARMLIB' END
      WHEN event_id % 53 = 7 THEN 'ROUTINE MESSAGE'
      WHEN event_id % 97 = 11 THEN 'IEF237I JES2 ALLOCATED LVL' || CAST(v % 3 AS VARCHAR) || ' SYSLOG'
      ELSE CASE event_type
      WHEN 'error' THEN CASE WHEN v % 2 = 0 THEN 'TSO IS SHUTTING DOWN' ELSE 'DSI039I TASK ENDED' END
      WHEN 'view' THEN CASE v % 4 WHEN 0 THEN 'IXC371D CONFIRM' WHEN 1 THEN 'JES2 TERMINATION COMPLETE'
                                  WHEN 2 THEN 'Z EOD' ELSE 'HASP ABEND NOT FOUND' END
      WHEN 'click' THEN 'IEA371I PARMLIB'
      WHEN 'purchase' THEN CASE v % 3 WHEN 0 THEN 'HZS0103I CHECKS' WHEN 1 THEN 'S TN3270' ELSE 'IPLTRK02I DONE' END
      WHEN 'signup' THEN CASE v % 3 WHEN 0 THEN 'IPLTRK01I START' WHEN 1 THEN 'TSO LOGON' ELSE 'SYSTEM IPLED' END
    END END AS msg
  FROM ev),
syslog AS (
  SELECT log_dataset, sysname, wk, xor(event_id, 174763) AS line_no,
    CASE WHEN msg = 'SYSTEM IPLED'
           THEN 'D C000000 045 SYSTEM IPLED AT ' || strftime(ts, '%H.%M.%S') || ' ON ' || strftime(ts, '%m/%d/%Y')
         WHEN k = 36 THEN 'N ' || day || ' ' || msg
         WHEN event_id % 12 IN (0, 3, 6) THEN 'N 4000000 ' || word || ' ' || day || ' ' || clock || '.00 ' || msg
         WHEN event_id % 12 IN (1, 4, 7) THEN 'N ' || word || ' ' || day || ' ' || clock || '.00 ' || msg
         WHEN event_id % 12 = 8 THEN 'N ' || day || ' ' || replace(clock, ':', '') || '00 X R=1 ' || msg
         WHEN event_id % 12 = 9 THEN 'N ' || day || ' ' || msg
         WHEN event_id % 12 = 10 THEN 'N A ' || day || ' ' || replace(clock, ':', '') || '00 ' || msg
         WHEN event_id % 12 = 11 THEN msg
         ELSE 'N ' || day || ' ' || replace(clock, ':', '') || '00 ' || msg
    END AS line
  FROM msgs),
kept AS (
  SELECT *, string_split_regex(regexp_replace(line, '^[ \\t]+', ''), '[ \\t]+') AS w
  FROM syslog WHERE regexp_matches(line, '{cat.prefilter_regex()}')),
lay AS (
  SELECT *, CASE
      WHEN contains({_w(4)}, ':') THEN 1
      WHEN contains(line, 'SYSTEM IPLED') THEN 2
      WHEN contains({_w(3)}, ':') THEN 3
      WHEN contains({_w(4)}, 'R=') THEN 4
      WHEN regexp_matches({_w(1)}, {DIGITS}) AND regexp_matches({_w(2)}, {DIGITS}) THEN 5
      WHEN regexp_matches({_w(1)}, {DIGITS}) THEN 6
      WHEN regexp_matches({_w(2)}, {DIGITS}) AND regexp_matches({_w(3)}, {DIGITS}) THEN 7
      ELSE 8 END AS layout
  FROM kept),
raw AS (
  SELECT log_dataset, sysname, line_no AS log_id, layout, line, w,
    CASE layout WHEN 1 THEN {_w(3)} WHEN 3 THEN {_w(2)} WHEN 4 THEN {_w(1)} WHEN 5 THEN {_w(1)}
                WHEN 6 THEN {_w(1)} WHEN 7 THEN {_w(2)} END AS date_raw,
    CASE layout WHEN 1 THEN {_w(4)} WHEN 3 THEN {_w(3)} WHEN 4 THEN {_w(2)} WHEN 5 THEN {_w(2)}
                WHEN 7 THEN {_w(3)} END AS time_raw,
    CASE WHEN layout = 2 THEN 'SYSTEM IPLED' WHEN layout <> 8 THEN CASE
      WHEN {_contains_any(cat.SHUTDOWN_BEGIN_TOKENS)} THEN 'SHUTDOWN BEGIN'
      WHEN {_contains_any(cat.END_OF_SHUTDOWN_TOKENS)} OR (contains(line, 'JES3') AND contains({_w(7)}, 'IEF404I'))
        THEN 'END OF SHUTDOWN'
      WHEN {_contains_any(cat.IPL_BEGIN_TOKENS)} THEN 'IPL BEGIN'
      WHEN {_contains_any(cat.IPL_END_TOKENS)} THEN 'IPL END'
      WHEN {_contains_any(cat.PRE_IPL_TOKENS)} THEN 'PRE IPL'
      WHEN {_contains_any(cat.POST_IPL_TOKENS)} THEN 'POST IPL' END END AS type
  FROM lay
  WHERE (layout <> 1 OR contains({_w(2)}, sysname)) AND (layout <> 3 OR contains({_w(1)}, sysname))),
dt AS (
  SELECT *,
    CASE WHEN regexp_matches(regexp_replace(trim(date_raw), '^([0-9]{{5}})$', '20\\1'), '^[0-9]{{7}}$')
         THEN CAST(try_strptime(regexp_replace(trim(date_raw), '^([0-9]{{5}})$', '20\\1'), '%Y%j') AS DATE) END AS event_date,
    CASE WHEN time_raw IS NULL THEN NULL
         WHEN contains(time_raw, ':') THEN regexp_replace(time_raw, '^([^:]*):([^:]*):?([^:.]*).*$', '\\1:\\2:\\3')
         ELSE regexp_replace(time_raw, '^(.{{0,2}})(.{{0,2}})(.{{0,2}}).*$', '\\1:\\2:\\3') END AS event_time
  FROM raw),
detail AS (
  SELECT log_dataset, sysname, log_id, layout, date_raw, time_raw, event_date, event_time,
    CASE WHEN event_date IS NOT NULL AND event_time IS NOT NULL
         THEN try_strptime(strftime(event_date, '%Y-%m-%d') || ' ' || event_time, '%Y-%m-%d %H:%M:%S') END AS event_ts,
    type,
    CASE WHEN type IS NULL AND layout <> 8 AND {_contains_any(cat.ERROR_TOKENS)} THEN 'y' END AS error,
    CASE WHEN layout = 2 THEN try_strptime({_w(8)} || ' ' || {_w(6)}, '%m/%d/%Y %H.%M.%S') END AS last_ipl_ts,
    line AS msg
  FROM dt),
cls AS (SELECT * FROM detail WHERE type IS NOT NULL),
g1 AS (SELECT *, min(CASE WHEN type = 'SHUTDOWN BEGIN' AND event_ts IS NOT NULL THEN event_ts END) OVER {W} AS sb_run FROM cls),
g2 AS (SELECT *, CASE WHEN type = 'END OF SHUTDOWN' AND event_ts IS NOT NULL AND (sb_run IS NULL OR event_ts > sb_run)
                      THEN event_ts END AS se_x FROM g1),
g3 AS (SELECT *, min(se_x) OVER {W} AS se_run FROM g2),
g4 AS (SELECT *, CASE WHEN type = 'IPL BEGIN' AND event_ts IS NOT NULL AND (se_run IS NULL OR event_ts > se_run)
                      THEN event_ts END AS ib_x FROM g3),
g5 AS (SELECT *, min(ib_x) OVER {W} AS ib_run FROM g4),
g6 AS (SELECT *, CASE WHEN type = 'IPL END' AND event_ts IS NOT NULL AND (ib_run IS NULL OR event_ts > ib_run)
                      THEN event_ts END AS ie_x FROM g5),
bounds AS (
  SELECT log_dataset, max(sysname) AS sysname,
    min(CASE WHEN type = 'PRE IPL' THEN event_ts END) AS pre_ipl_ts,
    min(CASE WHEN type = 'SHUTDOWN BEGIN' THEN event_ts END) AS shutdown_begin_ts,
    min(se_x) AS shutdown_end_ts, min(ib_x) AS ipl_begin_ts, max(ie_x) AS ipl_end_ts,
    max(CASE WHEN type = 'POST IPL' THEN event_ts END) AS post_ipl_ts,
    arg_max(last_ipl_ts, log_id) FILTER (WHERE type = 'SYSTEM IPLED' AND last_ipl_ts IS NOT NULL) AS last_ipl_ts,
    bool_or(regexp_matches(type, '{cat.DATASET_KEEP_TYPE_PATTERN}')) AS has_ipl
  FROM g6 GROUP BY log_dataset),
kept_bounds AS (SELECT * FROM bounds WHERE has_ipl)
"""


def bt(col):
    """TIMESTAMP -> boundary text (unpadded month/day)."""
    return f"strftime({col}, '%Y-%-m-%-d %H:%M:%S')"


def it(col):
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def hms(n):
    """J3 in SQL."""
    return (f"CASE WHEN ({n}) IS NULL THEN NULL WHEN ({n}) < 0 THEN '00:00:' || CAST(({n}) AS VARCHAR) "
            f"ELSE printf('%02d:%02d:%02d', ({n}) // 3600, (({n}) % 3600) // 60, ({n}) % 60) END")


def secs(a, b):
    """Exact seconds b - a."""
    return f"(CAST(epoch({b}) AS BIGINT) - CAST(epoch({a}) AS BIGINT))"


RESUME_SELECT = f"""
  SELECT sysname, log_dataset,
    {bt('pre_ipl_ts')} AS pre_ipl, {bt('shutdown_begin_ts')} AS shutdown_begin,
    {bt('shutdown_end_ts')} AS shutdown_end, {bt('ipl_begin_ts')} AS ipl_begin,
    {bt('ipl_end_ts')} AS ipl_end, {bt('post_ipl_ts')} AS post_ipl,
    CASE WHEN pre_ipl_ts IS NULL AND shutdown_begin_ts IS NULL AND shutdown_end_ts IS NULL
          AND ipl_begin_ts IS NULL AND ipl_end_ts IS NULL AND post_ipl_ts IS NULL
         THEN {it('last_ipl_ts')} END AS last_ipl,
    {hms(secs('pre_ipl_ts', 'shutdown_begin_ts'))} AS elapsed_before_shutdown,
    {hms(secs('shutdown_begin_ts', 'shutdown_end_ts'))} AS elapsed_after_shutdown,
    {hms(secs('shutdown_end_ts', 'ipl_begin_ts'))} AS elapsed_btn_shut_ipl,
    {hms(secs('ipl_begin_ts', 'ipl_end_ts'))} AS elapsed_ipl,
    {hms(secs('ipl_end_ts', 'post_ipl_ts'))} AS elapsed_after_ipl,
    {hms(secs('pre_ipl_ts', 'post_ipl_ts'))} AS total_elapsed
  FROM kept_bounds"""


def with_base(extra_ctes: str, final: str) -> str:
    ctes = BASE.rstrip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{final}"
