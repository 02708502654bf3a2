"""Syslog lines derived from the ``events`` table.

The test tables carry no system logs, so an ``events`` row is rendered as one
syslog line; the same recipe is written in SQL for the DuckDB oracle.

* system ``SYS<user_id % 5>``; log dataset ``<system>.W<week of year>``; four of
  forty event ids go to datasets of their own, so that every route has rows:
  ``.SW`` only shutdown messages, ``.LW`` only SYSTEM IPLED, ``.PW`` a cycle
  without ends, ``.GW`` restart messages without a time
* line number ``event_id xor 174763``: unique at any size and out of time
  order, so some phases run backwards and exercise negative durations
* the message comes from ``event_type`` and ``floor(value)``; one in 53 lines
  matches no pattern, one in 97 is a JES allocation line
* all eight record layouts by ``event_id % 12``; layout 2 for SYSTEM IPLED; one in 41
  system words is foreign, one in 37 dates has five digits, one in 43 times is invalid
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# FIXED VALUE: line-number scrambling of the derived log
LINE_XOR = 174763


MESSAGE_SQL = """CASE
  WHEN k = 36 THEN 'IPLTRK01I START'
  WHEN k = 37 THEN 'TSO IS SHUTTING DOWN'
  WHEN k = 38 THEN 'SYSTEM IPLED'
  WHEN k = 39 THEN CASE WHEN (event_id div 40) % 2 = 0 THEN 'TSO IS SHUTTING DOWN' ELSE 'IEA371I PARMLIB' END
  WHEN event_id % 53 = 7 THEN 'ROUTINE MESSAGE'
  WHEN event_id % 97 = 11 THEN concat('IEF237I JES2 ALLOCATED LVL', CAST(v % 3 AS STRING), ' SYSLOG')
  ELSE CASE event_type
    WHEN 'error' THEN CASE WHEN v % 2 = 0 THEN 'TSO IS SHUTTING DOWN' ELSE 'DSI039I TASK ENDED' END
    WHEN 'view' THEN CASE v % 4 WHEN 0 THEN 'IXC371D CONFIRM' WHEN 1 THEN 'JES2 TERMINATION COMPLETE'
                                WHEN 2 THEN 'Z EOD' ELSE 'HASP ABEND NOT FOUND' END
    WHEN 'click' THEN 'IEA371I PARMLIB'
    WHEN 'purchase' THEN CASE v % 3 WHEN 0 THEN 'HZS0103I CHECKS' WHEN 1 THEN 'S TN3270' ELSE 'IPLTRK02I DONE' END
    WHEN 'signup' THEN CASE v % 3 WHEN 0 THEN 'IPLTRK01I START' WHEN 1 THEN 'TSO LOGON' ELSE 'SYSTEM IPLED' END
  END
END"""

LINE_SQL = """CASE
  WHEN msg = 'SYSTEM IPLED' THEN concat('D C000000 045 SYSTEM IPLED AT ', date_format(ts, 'HH.mm.ss'),
                                        ' ON ', date_format(ts, 'MM/dd/yyyy'))
  WHEN k = 36 THEN concat_ws(' ', 'N', day, msg)
  WHEN event_id % 12 IN (0, 3, 6) THEN concat_ws(' ', 'N 4000000', word, day, concat(clock, '.00'), msg)
  WHEN event_id % 12 IN (1, 4, 7) THEN concat_ws(' ', 'N', word, day, concat(clock, '.00'), msg)
  WHEN event_id % 12 = 8 THEN concat_ws(' ', 'N', day, concat(replace(clock, ':', ''), '00'), 'X R=1', msg)
  WHEN event_id % 12 = 9 THEN concat_ws(' ', 'N', day, msg)
  WHEN event_id % 12 = 10 THEN concat_ws(' ', 'N A', day, concat(replace(clock, ':', ''), '00'), msg)
  WHEN event_id % 12 = 11 THEN msg
  ELSE concat_ws(' ', 'N', day, concat(replace(clock, ':', ''), '00'), msg)
END"""


def events_syslog(events: DataFrame) -> DataFrame:
    """events -> ``(log_dataset, sysname, line_no, line, event_id)``.

    Projections in steps: the message is computed once and referenced by the line
    text (Catalyst keeps a non-trivial expression that is used several times
    in its own projection instead of inlining it into every use).
    """
    staged = events.selectExpr(
        "ts", "event_id", "concat('SYS', CAST(user_id % 5 AS STRING)) AS sysname", "event_id % 40 AS k",
        "CAST(floor(value) AS BIGINT) AS v", "event_type",
        "CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) AS wk"
    ).selectExpr(
        "ts", "event_id", "sysname", "k",
        "concat(sysname, '.', CASE k WHEN 36 THEN 'G' WHEN 37 THEN 'S' WHEN 38 THEN 'L' WHEN 39 THEN 'P' ELSE '' END, "
        "'W', CAST(wk AS STRING)) AS log_dataset",
        "CASE WHEN event_id % 41 = 3 THEN 'ZZ9' ELSE sysname END AS word",
        "CASE WHEN event_id % 37 = 5 THEN date_format(ts, 'yyDDD') ELSE date_format(ts, 'yyyyDDD') END AS day",
        "CASE WHEN event_id % 43 = 9 THEN '99:99:99' ELSE date_format(ts, 'HH:mm:ss') END AS clock",
        f"{MESSAGE_SQL} AS msg")
    # The line comes out of a one-row generator: a filter on it (the message
    # prefilter) then stays above this point instead of being pushed, with
    # the whole rendering inlined, into the scan.
    return staged.select(
        "log_dataset", "sysname", F.expr(f"event_id ^ {LINE_XOR}L").alias("line_no"),
        "event_id", F.inline(F.array(F.struct(F.expr(LINE_SQL).alias("line"))))) \
        .select("log_dataset", "sysname", "line_no", "line", "event_id")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns the log is made of.  A table of fewer splits than cores (one small file) is
    dealt over them, as the splits of text logs would be; a larger one is not shuffled."""
    events = spark.read.parquet(table_path(sf_dir, "events")).select("event_id", "ts", "user_id", "event_type", "value")
    cores = spark.sparkContext.defaultParallelism
    if events._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        events = events.repartition(cores, "event_id")
    return events


def syslog_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_syslog(read_events(spark, sf_dir)).drop("event_id")
