"""Registered queries: one per operator of the inventory.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or
None)``.  Every query reads the driver's tables (``events`` rendered as
syslog lines, ``supplier`` as the system inventory) over whole tables; file
sources and sinks write to the shared checkpoint folder and read back.
Timestamps are returned as text in the layouts the result tables use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.timefmt import (boundary_text, dataset_name, elapsed_calendar_approx,
                                 elapsed_seconds, format_days, format_hms, format_hms_floor,
                                 ipl_date_label, ipled_text, is_datetime, short_host)
from ..operators import boundaries as B
from ..operators import inventory as INV
from ..operators import reports as R
from ..operators import routing as RT
from ..operators.parse import error_lines, jes_level, message_prefilter, parse_lines, tokenize
from ..operators.resume import phase_durations, resume_rows
from ..session import shared_path, table_path, written
from ..sources.events_log import syslog_from_tables
from ..sources.syslog import first_last_log_datasets, select_log_datasets
from . import oracle as O

REGISTRY: dict = {}


def q(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ shared
def lines(s, sf):
    return syslog_from_tables(s, sf)


def detail(s, sf):
    return parse_lines(lines(s, sf))


def bounds_all(s, sf):
    return B.cycle_boundaries(detail(s, sf))


def bounds(s, sf):
    return B.datasets_with_ipl(bounds_all(s, sf))


def spans(s, sf):
    return B.dataset_spans(detail(s, sf))


def resume(s, sf):
    return resume_rows(bounds(s, sf))


def week(col="log_dataset"):
    return F.regexp_extract(F.col(col), "W([0-9]+)$", 1).cast("bigint")


SQL_WEEK = "CAST(regexp_extract(log_dataset, 'W([0-9]+)$', 1) AS BIGINT)"
RESUME_CTE = f"resume AS ({O.RESUME_SELECT})"


def sql(final: str, extra: str = "") -> str:
    return O.with_base(extra, final)


def sqlr(final: str, extra: str = "") -> str:
    return O.with_base(RESUME_CTE + ("," + extra if extra else ""), final)


# ---------------------------------------------------------------- parsing
@q("tokenize", sql("SELECT log_dataset, line_no AS log_id, CAST(len(w) AS BIGINT) AS n_words FROM kept"))
def q_tokenize(s, sf):
    return message_prefilter(lines(s, sf)).select(
        "log_dataset", F.col("line_no").alias("log_id"),
        F.size(tokenize(F.col("line"))).cast("bigint").alias("n_words"))


@q("message_prefilter", sql("SELECT log_dataset, count(*) AS n_kept FROM kept GROUP BY log_dataset"))
def q_prefilter(s, sf):
    return message_prefilter(lines(s, sf)).groupBy("log_dataset").agg(F.count(F.lit(1)).alias("n_kept"))


@q("record_layout", sql("SELECT log_dataset, CAST(layout AS BIGINT) AS layout, count(*) AS n FROM raw GROUP BY 1, 2"))
def q_layout(s, sf):
    return detail(s, sf).groupBy("log_dataset", F.col("layout").cast("bigint").alias("layout")) \
        .agg(F.count(F.lit(1)).alias("n"))


@q("system_match", sql("SELECT log_dataset, count(*) AS n_system_rows FROM raw WHERE layout IN (1, 3) GROUP BY 1"))
def q_system(s, sf):
    return detail(s, sf).filter(F.col("layout").isin(1, 3)).groupBy("log_dataset") \
        .agg(F.count(F.lit(1)).alias("n_system_rows"))


@q("classify_event", sql("SELECT log_dataset, type, count(*) AS n FROM detail GROUP BY 1, 2"))
def q_classify(s, sf):
    return detail(s, sf).groupBy("log_dataset", "type").agg(F.count(F.lit(1)).alias("n"))


@q("flag_error", sql("SELECT log_dataset, count(*) FILTER (WHERE error = 'y') AS n_error FROM detail GROUP BY 1"))
def q_flag_error(s, sf):
    return detail(s, sf).groupBy("log_dataset").agg(
        F.count(F.when(F.col("error") == "y", 1)).alias("n_error"))


@q("error_lines", sql("SELECT log_dataset, log_id, msg FROM detail WHERE error = 'y'"))
def q_error_lines(s, sf):
    return error_lines(detail(s, sf)).select("log_dataset", "log_id", "msg")


@q("julian_to_date", sql("SELECT DISTINCT date_raw, strftime(event_date, '%Y-%m-%d') AS event_date FROM detail"))
def q_julian(s, sf):
    return detail(s, sf).select("date_raw", F.date_format("event_date", "yyyy-MM-dd").alias("event_date")).distinct()


@q("normalize_time", sql("SELECT DISTINCT time_raw, event_time FROM detail"))
def q_time(s, sf):
    return detail(s, sf).select("time_raw", "event_time").distinct()


@q("ipled_timestamp", sql(f"SELECT log_dataset, log_id, {O.it('last_ipl_ts')} AS last_ipl FROM detail WHERE type = 'SYSTEM IPLED'"))
def q_ipled(s, sf):
    return detail(s, sf).filter(F.col("type") == cat.SYSTEM_IPLED).select(
        "log_dataset", "log_id", ipled_text("last_ipl_ts").alias("last_ipl"))


DETAIL_SQL = f"""SELECT log_dataset AS log_name, CAST(log_id AS VARCHAR) AS log_id,
  strftime(event_date, '%Y-%-m-%-d') AS date, event_time AS time, sysname AS system, type, error,
  {O.it('last_ipl_ts')} AS last_ipl, msg FROM detail"""


@q("detail_row", sql(DETAIL_SQL))
def q_detail_row(s, sf):
    from ..sinks import detail_text
    return detail_text(detail(s, sf))


@q("dataset_name", sql("SELECT sysname, log_dataset, regexp_replace(sysname || '_' || log_dataset || '.CSV', '\\.CSV$', '') AS output_name FROM bounds"))
def q_dataset_name(s, sf):
    return spans(s, sf).select("sysname", "log_dataset", dataset_name(
        F.col("sysname"), F.concat(F.col("log_dataset"), F.lit(".CSV"))).alias("output_name"))


@q("jes_level", sql("""SELECT DISTINCT log_dataset, coalesce(string_split_regex(regexp_replace(line, '^[ \\t]+', ''), '[ \\t]+')[9], '') AS jes_level
  FROM syslog WHERE contains(line, 'IEF237I') AND contains(line, 'JES') AND contains(line, 'ALLOCATED') AND contains(line, 'SYSLOG')"""))
def q_jes(s, sf):
    return jes_level(lines(s, sf))


@q("jes_level_single", sql("""SELECT DISTINCT log_dataset, coalesce(string_split_regex(regexp_replace(line, '^[ \\t]+', ''), '[ \\t]+')[9], '') AS jes_level
  FROM syslog WHERE contains(line, 'JES') AND contains(line, 'SYSLOG')"""))
def q_jes_single(s, sf):
    return jes_level(lines(s, sf), single_dataset=True)


# -------------------------------------------------------------- reduction
RUN_CHUNK = 512   # small chunks here so the oracle checks many cross-chunk carries


@q("running_boundaries", sql(f"""SELECT log_dataset, log_id, type, {O.bt('sb_run')} AS sb_run,
  {O.bt('se_run')} AS se_run, {O.bt('ib_run')} AS ib_run, {O.bt('ie_x')} AS ie_accepted FROM g6"""))
def q_running(s, sf):
    classed = detail(s, sf).filter(F.col("type").isNotNull())
    r = B.running_boundaries(classed, chunk_rows=RUN_CHUNK)
    return r.select("log_dataset", "log_id", "type", boundary_text("_sb").alias("sb_run"),
                    boundary_text("_se").alias("se_run"), boundary_text("_ib").alias("ib_run"),
                    boundary_text("_ie_x").alias("ie_accepted"))


@q("cycle_boundaries", sql(f"""SELECT sysname, log_dataset, {O.bt('shutdown_begin_ts')} AS shutdown_begin,
  {O.bt('shutdown_end_ts')} AS shutdown_end, {O.bt('ipl_begin_ts')} AS ipl_begin, {O.bt('ipl_end_ts')} AS ipl_end FROM bounds"""))
def q_cycle(s, sf):
    b = bounds_all(s, sf)
    return b.select("sysname", "log_dataset", *[boundary_text(f"{c}_ts").alias(c) for c in
                                                ("shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end")])


@q("cycle_boundaries_chunked", sql(f"""SELECT sysname, log_dataset, {O.bt('shutdown_begin_ts')} AS shutdown_begin,
  {O.bt('shutdown_end_ts')} AS shutdown_end, {O.bt('ipl_begin_ts')} AS ipl_begin, {O.bt('ipl_end_ts')} AS ipl_end FROM bounds"""))
def q_cycle_chunked(s, sf):
    b = B.cycle_boundaries(detail(s, sf), chunk_rows=RUN_CHUNK)
    return b.select("sysname", "log_dataset", *[boundary_text(f"{c}_ts").alias(c) for c in
                                                ("shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end")])


@q("pre_post_ipl", sql(f"SELECT log_dataset, {O.bt('pre_ipl_ts')} AS pre_ipl, {O.bt('post_ipl_ts')} AS post_ipl FROM bounds"))
def q_pre_post(s, sf):
    return spans(s, sf).select("log_dataset", boundary_text("pre_ipl_ts").alias("pre_ipl"),
                                    boundary_text("post_ipl_ts").alias("post_ipl"))


@q("last_ipled", sql(f"SELECT log_dataset, {O.it('last_ipl_ts')} AS last_ipl FROM bounds"))
def q_last_ipled(s, sf):
    return spans(s, sf).select("log_dataset", ipled_text("last_ipl_ts").alias("last_ipl"))


@q("resume_row", sqlr("SELECT * FROM resume"))
def q_resume(s, sf):
    return resume(s, sf)


@q("first_last_boundaries", sql(f"""SELECT max(sysname) AS sysname, log_dataset,
  {O.bt("arg_min(event_ts, log_id) FILTER (WHERE type = 'SHUTDOWN BEGIN' AND event_ts IS NOT NULL)")} AS shutdown_begin,
  {O.bt("arg_max(event_ts, log_id) FILTER (WHERE type = 'END OF SHUTDOWN' AND event_ts IS NOT NULL)")} AS shutdown_end,
  {O.bt("arg_min(event_ts, log_id) FILTER (WHERE type = 'IPL BEGIN' AND event_ts IS NOT NULL)")} AS ipl_begin,
  {O.bt("arg_min(event_ts, log_id) FILTER (WHERE type = 'IPL END' AND event_ts IS NOT NULL)")} AS ipl_end
  FROM cls GROUP BY log_dataset"""))
def q_first_last(s, sf):
    b = B.first_last_boundaries(detail(s, sf))
    return b.select("sysname", "log_dataset", *[boundary_text(f"{c}_ts").alias(c) for c in
                                                ("shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end")])


@q("datasets_with_ipl", sql("SELECT log_dataset FROM kept_bounds"))
def q_with_ipl(s, sf):
    return B.datasets_with_ipl(spans(s, sf)).select("log_dataset")


@q("lines_processed", sql("SELECT log_dataset, max(log_id) AS lines_processed FROM detail GROUP BY 1"))
def q_lines_processed(s, sf):
    return B.lines_processed(detail(s, sf))


@q("dataset_count", sql("SELECT count(*) AS n_datasets FROM kept_bounds"))
def q_dataset_count(s, sf):
    return B.datasets_with_ipl(spans(s, sf)).agg(F.count(F.lit(1)).alias("n_datasets"))


# A qualifier holds the logs of one system and kind, a log for each week.
SQL_QUALIFIER = "regexp_replace(log_dataset, '[0-9]+$', '')"


def qualifier(col="log_dataset"):
    return F.regexp_replace(col, "[0-9]+$", "")


def _weeks(ln: DataFrame) -> DataFrame:
    return ln.select("log_dataset", qualifier().alias("qualifier"), week().alias("part_no")).distinct()


def _parts(ln: DataFrame) -> DataFrame:
    """The logs of a qualifier as the parts of one."""
    ds = _weeks(ln)
    first = ds.groupBy("qualifier").agg(F.min_by("log_dataset", "part_no").alias("group_name"))
    return ds.join(first, "qualifier").select("log_dataset", "group_name", "part_no")


WEEKS_CTE = f"weeks AS (SELECT DISTINCT log_dataset, {SQL_QUALIFIER} AS qualifier, {SQL_WEEK} AS wk FROM syslog)"


def _union_sql(parts: str) -> str:
    """The fold over joined logs; ``parts`` is a CTE body with (log_dataset, part_no, grp)."""
    w = "OVER (PARTITION BY grp ORDER BY part_no, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return sql(f"""SELECT max(sysname) AS sysname, grp AS log_dataset,
  {O.bt("min(CASE WHEN type = 'SHUTDOWN BEGIN' THEN event_ts END)")} AS shutdown_begin,
  {O.bt('min(se_x)')} AS shutdown_end, {O.bt('min(ib_x)')} AS ipl_begin, {O.bt('max(ie_x)')} AS ipl_end
  FROM u6 GROUP BY grp""", extra=f"""{WEEKS_CTE},
parts AS ({parts}),
ucls AS (SELECT c.*, p.part_no, p.grp FROM cls c JOIN parts p USING (log_dataset)),
u1 AS (SELECT *, min(CASE WHEN type = 'SHUTDOWN BEGIN' AND event_ts IS NOT NULL THEN event_ts END) {w} AS sb_run FROM ucls),
u2 AS (SELECT *, CASE WHEN type = 'END OF SHUTDOWN' AND event_ts IS NOT NULL AND (sb_run IS NULL OR event_ts > sb_run) THEN event_ts END AS se_x FROM u1),
u3 AS (SELECT *, min(se_x) {w} AS se_run FROM u2),
u4 AS (SELECT *, CASE WHEN type = 'IPL BEGIN' AND event_ts IS NOT NULL AND (se_run IS NULL OR event_ts > se_run) THEN event_ts END AS ib_x FROM u3),
u5 AS (SELECT *, min(ib_x) {w} AS ib_run FROM u4),
u6 AS (SELECT *, CASE WHEN type = 'IPL END' AND event_ts IS NOT NULL AND (ib_run IS NULL OR event_ts > ib_run) THEN event_ts END AS ie_x FROM u5)""")


def _joined(s, sf, parts: DataFrame) -> DataFrame:
    classed = detail(s, sf).filter(F.col("type").isNotNull())
    b = B.cycle_boundaries(B.union_log_parts(classed, parts))
    return b.select("sysname", "log_dataset", *[boundary_text(f"{c}_ts").alias(c) for c in
                                                ("shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end")])


@q("union_log_parts", _union_sql("SELECT log_dataset, wk AS part_no, first_value(log_dataset) OVER (PARTITION BY qualifier ORDER BY wk) AS grp FROM weeks"))
def q_union_parts(s, sf):
    return _joined(s, sf, _parts(lines(s, sf)))


@q("union_part_list", _union_sql("""
  SELECT log_dataset, row_number() OVER (PARTITION BY qualifier ORDER BY wk) - 1 AS part_no, first_value(log_dataset) OVER (PARTITION BY qualifier ORDER BY wk) AS grp
    FROM weeks WHERE qualifier IN (SELECT qualifier FROM weeks GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT log_dataset, row_number() OVER (PARTITION BY qualifier ORDER BY wk DESC) - 1, first_value(log_dataset) OVER (PARTITION BY qualifier ORDER BY wk DESC)
    FROM weeks
  UNION ALL SELECT arg_max(log_dataset, wk), count(*), arg_max(log_dataset, wk) FROM weeks GROUP BY qualifier"""))
def q_union_list(s, sf):
    """Two lists for each qualifier, as a user types them: its logs in order, and in reverse with the
    first named again at the end.  Lists that start alike make one output: the later list."""
    weeks = _weeks(lines(s, sf)).groupBy("qualifier").agg(F.sort_array(F.collect_list(F.struct("part_no", "log_dataset")))["log_dataset"].alias("up"))
    down = F.reverse("up")
    lists = weeks.select(F.posexplode(F.array(F.array_join("up", "|"), F.concat_ws("|", F.array_join(down, "|"), down[0]))).alias("list_no", "parts"))
    return _joined(s, sf, B.parts_of_lists(lists))


# ---------------------------------------------------- listing / top-n
LISTING_SQL_CTE = f"""
{WEEKS_CTE},
listing AS (
  SELECT qualifier, wk * 3 AS list_pos, 'SYSLOG.' || log_dataset AS name FROM weeks
  UNION ALL SELECT qualifier, wk * 3 + 1, 'INDEX.' || log_dataset FROM weeks
  UNION ALL SELECT qualifier, wk * 3 + 2, 'IN-CAT.SYSLOG.' || log_dataset FROM weeks),
listed AS (SELECT *, row_number() OVER (PARTITION BY qualifier ORDER BY list_pos DESC) AS rn FROM listing
           WHERE contains(name, 'LOG') AND NOT contains(name, 'IN-CAT'))"""


def listing(s, sf):
    ds = _weeks(lines(s, sf))
    parts = [ds.select("qualifier", (F.col("part_no") * 3 + k).alias("list_pos"),
                       F.concat(F.lit(p), F.col("log_dataset")).alias("name"))
             for k, p in enumerate(["SYSLOG.", "INDEX.", "IN-CAT.SYSLOG."])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@q("select_log_datasets", sql("SELECT qualifier, list_pos, name FROM listed WHERE rn <= 90", LISTING_SQL_CTE))
def q_select_ds(s, sf):
    return select_log_datasets(listing(s, sf), cat.DATASETS_KEPT_PER_QUALIFIER).select("qualifier", "list_pos", "name")


@q("latest_n_per_key", sql("SELECT qualifier, list_pos, name FROM listed WHERE rn <= 3", LISTING_SQL_CTE))
def q_latest_n(s, sf):
    return select_log_datasets(listing(s, sf), 3).select("qualifier", "list_pos", "name")


@q("first_last_n", sql("""SELECT qualifier, list_pos, name, 'last' AS side FROM listed WHERE rn <= 2
  UNION ALL SELECT qualifier, list_pos, name, 'first' FROM
    (SELECT *, row_number() OVER (PARTITION BY qualifier ORDER BY list_pos) AS up FROM listed) WHERE up <= 2""", LISTING_SQL_CTE))
def q_first_last_n(s, sf):
    return first_last_log_datasets(listing(s, sf), 2)


# ------------------------------------------------------------- durations
SPANS = [("shutdown", "shutdown_begin_ts", "shutdown_end_ts"),
         ("poweroff", "shutdown_end_ts", "ipl_begin_ts"),
         ("load", "ipl_begin_ts", "ipl_end_ts"),
         ("total", "shutdown_begin_ts", "ipl_end_ts")]


def _span_sql(fn, suffix):
    return ", ".join(f"{fn(O.secs(a, b))} AS {n}_{suffix}" for n, a, b in SPANS)


@q("elapsed_exact", sql("SELECT log_dataset, " + ", ".join(f"{O.secs(a, b)} AS {n}_seconds" for n, a, b in SPANS) + " FROM kept_bounds"))
def q_exact(s, sf):
    return bounds(s, sf).select("log_dataset", *[elapsed_seconds(a, b).alias(f"{n}_seconds") for n, a, b in SPANS])


def _cal(c):
    return (f"((year({c}) - 1970) * 31557600 + month({c}) * 2629800 + day({c}) * 86400 "
            f"+ hour({c}) * 3600 + minute({c}) * 60 + second({c}))")


@q("elapsed_calendar_approx", sql("SELECT log_dataset, " + ", ".join(
    f"CAST({_cal(b)} - {_cal(a)} AS BIGINT) AS {n}_approx_seconds" for n, a, b in SPANS) + " FROM kept_bounds"))
def q_calendar(s, sf):
    return bounds(s, sf).select("log_dataset", *[elapsed_calendar_approx(a, b).alias(f"{n}_approx_seconds")
                                                 for n, a, b in SPANS])


@q("format_hms", sql("SELECT log_dataset, " + _span_sql(O.hms, "hms") + " FROM kept_bounds"))
def q_hms(s, sf):
    return bounds(s, sf).select("log_dataset", *[format_hms(elapsed_seconds(a, b)).alias(f"{n}_hms")
                                                 for n, a, b in SPANS])


def _hms_floor_sql(n):
    return (f"printf('%02d:%02d:%02d', CAST(floor(({n}) / 3600.0) AS BIGINT), "
            f"((({n}) % 3600) + 3600) % 3600 // 60, ((({n}) % 60) + 60) % 60)")


@q("format_hms_floor", sql("SELECT log_dataset, " + _span_sql(_hms_floor_sql, "hms_floor") + " FROM kept_bounds"))
def q_hms_floor(s, sf):
    return bounds(s, sf).select("log_dataset", *[format_hms_floor(elapsed_seconds(a, b)).alias(f"{n}_hms_floor")
                                                 for n, a, b in SPANS])


def _days_sql(n):
    return (f"CASE WHEN ({n}) >= 0 THEN printf('[ %d day(s), %d hour(s), %d minute(s), %d second(s) ]', "
            f"({n}) // 86400, (({n}) % 86400) // 3600, (({n}) % 3600) // 60, ({n}) % 60) "
            f"ELSE printf('[ 0 day(s), 0 hour(s), 0 minute(s), %d second(s) ]', {n}) END")


@q("format_days", sql("SELECT log_dataset, " + _span_sql(_days_sql, "days") + " FROM kept_bounds"))
def q_days(s, sf):
    return bounds(s, sf).select("log_dataset", *[format_days(elapsed_seconds(a, b)).alias(f"{n}_days")
                                                 for n, a, b in SPANS])


J6_NAMES = [("shutdown_duration", "shutdown"), ("poweroff_duration", "poweroff"),
            ("load_ipl", "load"), ("total_duration", "total")]


@q("phase_durations", sql("SELECT log_dataset, " + ", ".join(
    f"{O.hms(O.secs(a, b))} AS {j6}, {O.secs(a, b)} AS {j6}_seconds"
    for (j6, _), (_, a, b) in zip(J6_NAMES, SPANS)) + " FROM kept_bounds"))
def q_phase_durations(s, sf):
    out = phase_durations(bounds(s, sf))
    return out.select("log_dataset", *[c for j6, _ in J6_NAMES for c in (j6, f"{j6}_seconds")])


ELAPSED = ["elapsed_before_shutdown", "elapsed_after_shutdown", "elapsed_btn_shut_ipl",
           "elapsed_ipl", "elapsed_after_ipl", "total_elapsed"]


@q("phase_elapsed", sqlr("SELECT log_dataset, " + ", ".join(ELAPSED) + " FROM resume"))
def q_phase_elapsed(s, sf):
    return resume(s, sf).select("log_dataset", *ELAPSED)


FOUR = ["shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end"]


def _valid_sql(c):
    return (f"CASE WHEN try_strptime(regexp_replace({c}, '(\\S)\\s+(\\S)', '\\1 \\2', 'g'), "
            f"'%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 1 ELSE 0 END")


@q("is_datetime", sqlr("SELECT log_dataset, " + ", ".join(
    f"CAST({_valid_sql(c)} AS BIGINT) AS valid_{c}" for c in FOUR + ["last_ipl"]) + " FROM resume"))
def q_is_datetime(s, sf):
    return resume(s, sf).select("log_dataset", *[is_datetime(c).cast("bigint").alias(f"valid_{c}")
                                                 for c in FOUR + ["last_ipl"]])


@q("ipl_date_label", sql("SELECT log_dataset, strftime(shutdown_begin_ts, '%b %d, %Y') AS ipl_date FROM kept_bounds"))
def q_ipl_date(s, sf):
    return bounds(s, sf).select("log_dataset", ipl_date_label("shutdown_begin_ts").alias("ipl_date"))


# ---------------------------------------------------------------- routing
ALL4 = " AND ".join(f"{c} IS NOT NULL" for c in FOUR)
ANY4 = " OR ".join(f"{c} IS NOT NULL" for c in FOUR)
DONE_SQL_FINAL = f"""SELECT sysname, strftime(strptime(shutdown_begin, '%Y-%m-%d %H:%M:%S'), '%b %d, %Y') AS ipl_date,
  log_dataset, shutdown_begin, shutdown_end, ipl_begin, ipl_end, pre_ipl, post_ipl AS pos_ipl,
  {O.hms(O.secs("strptime(shutdown_begin, '%Y-%m-%d %H:%M:%S')", "strptime(shutdown_end, '%Y-%m-%d %H:%M:%S')"))} AS shutdown_duration,
  {O.hms(O.secs("strptime(shutdown_end, '%Y-%m-%d %H:%M:%S')", "strptime(ipl_begin, '%Y-%m-%d %H:%M:%S')"))} AS poweroff_duration,
  {O.hms(O.secs("strptime(ipl_begin, '%Y-%m-%d %H:%M:%S')", "strptime(ipl_end, '%Y-%m-%d %H:%M:%S')"))} AS load_ipl,
  {O.hms(O.secs("strptime(shutdown_begin, '%Y-%m-%d %H:%M:%S')", "strptime(ipl_end, '%Y-%m-%d %H:%M:%S')"))} AS total_duration
  FROM resume WHERE {ALL4}"""
FAIL_COLS_SQL = "sysname, log_dataset, shutdown_begin, shutdown_end, ipl_begin, ipl_end, pre_ipl, post_ipl AS pos_ipl"
DONE_CTE = f"done AS ({DONE_SQL_FINAL})"


@q("route_done", sqlr(DONE_SQL_FINAL))
def q_route_done(s, sf):
    return RT.done_rows(resume(s, sf))


@q("route_fail", sqlr(f"SELECT {FAIL_COLS_SQL} FROM resume WHERE NOT ({ALL4}) AND ({ANY4})"))
def q_route_fail(s, sf):
    return RT.fail_rows(resume(s, sf))


@q("route_garbage", sqlr(f"SELECT {FAIL_COLS_SQL} FROM resume WHERE NOT ({ANY4}) AND last_ipl IS NULL"))
def q_route_garbage(s, sf):
    return RT.garbage_rows(resume(s, sf))


@q("route_last_ipl", sqlr(f"SELECT sysname, log_dataset, last_ipl FROM resume WHERE NOT ({ANY4}) AND last_ipl IS NOT NULL"))
def q_route_last(s, sf):
    return RT.last_ipl_rows(resume(s, sf))


@q("route_counts", sqlr(f"""SELECT CASE WHEN {ALL4} THEN 'done' WHEN {ANY4} THEN 'fail'
  WHEN last_ipl IS NULL THEN 'garbage' ELSE 'last_ipl' END AS route, count(*) AS n_rows FROM resume GROUP BY 1"""))
def q_route_counts(s, sf):
    return RT.route_counts(resume(s, sf))


# The three historical rules, as the sinks they fill.
VALID4 = ALL4   # boundary text of the reducer is valid where it is set
RULE_SQL = {
    "spark": {"fail": f"NOT ({VALID4}) AND last_ipl IS NULL", "garbage": "false", "last_ipl": "last_ipl IS NOT NULL"},
    "pandas": {"fail": f"NOT ({VALID4})", "garbage": "false", "last_ipl": "last_ipl IS NOT NULL"},
    "refactor": {"fail": f"NOT ({VALID4}) AND ({ANY4})", "garbage": f"NOT ({ANY4})", "last_ipl": "last_ipl IS NOT NULL"},
}


@q("route_rules", sqlr(" UNION ALL ".join(
    f"SELECT '{rule}' AS rule, '{sink}' AS sink, sysname, log_dataset FROM resume WHERE {cond}"
    for rule, sinks in RULE_SQL.items() for sink, cond in sinks.items())))
def q_route_rules(s, sf):
    r = written(resume(s, sf), "resume")
    out = None
    for rule in RULE_SQL:
        for sink, fn in (("fail", RT.fail_rows), ("garbage", RT.garbage_rows), ("last_ipl", RT.last_ipl_rows)):
            one = fn(r, rule).select(F.lit(rule).alias("rule"), F.lit(sink).alias("sink"), "sysname", "log_dataset")
            out = one if out is None else out.unionByName(one)
    return out


@q("new_raw_rows", sqlr(f"SELECT * FROM resume WHERE log_dataset NOT IN (SELECT log_dataset FROM resume WHERE {SQL_WEEK} % 2 = 0)"))
def q_new_raw(s, sf):
    r = resume(s, sf)
    return RT.unseen_rows(r, r.filter(week() % 2 == 0))


@q("new_result_rows", sqlr(f"SELECT * FROM done WHERE log_dataset NOT IN (SELECT log_dataset FROM done WHERE {SQL_WEEK} % 2 = 0)", DONE_CTE))
def q_new_result(s, sf):
    d = RT.done_rows(resume(s, sf))
    return RT.unseen_rows(d, d.filter(week() % 2 == 0))


@q("rows_for_systems", sqlr(f"""SELECT * FROM resume WHERE sysname IN (SELECT sysname FROM resume
  WHERE {SQL_WEEK} % 2 = 1 AND sysname IN ('SYS1', 'SYS3'))"""))
def q_rows_for_systems(s, sf):
    r = resume(s, sf)
    new = RT.unseen_rows(r, r.filter(week() % 2 == 0)).filter(F.col("sysname").isin("SYS1", "SYS3"))
    return RT.rows_for_systems(r, new)


@q("scan_raw_results", sqlr("SELECT " + ", ".join(RT.RAW_SCAN_COLUMNS) + " FROM resume WHERE sysname IN ('SYS0', 'SYS2')"))
def q_scan_raw(s, sf):
    return RT.scan_raw_results(resume(s, sf), ["SYS0", "SYS2"])


@q("dedupe_rows", sqlr("SELECT DISTINCT * FROM (SELECT * FROM resume UNION ALL SELECT * FROM resume)"))
def q_dedupe_rows(s, sf):
    r = resume(s, sf)
    return RT.dedupe_rows(r.unionByName(r))


IPLED_ROWS_CTE = f"ipled AS (SELECT sysname, log_dataset, {O.it('last_ipl_ts')} AS last_ipl FROM detail WHERE type = 'SYSTEM IPLED')"


def ipled_rows(s, sf):
    return detail(s, sf).filter(F.col("type") == cat.SYSTEM_IPLED).select(
        "sysname", "log_dataset", ipled_text("last_ipl_ts").alias("last_ipl"))


@q("dedupe_last_ipl", sql("SELECT sysname, min(log_dataset) AS log_dataset, last_ipl FROM ipled GROUP BY sysname, last_ipl", IPLED_ROWS_CTE))
def q_dedupe_last(s, sf):
    return RT.dedupe_last_ipl(ipled_rows(s, sf))


@q("distinct_last_ipl", sql("SELECT DISTINCT sysname, log_dataset, last_ipl FROM ipled", IPLED_ROWS_CTE))
def q_distinct_last(s, sf):
    return RT.distinct_last_ipl(ipled_rows(s, sf))


@q("distinct_datasets", sql("SELECT DISTINCT log_dataset FROM detail"))
def q_distinct_ds(s, sf):
    return RT.distinct_datasets(detail(s, sf))


@q("distinct_systems", sql("SELECT DISTINCT sysname FROM detail"))
def q_distinct_sys(s, sf):
    return RT.distinct_systems(detail(s, sf))


@q("unique_sorted", sqlr("SELECT DISTINCT sysname FROM resume ORDER BY sysname"))
def q_unique_sorted(s, sf):
    return resume(s, sf).select("sysname").distinct().orderBy("sysname")


# -------------------------------------------------------------- inventory
LPAR_SQL_CTE = """lpar AS (SELECT s_suppkey AS id, 'LP' || CAST(s_suppkey AS VARCHAR) AS lpar,
  'host' || CAST(s_nationkey AS VARCHAR) || '.Example.com' AS hostname,
  'SYSLOG.N' || CAST(s_nationkey AS VARCHAR) AS dataset, 'user' || CAST(s_suppkey % 7 AS VARCHAR) AS username,
  CAST(CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS enable,
  CASE s_suppkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'none' END AS schedule FROM supplier)"""


def lpar(s, sf) -> DataFrame:
    sup = s.read.parquet(table_path(sf, "supplier"))
    k = F.col("s_suppkey")
    return sup.select(
        k.alias("id"), F.concat(F.lit("LP"), k.cast("string")).alias("lpar"),
        F.concat(F.lit("host"), F.col("s_nationkey").cast("string"), F.lit(".Example.com")).alias("hostname"),
        F.concat(F.lit("SYSLOG.N"), F.col("s_nationkey").cast("string")).alias("dataset"),
        F.concat(F.lit("user"), (k % 7).cast("string")).alias("username"),
        F.when(F.col("s_acctbal") >= 0, 1).otherwise(0).cast("int").alias("enable"),
        F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("none").alias("schedule"))


def isql(final):
    return f"WITH {LPAR_SQL_CTE}\n{final}"


@q("criteria_eq", isql("SELECT * FROM lpar WHERE enable = 1 AND schedule = 'weekly'"))
def q_criteria_eq(s, sf):
    return INV.criteria_eq(lpar(s, sf), {"enable": 1, "schedule": "weekly"})


@q("criteria_in", isql("SELECT * FROM lpar WHERE hostname IN ('host1.Example.com', 'host3.Example.com') AND username IN ('user1', 'user2')"))
def q_criteria_in(s, sf):
    return INV.criteria_in(lpar(s, sf), {"hostname": ["host1.Example.com", "host3.Example.com"],
                                         "username": ["user1", "user2"]})


@q("criteria_read", isql("SELECT DISTINCT hostname, dataset FROM lpar WHERE enable = 1 AND schedule IN ('daily', 'weekly')"))
def q_criteria_read(s, sf):
    return INV.criteria_read(lpar(s, sf), distinct="hostname,dataset", criteria={"enable": 1},
                             in_values={"schedule": ["daily", "weekly"]})


@q("enabled_systems", isql("SELECT * FROM lpar WHERE enable = 1"))
def q_enabled(s, sf):
    return INV.enabled_systems(lpar(s, sf))


@q("inventory_insert_if_absent", isql("""SELECT * FROM lpar WHERE id % 2 = 0 UNION ALL
  SELECT n.id, n.lpar, n.hostname, n.dataset, n.username, 1 AS enable, n.schedule FROM lpar n
  WHERE n.id % 2 = 1 AND n.hostname NOT IN (SELECT hostname FROM lpar WHERE id % 2 = 0)
    AND n.id = (SELECT min(id) FROM lpar m WHERE m.id % 2 = 1 AND m.hostname = n.hostname)"""))
def q_insert(s, sf):
    lp = lpar(s, sf)
    return INV.insert_if_absent(lp.filter(F.col("id") % 2 == 0), lp.filter(F.col("id") % 2 == 1))


@q("inventory_update", isql("""SELECT id, lpar, hostname, dataset,
  CASE WHEN id % 5 = 0 THEN 'ops' ELSE username END AS username, enable,
  CASE WHEN id % 5 = 0 THEN 'daily' ELSE schedule END AS schedule FROM lpar"""))
def q_update(s, sf):
    lp = lpar(s, sf)
    upd = lp.filter(F.col("id") % 5 == 0).select("id", F.lit("ops").alias("username"),
                                                 F.lit("daily").alias("schedule"))
    return INV.update_rows(lp, upd)


@q("rows_delete_by_key", isql("SELECT * FROM lpar WHERE id % 4 <> 0"))
def q_delete(s, sf):
    lp = lpar(s, sf)
    return INV.delete_by_key(lp, lp.filter(F.col("id") % 4 == 0))


def _stored_lpar(s, lp) -> str:
    path = shared_path(s, "inventory")
    INV.write_inventory(lp, path)
    return path


@q("stored_inventory", isql("""SELECT id, lpar, hostname, dataset, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'ops' ELSE username END AS username,
  CASE WHEN id % 2 = 0 THEN enable ELSE 1 END AS enable, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'daily' ELSE schedule END AS schedule
  FROM lpar n WHERE id % 4 <> 0 AND (id % 2 = 0 OR n.hostname NOT IN (SELECT hostname FROM lpar WHERE id % 2 = 0)
    AND n.id = (SELECT min(id) FROM lpar m WHERE m.id % 2 = 1 AND m.hostname = n.hostname))"""))
def q_stored_inventory(s, sf):
    """E4, E5 and E6 in turn on one stored table, read back."""
    lp = lpar(s, sf)
    path = _stored_lpar(s, lp.filter(F.col("id") % 2 == 0))
    INV.insert_stored(s, path, lp.filter(F.col("id") % 2 == 1))
    INV.update_stored(s, path, lp.filter((F.col("id") % 5 == 0) & (F.col("id") % 2 == 0)).select(
        "id", F.lit("ops").alias("username"), F.lit("daily").alias("schedule")))
    INV.delete_stored(s, path, lp.filter(F.col("id") % 4 == 0))
    return INV.stored_inventory(s, path)


@q("migrate_inventory", isql("SELECT lpar, hostname, dataset, username, enable FROM lpar"))
def q_migrate(s, sf):
    path = shared_path(s, "lpar")
    INV.migrate_inventory(lpar(s, sf), path)
    return s.read.parquet(path)


@q("short_host", isql("SELECT id, lower(split_part(hostname, '.', 1)) AS host FROM lpar"))
def q_short_host(s, sf):
    return lpar(s, sf).select("id", short_host("hostname").alias("host"))


# ---------------------------------------------------------------- reports
def done(s, sf):
    return RT.done_rows(resume(s, sf))


REPORT_FORMAT_SQL = sqlr("""SELECT upper(coalesce(sysname, '')) AS sysname, coalesce(ipl_date, '') AS ipl_date,
  coalesce(log_dataset, '') AS log_dataset, coalesce(right(shutdown_begin, 8), '') AS shutdown_begin,
  coalesce(right(shutdown_end, 8), '') AS shutdown_end, coalesce(right(ipl_begin, 8), '') AS ipl_begin,
  coalesce(right(ipl_end, 8), '') AS ipl_end, coalesce(right(pre_ipl, 8), '') AS pre_ipl,
  coalesce(right(pos_ipl, 8), '') AS pos_ipl, coalesce(shutdown_duration, '') AS shutdown_duration,
  coalesce(poweroff_duration, '') AS poweroff_duration, coalesce(load_ipl, '') AS load_ipl,
  coalesce(total_duration, '') AS total_duration FROM done""", DONE_CTE)


@q("report_done", sqlr("SELECT * FROM done", DONE_CTE))
def q_report_done(s, sf):
    return R.report_done(done(s, sf))


@q("report_fail", sqlr(f"SELECT {FAIL_COLS_SQL} FROM resume WHERE NOT ({ALL4}) AND ({ANY4})"))
def q_report_fail(s, sf):
    return R.report_fail(RT.fail_rows(resume(s, sf)))


@q("report_last_ipl", sql("SELECT DISTINCT sysname, last_ipl FROM ipled", IPLED_ROWS_CTE))
def q_report_last(s, sf):
    return R.report_last_ipl(ipled_rows(s, sf))


@q("report_format", REPORT_FORMAT_SQL)
def q_report_format(s, sf):
    return R.report_format(R.report_done(done(s, sf)))


SEARCH = "sys1.*w[24]"


@q("report_search", sqlr(f"""SELECT * FROM done WHERE regexp_matches(concat_ws(' ', sysname, ipl_date, log_dataset,
  shutdown_begin, shutdown_end, ipl_begin, ipl_end, coalesce(pre_ipl, ''), coalesce(pos_ipl, ''), shutdown_duration,
  poweroff_duration, load_ipl, total_duration), '(?i){SEARCH}')""", DONE_CTE))
def q_report_search(s, sf):
    return R.report_search(R.report_done(done(s, sf)), SEARCH)


@q("sort_last_ipl", sql("SELECT * FROM ipled ORDER BY sysname, last_ipl", IPLED_ROWS_CTE))
def q_sort_last(s, sf):
    return R.sort_last_ipl(ipled_rows(s, sf))


PAGE_KEYS = ["pre_ipl", "sysname", "log_dataset"]


@q("page_with_nulls", sqlr("SELECT * FROM done ORDER BY pre_ipl NULLS FIRST, sysname, log_dataset LIMIT 60", DONE_CTE))
def q_page_nulls(s, sf):
    """The first six pages one after the other, by a key that is NULL in some rows."""
    report, after, out = written(R.report_done(done(s, sf)), "report"), None, []
    for _ in range(6):
        rows = R.page(report, PAGE_KEYS, 10, after=after).collect()
        out += rows
        after = tuple(rows[-1][k] for k in PAGE_KEYS) if rows else after
    return s.createDataFrame(out, report.schema)


@q("page", sqlr("SELECT * FROM done ORDER BY sysname, log_dataset LIMIT 10 OFFSET 10", DONE_CTE))
def q_page(s, sf):
    """The second page: the one after the last key of the first."""
    report, keys = written(R.report_done(done(s, sf)), "report"), ["sysname", "log_dataset"]
    first = R.page(report, keys, 10).select(*keys).collect()
    return R.page(report, keys, 10, after=tuple(first[-1]) if first else None)
