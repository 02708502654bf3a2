"""File-based queries (sources, sinks, jobs, streaming): each writes data that
Spark derives from the driver's tables to a fresh folder under the shared
checkpoint folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.parse import message_prefilter
from ..operators.reports import report_format
from ..operators.routing import done_rows, unseen_rows
from ..schemas import DONE, RESUME
from ..session import shared_path, written
from ..sinks import (append_parquet, append_table, export_report, import_json_rows, name_files,
                     overwrite_parquet, split_by_system, write_detail, write_json, write_resume)
from ..sources.resume import (CSV_OPTIONS, discover_resume_csv, read_parquet, read_resume_csv,
                              table_exists)
from ..sources.syslog import load_patterns, scan_iplinfo, scan_syslog, write_syslog_text
from ..streaming.ingest import incremental_ingest
from . import oracle as O
from .catalog import (ALL4, ANY4, DETAIL_SQL, DONE_CTE, REPORT_FORMAT_SQL, SQL_WEEK, detail, lines, q, resume, sql,
                      sqlr, week)
from .jobs import (BUCKET, TABLES, build_resume, ingest_results, page_key, parse_logs, report_view, result_table,
                   stored)

DENSE_CTE = """dense AS (SELECT log_dataset, line_no,
  row_number() OVER (PARTITION BY log_dataset ORDER BY line_no) AS dense_no, line FROM syslog)"""


def text_syslog(s, sf):
    path = shared_path(s, "syslog-text")
    write_syslog_text(lines(s, sf), path)
    return path


@q("scan_syslog", sql("SELECT log_dataset, dense_no AS line_no, line FROM dense", DENSE_CTE))
def q_scan_syslog(s, sf):
    return scan_syslog(s, text_syslog(s, sf)).select("log_dataset", "line_no", "line")


@q("line_numbering", sql("SELECT log_dataset, count(*) AS n_lines, max(dense_no) AS last_line FROM dense GROUP BY 1", DENSE_CTE))
def q_line_numbering(s, sf):
    return scan_syslog(s, text_syslog(s, sf)).groupBy("log_dataset").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))


@q("scan_iplinfo", sql("SELECT log_dataset, dense_no AS line_no, trim(line) AS iplinfo FROM dense WHERE contains(line, 'SYSTEM IPLED')", DENSE_CTE))
def q_iplinfo(s, sf):
    return scan_iplinfo(scan_syslog(s, text_syslog(s, sf)))


@q("load_patterns", sql("SELECT log_dataset, count(*) AS n FROM syslog WHERE regexp_matches(line, 'IEA371I|IXC371D|Z EOD') GROUP BY 1"))
def q_load_patterns(s, sf):
    """A pattern file is written, loaded and used by the prefilter."""
    path = shared_path(s, "patterns")
    rows = lines(s, sf).limit(1).select(F.explode(F.array(*[F.lit(p) for p in ("IEA371I", " ", "IXC371D", "Z EOD")])))
    rows.write.text(path)
    kept = message_prefilter(lines(s, sf), patterns=load_patterns(s, path))
    return kept.groupBy("log_dataset").agg(F.count(F.lit(1)).alias("n"))


M1_SQL = sql("""SELECT d.sysname || '_' || d.log_dataset AS log_dataset, n.dense_no AS log_id, d.type, d.error, d.msg,
  strftime(d.event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM detail d
  JOIN dense n ON n.log_dataset = d.log_dataset AND n.line_no = d.log_id
  WHERE d.log_dataset IN (SELECT log_dataset FROM kept_bounds)""", DENSE_CTE)


@q("parse_logs", M1_SQL)
def q_parse_logs(s, sf):
    """M1: with the written detail read back."""
    det = parse_logs(s, text_syslog(s, sf), shared_path(s, "detail"))
    return det.select("log_dataset", "log_id", "type", "error", "msg",
                      F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_ts"))


LATEST = 3


@q("parse_logs_latest", sql(f"""SELECT d.sysname || '_SYSLOG.' || d.log_dataset AS log_dataset, n.dense_no AS log_id, d.type, d.error, d.msg
  FROM detail d JOIN dense n ON n.log_dataset = d.log_dataset AND n.line_no = d.log_id
  WHERE d.log_dataset IN (SELECT log_dataset FROM kept_bounds) AND d.log_dataset IN (SELECT log_dataset FROM
    (SELECT *, row_number() OVER (PARTITION BY sysname ORDER BY log_dataset DESC) AS rn FROM (SELECT DISTINCT sysname, log_dataset FROM syslog)) WHERE rn <= {LATEST})""", DENSE_CTE))
def q_parse_latest(s, sf):
    """M1 on the last logs of each qualifier (SYSLOG.<system>), chosen from the listing; the
    landing also holds folders that are no logs."""
    path = shared_path(s, "syslog-text")
    ln = lines(s, sf)
    both = ln.withColumn("log_dataset", F.concat(F.lit("SYSLOG."), "log_dataset")).unionByName(
        ln.withColumn("log_dataset", F.concat(F.lit("INDEX."), "log_dataset")))
    write_syslog_text(both, path, by_system=True)
    return parse_logs(s, path, latest=LATEST).select("log_dataset", "log_id", "type", "error", "msg")


RENAMED_RESUME = "SELECT * REPLACE (sysname || '_' || log_dataset AS log_dataset) FROM resume"


@q("build_resume", sqlr(RENAMED_RESUME))
def q_build_resume(s, sf):
    return build_resume(parse_logs(s, text_syslog(s, sf), shared_path(s, "detail")))


def _odd(detail_rows):
    """Messages with outer blanks, quotes and separators."""
    return detail_rows.withColumn("msg", F.concat(F.lit('  "a;b"  '), F.col("msg"), F.lit(' ;"" ')))


@q("write_detail", sql(f"SELECT * REPLACE ('  \"a;b\"  ' || msg || ' ;\"\" ' AS msg) FROM ({DETAIL_SQL})"))
def q_write_detail(s, sf):
    path = shared_path(s, "detail")
    write_detail(_odd(detail(s, sf)), path)
    names = ["log_name", "log_id", "date", "time", "system", "type", "error", "last_ipl", "msg"]
    back = s.read.options(**CSV_OPTIONS).schema(", ".join(f"{c} string" for c in [*names, "dataset"])).csv(path)
    return back.select(*names)


@q("write_resume", sqlr("SELECT * FROM resume"))
def q_write_resume(s, sf):
    path = shared_path(s, "resume")
    write_resume(resume(s, sf), path)
    back = s.read.options(**CSV_OPTIONS).schema(", ".join(f"{c} string" for c in [*RESUME.fieldNames(), "system"])).csv(path)
    return back.select(*RESUME.fieldNames())


def _landing(s, sf):
    """<root>/run1 and run2 hold ``<system>_resume.CSV`` files (run2 replaces
    SYS1's, which run1 holds without its rows), beside detail files and a file that is empty but for its header."""
    root = shared_path(s, "landing")
    r = written(resume(s, sf), "resume")
    write_resume(r.withColumn("post_ipl", F.when(F.col("sysname") != "SYS1", F.col("post_ipl"))), f"{root}/run1")
    write_resume(r.filter(F.col("sysname") == "SYS1"), f"{root}/run2")
    write_resume(r.limit(0), f"{root}/empty_resume")
    write_detail(detail(s, sf), f"{root}/resume_detail")
    for run in ("run1", "run2"):
        name_files(s, f"{root}/{run}", "_resume.CSV")
    name_files(s, f"{root}/resume_detail", "_detail.CSV")
    return root


@q("discover_resume_csv", sqlr("SELECT sysname, log_dataset, post_ipl, sysname || '_resume.CSV' AS source_file FROM resume"))
def q_discover(s, sf):
    return discover_resume_csv(s, _landing(s, sf)).select("sysname", "log_dataset", "post_ipl", "source_file")


@q("read_resume_csv", sqlr("SELECT * FROM resume"))
def q_read_resume(s, sf):
    path = shared_path(s, "resume-flat")
    resume(s, sf).write.options(**CSV_OPTIONS).csv(path)
    return read_resume_csv(s, path)


@q("size_guard", sqlr("SELECT sysname, count(*) AS n_rows FROM resume GROUP BY 1"))
def q_size_guard(s, sf):
    """A5: files that hold a header alone give no row; small files keep theirs."""
    path = shared_path(s, "resume-small")
    r = written(resume(s, sf), "resume")
    r.repartition(64, "log_dataset").write.options(**CSV_OPTIONS).csv(path)
    r.limit(0).write.mode("append").options(**CSV_OPTIONS).csv(path)
    return read_resume_csv(s, path).groupBy("sysname").agg(F.count(F.lit(1)).alias("n_rows"))


@q("read_parquet", sqlr("SELECT * FROM resume"))
def q_read_parquet(s, sf):
    path = shared_path(s, "raw-parquet")
    overwrite_parquet(resume(s, sf), path)
    return read_parquet(s, path, RESUME)


@q("append_parquet", sqlr("SELECT * FROM resume UNION ALL SELECT * FROM resume"))
def q_append_parquet(s, sf):
    path = shared_path(s, "append-parquet")
    r = resume(s, sf)
    append_parquet(r, path)
    append_parquet(r, path)
    return s.read.parquet(path)


@q("overwrite_parquet", sqlr("SELECT * FROM resume"))
def q_overwrite(s, sf):
    path = shared_path(s, "overwrite-parquet")
    r = resume(s, sf)
    overwrite_parquet(r, path, partition_by="sysname")
    overwrite_parquet(r.filter(F.col("sysname") == "SYS0"), path, partition_by="sysname")
    return s.read.parquet(path).select(*RESUME.fieldNames())


@q("append_table", sqlr("SELECT * FROM resume UNION ALL SELECT * FROM resume WHERE sysname = 'SYS0'"))
def q_append_table(s, sf):
    """A catalog table, made by the first append."""
    path = shared_path(s, "append-table")
    name = "resume_" + path[-12:]
    r = written(resume(s, sf), "resume")
    append_table(r, name, path)
    append_table(r.filter(F.col("sysname") == "SYS0"), name)
    return s.table(name)


@q("split_by_system", sqlr("SELECT * FROM resume"))
def q_split(s, sf):
    path = shared_path(s, "split")
    split_by_system(resume(s, sf), path)
    back = s.read.options(**CSV_OPTIONS).schema(", ".join(f"{c} string" for c in [*RESUME.fieldNames(), "system"])).csv(f"{path}/by_system")
    return back.select(*RESUME.fieldNames())


@q("write_json", sqlr("SELECT * FROM resume"))
def q_write_json(s, sf):
    path = shared_path(s, "json")
    write_json(resume(s, sf), path)
    return s.read.schema(RESUME).json(path).select(*RESUME.fieldNames())


@q("export_report", sqlr("SELECT * FROM done", DONE_CTE))
def q_export(s, sf):
    path = shared_path(s, "export")
    export_report(done_rows(resume(s, sf)), path)
    return s.read.options(**CSV_OPTIONS).schema(DONE).csv(path)


@q("import_json_rows", sqlr("SELECT * FROM resume"))
def q_import_json(s, sf):
    path = shared_path(s, "import")
    as_json = resume(s, sf).select(F.to_json(F.struct("*")).alias("value"))
    import_json_rows(s, as_json, RESUME, path)
    return s.read.parquet(path)


@q("table_exists", sqlr("SELECT false AS before, true AS after, count(*) AS n_rows FROM resume"))
def q_table_exists(s, sf):
    path = shared_path(s, "absent")
    before, empty = table_exists(s, path), read_parquet(s, path, RESUME)
    unseen_rows(resume(s, sf), empty).write.parquet(path)
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(before).alias("before"), F.lit(table_exists(s, path)).alias("after"), "n_rows")


def _all_tables(s, store):
    """Rows of the five tables, tagged."""
    out = None
    for name in TABLES:
        t = result_table(s, store, name)
        one = t.select(F.lit(name).alias("tab"), "sysname", "log_dataset", *[
            (F.col(c) if c in t.columns else F.lit(None)).cast("string").alias(c)
            for c in ("shutdown_begin", "ipl_end", "last_ipl", "total_duration", "total_elapsed")])
        out = one if out is None else out.unionByName(one)
    return out


def _tables_sql(where="true"):
    cut = f"SELECT sysname, log_dataset, shutdown_begin, ipl_end, NULL AS last_ipl, NULL AS total_duration, NULL AS total_elapsed FROM resume WHERE ({where}) AND"
    return f"""SELECT 'raw_results' AS tab, sysname, log_dataset, shutdown_begin, ipl_end, last_ipl, NULL AS total_duration, total_elapsed FROM resume WHERE {where}
  UNION ALL SELECT 'results_done', sysname, log_dataset, shutdown_begin, ipl_end, NULL, total_duration, NULL FROM done WHERE {where}
  UNION ALL SELECT 'results_fail', * FROM ({cut} NOT ({ALL4}) AND ({ANY4}))
  UNION ALL SELECT 'results_garb', * FROM ({cut} NOT ({ANY4}) AND last_ipl IS NULL)
  UNION ALL SELECT 'results_last_ipl', sysname, log_dataset, NULL, NULL, last_ipl, NULL, NULL FROM resume
    WHERE ({where}) AND NOT ({ANY4}) AND last_ipl IS NOT NULL"""


def _ingest_twice(s, sf):
    store = shared_path(s, "store")
    r = written(resume(s, sf), "resume")
    ingest_results(s, r.filter(F.col("sysname") != "SYS4"), store)
    ingest_results(s, r, store)      # second run: only SYS4 is new
    ingest_results(s, r, store)      # third run: nothing new
    return store


@q("ingest_results", sqlr(_tables_sql(), DONE_CTE))
def q_ingest(s, sf):
    return _all_tables(s, _ingest_twice(s, sf))


@q("ingest_after_failure", sqlr(_tables_sql(), DONE_CTE))
def q_ingest_after_failure(s, sf):
    """A store as a run leaves it that stored raw rows and died: raw is full, all
    sinks are empty; then some sinks are full and raw is not."""
    store, other = shared_path(s, "store"), shared_path(s, "store")
    r = written(resume(s, sf), "resume")
    ingest_results(s, r, other)
    stored(s, other, "raw_results").write.partitionBy(BUCKET).parquet(f"{store}/raw_results")
    stored(s, other, "results_fail").write.partitionBy(BUCKET).parquet(f"{store}/results_fail")
    ingest_results(s, r, store)
    return _all_tables(s, store)


def _spoiled(r, cond):
    """Rows with an end that is no time where ``cond`` holds: done ones fail."""
    return r.withColumn("ipl_end", F.when(cond, "2024-2-30 25:00:00").otherwise(F.col("ipl_end")))


EVEN = f"{SQL_WEEK} % 2 = 0"
CHANGED_CTE = f"resume AS (SELECT * REPLACE (CASE WHEN {EVEN} THEN '2024-2-30 25:00:00' ELSE ipl_end END AS ipl_end) FROM ({O.RESUME_SELECT}))"


def _changed_sql():
    valid = ALL4.replace("ipl_end IS NOT NULL", f"ipl_end IS NOT NULL AND NOT ({EVEN})")
    done_cte = DONE_CTE.replace(ALL4, valid)
    body = _tables_sql().replace(ALL4, valid).replace("resume", "changed").replace("done WHERE", "done WHERE")
    body = body.replace("'changed", "'resume")
    return O.with_base(CHANGED_CTE.replace("resume AS", "changed AS", 1) + "," + done_cte.replace("FROM resume", "FROM changed"), body)


@q("ingest_changed_row", _changed_sql())
def q_ingest_changed(s, sf):
    """Datasets of even weeks come with an invalid end first and corrected later, with the
    others: a known dataset changes nowhere, and no dataset is in two routes."""
    store = shared_path(s, "store")
    r = written(resume(s, sf), "resume")
    even = week() % 2 == 0
    ingest_results(s, _spoiled(r, even).filter(even), store)
    ingest_results(s, r, store)
    ingest_results(s, r, store)
    return _all_tables(s, store)


@q("ingest_empty_first", sqlr(_tables_sql(), DONE_CTE))
def q_ingest_empty(s, sf):
    """An empty first batch is no error and leaves nothing behind."""
    store = shared_path(s, "store")
    r = written(resume(s, sf), "resume")
    ingest_results(s, r.limit(0), store)
    ingest_results(s, r, store)
    return _all_tables(s, store)


@q("report_view", REPORT_FORMAT_SQL)
def q_report_view(s, sf):
    return report_view(s, _ingest_twice(s, sf), "done")


VIEW_KEYS, VIEW_SEARCH = ["pre_ipl", "sysname", "log_dataset"], "sys[0134].* 0[0-9]:"


@q("report_view_page", REPORT_FORMAT_SQL.replace("FROM done", f"""FROM done WHERE regexp_matches(concat_ws(' ', upper(coalesce(sysname, '')),
  coalesce(ipl_date, ''), coalesce(log_dataset, ''), coalesce(right(shutdown_begin, 8), ''), coalesce(right(shutdown_end, 8), ''), coalesce(right(ipl_begin, 8), ''),
  coalesce(right(ipl_end, 8), ''), coalesce(right(pre_ipl, 8), ''), coalesce(right(pos_ipl, 8), ''), shutdown_duration, poweroff_duration,
  load_ipl, total_duration), '(?i){VIEW_SEARCH}') ORDER BY done.pre_ipl NULLS FIRST, done.sysname, done.log_dataset LIMIT 4 OFFSET 4"""))
def q_report_page(s, sf):
    """M4: search over the stored done table, second page in the order of a key that may be NULL."""
    store = _ingest_twice(s, sf)
    after = page_key(s, store, "done", VIEW_KEYS, 4, VIEW_SEARCH)
    return report_view(s, store, "done", search=VIEW_SEARCH, order=VIEW_KEYS, page_size=4, after=after)


@q("incremental_rewritten", sqlr(_tables_sql(), DONE_CTE))
def q_incremental_rewritten(s, sf):
    """K1: each system's file is written, ingested, and rewritten under its name with more rows."""
    landing, store, ckpt = (shared_path(s, n) for n in ("stream-landing", "stream-store", "stream-checkpoint"))
    r = written(resume(s, sf), "resume")
    for rows in (r.filter(week() % 2 == 0), r, r):
        write_resume(rows, f"{landing}/results")
        name_files(s, f"{landing}/results", "_resume.CSV")
        incremental_ingest(s, landing, store, ckpt)
    return _all_tables(s, store)


def _boundary_report(cond):
    four = ", ".join(f"coalesce(right({c}, 8), '') AS {c}" for c in ("shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end", "pre_ipl"))
    return sqlr(f"""SELECT upper(coalesce(sysname, '')) AS sysname, coalesce(log_dataset, '') AS log_dataset, {four},
  coalesce(right(post_ipl, 8), '') AS pos_ipl FROM resume WHERE {cond}""")


@q("report_view_fail", _boundary_report(f"NOT ({ALL4}) AND ({ANY4})"))
def q_report_view_fail(s, sf):
    return report_view(s, _ingest_twice(s, sf), "fail")


@q("report_view_garbage", _boundary_report(f"NOT ({ANY4}) AND last_ipl IS NULL"))
def q_report_view_garbage(s, sf):
    return report_view(s, _ingest_twice(s, sf), "garbage")


@q("report_view_last_ipl", sqlr(f"""SELECT DISTINCT upper(sysname) AS sysname, right(last_ipl, 8) AS last_ipl, last_ipl AS full_last_ipl
  FROM resume WHERE NOT ({ANY4}) AND last_ipl IS NOT NULL"""))
def q_report_view_last(s, sf):
    plain = report_view(s, _ingest_twice(s, sf), "last_ipl", formatted=False).withColumn("full_last_ipl", F.col("last_ipl"))
    return report_format(plain)


@q("incremental_ingest", sqlr(_tables_sql(), DONE_CTE))
def q_incremental(s, sf):
    """K1: nested landing folders with detail files beside the resume files."""
    landing = shared_path(s, "stream-landing")
    store = shared_path(s, "stream-store")
    ckpt = shared_path(s, "stream-checkpoint")
    r = written(resume(s, sf), "resume")
    write_resume(r.filter(F.col("sysname").isin("SYS0", "SYS1")), f"{landing}/run1/host")
    name_files(s, f"{landing}/run1/host", "_resume.CSV")
    write_detail(detail(s, sf), f"{landing}/run1/resume")
    name_files(s, f"{landing}/run1/resume", "_detail.CSV")
    incremental_ingest(s, landing, store, ckpt)
    write_resume(r, f"{landing}/run2/a/b")      # overlaps run1: those datasets are skipped
    name_files(s, f"{landing}/run2/a/b", "_resume.CSV")
    incremental_ingest(s, landing, store, ckpt)
    incremental_ingest(s, landing, store, ckpt)   # nothing new
    return _all_tables(s, store)
