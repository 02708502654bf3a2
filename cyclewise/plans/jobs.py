"""Composite jobs M1-M4: parse logs, build resume rows, ingest results,
serve report views.  Each is one set-based DataFrame plan per sink (no
driver-side key lists, no per-row jobs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalogue import prefilter_regex
from ..functions.timefmt import dataset_name
from ..operators.boundaries import cycle_boundaries, datasets_with_ipl, detail_with_ipl
from ..operators.parse import parse_lines
from ..operators.reports import (page, report_done, report_fail, report_format,
                                  report_last_ipl, report_search)
from ..operators.resume import resume_rows
from ..operators.routing import (done_condition, done_rows, fail_condition, fail_rows,
                                 garbage_condition, garbage_rows, last_ipl_condition,
                                 last_ipl_rows, same_key, unseen_rows)
from ..schemas import DONE, FAIL, GARB, LAST_IPL, RESUME
from ..session import written
from ..sinks import clustered, write_detail
from ..sources.resume import read_detail, read_parquet, table_exists
from ..sources.syslog import list_log_datasets, scan_matching, select_log_datasets

SINKS = {"results_done": DONE, "results_fail": FAIL, "results_garb": GARB,
         "results_last_ipl": LAST_IPL}
TABLES = {"raw_results": RESUME, **SINKS}
VIEWS = {"done": "results_done", "fail": "results_fail", "last_ipl": "results_last_ipl",
         "garbage": "results_garb"}
REPORTS = {"done": report_done, "fail": report_fail, "garbage": report_fail, "last_ipl": report_last_ipl}
#: Stored tables are partitioned by a hash bucket of the system: a bounded
#: number of folders, and NULL, empty and numeric names stay as they are.
BUCKET = "system_bucket"
BUCKETS = 64
KEY = ["sysname", "log_dataset"]
#: Which rows a sink takes, under a rule.
ROUTES = {"results_done": lambda rule: done_condition(), "results_fail": fail_condition, "results_garb": garbage_condition,
          "results_last_ipl": last_ipl_condition}
#: Raw rows that finished runs have added to each bucket: one row a run and bucket.
RUN_LOG = "run_log"
LOG = T.StructType([T.StructField("n", T.LongType()), T.StructField(BUCKET, T.IntegerType())])
#: Batches of up to so many datasets look them up one by one.
LOOKUP = 1000
IN_THRESHOLD = "spark.sql.parquet.pushdown.inFilterThreshold"


def parse_logs(spark: SparkSession, syslog_path: str, detail_path: str | None = None,
               sysname: str | None = None, patterns: str | None = None, latest: int | None = None,
               dataset_from: str = "partition") -> DataFrame:
    """M1: syslog text -> numbered lines of the prefilter -> detail rows of the datasets that show an
    IPL message (D11), named ``<system>_<dataset>`` (C10).

    With ``latest``, only the last that many log datasets of each qualifier are read, chosen from a
    listing of the files (A2): the others are not opened.  The text is scanned once, its matching lines are parsed
    once; D11 looks at the parsed rows.  With ``detail_path`` they are written there (B1) and read back.
    """
    chosen = None
    if latest is not None:
        chosen = select_log_datasets(list_log_datasets(spark, syslog_path, dataset_from), latest).select("key")
    lines = scan_matching(spark, syslog_path, patterns or prefilter_regex(), sysname, dataset_from, chosen)
    detail = detail_with_ipl(written(parse_lines(lines, prefilter=False), "detail"))
    if dataset_from == "partition":
        detail = detail.withColumn("log_dataset", dataset_name("sysname", "log_dataset"))
    if detail_path is None:
        return detail
    write_detail(detail, detail_path)
    return read_detail(spark, detail_path)


def build_resume(detail: DataFrame, mode: str = "exact") -> DataFrame:
    """M2: detail -> boundaries (F1-F3) -> D11 -> resume rows."""
    return resume_rows(datasets_with_ipl(cycle_boundaries(detail)), mode)


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _bucket():
    return F.pmod(F.xxhash64(F.col("sysname")), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, store_root: str, table: str) -> DataFrame:
    """A stored table with its partition column."""
    schema = T.StructType([*TABLES[table].fields, T.StructField(BUCKET, T.IntegerType())])
    return read_parquet(spark, _path(store_root, table), schema)


def _append(df: DataFrame, store_root: str, table: str) -> None:
    """Append rows to their buckets; files are sorted by (system, dataset) and carry a Bloom filter of the dataset, so
    that a lookup of a few datasets skips the row groups without them."""
    rows = clustered(df.withColumn(BUCKET, _bucket()), BUCKET).sortWithinPartitions(BUCKET, *KEY)
    (rows.write.mode("append").option(f"parquet.bloom.filter.enabled#{KEY[1]}", "true")
     .partitionBy(BUCKET).parquet(_path(store_root, table)))


def lookup(spark: SparkSession, store_root: str, table: str, buckets: list[int], datasets: list[str] | None) -> DataFrame:
    """Keys (sysname, log_dataset) that a stored table holds in these buckets; with
    ``datasets``, of these only (a filter that reaches the files' Bloom filters)."""
    rows = stored(spark, store_root, table).where(F.col(BUCKET).isin(buckets))
    if datasets is not None:
        rows = rows.where(F.col("log_dataset").isin(datasets) | F.col("log_dataset").isNull() if None in datasets
                          else F.col("log_dataset").isin(datasets))
    return rows.select(*KEY)


def _unlogged(spark: SparkSession, store_root: str, buckets: list[int]) -> dict[int, int]:
    """Raw rows of each bucket that no finished run has logged (of the buckets that have some)."""
    raw = stored(spark, store_root, "raw_results").where(F.col(BUCKET).isin(buckets)).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"))
    log = read_parquet(spark, _path(store_root, RUN_LOG), LOG).where(F.col(BUCKET).isin(buckets)).select(BUCKET, (-F.col("n")).alias("n"))
    left = raw.unionByName(log).groupBy(BUCKET).agg(F.sum("n").alias("n")).where("n <> 0")
    return {r[0]: r[1] for r in left.collect()}


def ingest_results(spark: SparkSession, resume: DataFrame, store_root: str,
                   rule: str = "unified") -> dict:
    """M3: idempotent ingest of resume rows into raw + result tables.

    One owner for every (system, dataset), told before anything is routed: its raw rows.  A batch row of a
    dataset that a table holds already changes nothing, whatever it says (a corrected result of a known
    dataset is skipped everywhere, as a known dataset is); if only sinks hold it, the row is
    taken into raw when it routes to one of them.  New rows go to raw first, then to the
    sinks they route to (D3-D6), and at last the run logs how many raw rows each bucket has gained.
    So where the log and the raw table disagree, a run died in between: all raw rows of
    these buckets are routed again, and each sink takes those whose dataset it does not hold (E2, E3).
    Running it twice with the same input changes nothing, and after any run that ends every table is complete.

    Cost: a batch of up to ``LOOKUP`` datasets looks them up through Bloom filters in the buckets of its systems, so it
    reads row groups that may hold them, row counts from the files' footers, and the log; larger
    batches read the key columns of their buckets.  Nothing of the history is routed again unless a run died.
    """
    batch = written(resume.select(*RESUME.fieldNames()).dropDuplicates().withColumn(BUCKET, _bucket()), "batch")
    found = batch.select(BUCKET, "log_dataset").distinct().limit(LOOKUP + 1).collect()
    few = list({r[1] for r in found}) if len(found) <= LOOKUP else None
    touched = sorted({r[0] for r in found} if few is not None else {r[0] for r in batch.select(BUCKET).distinct().collect()})
    tables = [t for t in TABLES if table_exists(spark, _path(store_root, t))]
    threshold = spark.conf.get(IN_THRESHOLD)
    spark.conf.set(IN_THRESHOLD, str(LOOKUP))   # longer lists would reach the files as a range only
    try:
        left = _unlogged(spark, store_root, touched) if tables else {}
        told = batch.withColumn("tabs", F.lit(None).cast("array<string>"))
        if tables:
            held = [lookup(spark, store_root, t, touched, few).withColumn("tab", F.lit(t)) for t in tables]
            claims = reduce(DataFrame.unionByName, held).groupBy(*KEY).agg(F.collect_set("tab").alias("tabs"))
            told = batch.join(claims, same_key(batch, claims), "left").select(*[batch[c] for c in batch.columns], "tabs")
        goes = F.array_compact(F.array(*[F.when(cond(rule), F.lit(t)) for t, cond in ROUTES.items()]))
        told = written(told.withColumn("goes", goes), "claims")
        orphan = F.expr("NOT array_contains(tabs, 'raw_results') AND arrays_overlap(tabs, goes)")
        new = F.col("tabs").isNull()
        gains = told.groupBy(BUCKET).agg(F.count_if(new | orphan).alias("n"),
                                         *[F.count_if(new & F.array_contains("goes", t)).alias(t) for t in SINKS]).collect()
        if any(g["n"] for g in gains):
            _append(told.where(new | orphan).select(*RESUME.fieldNames()), store_root, "raw_results")
        rows = told.where(new).select(*RESUME.fieldNames())
        if left:
            broken = stored(spark, store_root, "raw_results").where(F.col(BUCKET).isin(list(left)))
            rows = written(rows.unionByName(broken.select(*RESUME.fieldNames())).dropDuplicates(), "candidates")
        routed = {"results_done": lambda: done_rows(rows), "results_fail": lambda: fail_rows(rows, rule),
                  "results_garb": lambda: garbage_rows(rows, rule), "results_last_ipl": lambda: last_ipl_rows(rows, rule)}
        for table, delta in routed.items():
            if left:
                _append(unseen_rows(delta(), lookup(spark, store_root, table, touched, None), KEY), store_root, table)
            elif any(g[table] for g in gains):
                _append(delta().dropDuplicates(), store_root, table)
        gained = _unlogged(spark, store_root, touched) if left else {g[BUCKET]: g["n"] for g in gains if g["n"]}
        if gained:
            log = spark.createDataFrame([(n, b) for b, n in gained.items()], LOG)
            log.coalesce(1).write.mode("append").parquet(_path(store_root, RUN_LOG))
    finally:
        spark.conf.set(IN_THRESHOLD, threshold)
    return {table: _path(store_root, table) for table in TABLES}


def result_table(spark: SparkSession, store_root: str, table: str) -> DataFrame:
    return stored(spark, store_root, table).select(*TABLES[table].fieldNames())


def report_view(spark: SparkSession, store_root: str, view: str, formatted: bool = True, search: str | None = None,
                order: list[str] | None = None, page_size: int | None = None, after: tuple | None = None) -> DataFrame:
    """M4: report rows of a view in {done, fail, last_ipl, garbage}; ``search`` keeps the rows whose displayed text
    matches (D12), ``order`` with ``page_size`` gives one page (H3): the first, or the one after the key ``after``
    (stored values of the ``order`` columns of the last row seen, as ``page_key`` reads them)."""
    rep = REPORTS[view](result_table(spark, store_root, VIEWS[view]))
    if search is not None:
        rep = report_search(rep, search, displayed=formatted)
    if page_size is not None:
        rep = page(rep, order or rep.columns, page_size, after)
    return report_format(rep) if formatted else rep


def page_key(spark: SparkSession, store_root: str, view: str, order: list[str], page_size: int, search: str | None = None,
             after: tuple | None = None) -> tuple | None:
    """The key that the page after this one starts behind; None if this page is empty."""
    rep = REPORTS[view](result_table(spark, store_root, VIEWS[view]))
    if search is not None:
        rep = report_search(rep, search, displayed=True)
    last = page(rep, order, page_size, after).select(*order).tail(1)
    return tuple(last[0]) if last else None
