"""Writers: B1-B8, B10.  One write per sink per run (never one file per row).

Partitioned outputs are clustered first (``rebalance``): rows of a folder come
together into one file, and AQE splits a folder only where it exceeds the
advisory partition size, so neither many small files nor one huge task arise.
Text is written unchanged (no trimming, quotes doubled)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefmt import ipled_text
from ..schemas import DETAIL_COLUMNS
from ..sources.resume import CSV_OPTIONS


def detail_text(detail: DataFrame) -> DataFrame:
    """Detail rows as the 9 named text columns of the detail CSV."""
    return detail.select(
        F.col("log_dataset").alias("log_name"),
        F.col("log_id").cast("string").alias("log_id"),
        F.date_format("event_date", "yyyy-M-d").alias("date"),
        F.col("event_time").alias("time"),
        F.col("sysname").alias("system"),
        "type", "error",
        ipled_text("last_ipl_ts").alias("last_ipl"),
        "msg").select(*DETAIL_COLUMNS)


def clustered(df: DataFrame, column: str) -> DataFrame:
    """Rows of one value of ``column`` together, large values split by size."""
    return df.hint("rebalance", F.col(column))


def _csv(df: DataFrame, path: str, folder: str | None = None, of: str | None = None) -> str:
    """CSV below ``path``; with ``folder``, one folder ``<folder>=<value of the
    column of>`` each, the files keeping all columns."""
    if folder:
        df = clustered(df.withColumn(folder, F.col(of)), folder)
    w = df.write.mode("overwrite").options(**CSV_OPTIONS)
    (w.partitionBy(folder) if folder else w).csv(path)
    return path


def write_detail(detail: DataFrame, path: str) -> str:
    """B1: one ``;`` CSV folder with header per log dataset (``dataset=<name>``);
    ``sources.resume.read_detail`` reads it back."""
    return _csv(detail_text(detail), path, "dataset", "log_name")


def write_resume(resume: DataFrame, path: str) -> str:
    """B2: resume CSV, one folder per system (``system=<name>``)."""
    return _csv(resume, path, "system", "sysname")


def name_files(spark: SparkSession, path: str, suffix: str) -> int:
    """Give the part files of each ``<key>=<value>`` folder of ``path`` the name
    ``<value><suffix>`` (``<value>.<k><suffix>`` if a folder holds several), as
    discovery by file name expects it; returns how many were named.  A run that ended half-way is
    taken up by the next: named files stay, the others get the names still free, as one run would have
    given them.  Folders come from an iterator, so the driver holds the names of one folder at a time."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders, named = fs.listStatusIterator(root), 0
    while folders.hasNext():
        folder = folders.next()
        value = folder.getPath().getName().partition("=")[2]
        if not folder.isDirectory() or not value:
            continue
        names = {f.getPath().getName() for f in fs.listStatus(folder.getPath())}
        ours = re.compile(re.escape(value) + r"(\.\d+)?" + re.escape(suffix))
        parts, k = sorted(n for n in names if n.startswith("part-") and not ours.fullmatch(n)), 0
        for part in parts:
            while (name := f"{value}{f'.{k}' if k else ''}{suffix}") in names:
                k += 1
            target = jvm.org.apache.hadoop.fs.Path(folder.getPath(), name)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(folder.getPath(), part), target):
                raise OSError(f"cannot name {target}")
            names.add(name)
            named += 1
    return named


def append_parquet(df: DataFrame, path: str) -> str:
    """B3."""
    df.write.mode("append").parquet(path)
    return path


def overwrite_parquet(df: DataFrame, path: str, partition_by=None) -> str:
    """Full overwrite; with ``partition_by`` only the partitions present
    in ``df`` are replaced (dynamic partition overwrite)."""
    w = (clustered(df, partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    w.parquet(path)
    return path


def append_table(df: DataFrame, table: str, location: str | None = None) -> str:
    """Append to a catalog table (name; created at ``location``, if given,
    when it does not exist) or a parquet table (path)."""
    if "/" in table:
        return append_parquet(df, table)
    w = df.write.mode("append").format("parquet")
    if location and not df.sparkSession.catalog.tableExists(table):
        w = w.option("path", location)
    w.saveAsTable(table)
    return table


def split_by_system(resume: DataFrame, path: str) -> str:
    """One CSV (with header) per system, plus a header-only ``empty``
    file, split on equality of the system column."""
    _csv(resume, f"{path}/by_system", "system", "sysname")
    _csv(resume.limit(0), f"{path}/empty")
    return path


def write_json(df: DataFrame, path: str) -> str:
    """B7."""
    df.write.mode("overwrite").json(path)
    return path


def export_report(report: DataFrame, path: str) -> str:
    """Export of the displayed report as CSV with header, text unchanged."""
    report.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def import_json_rows(spark: SparkSession, json_rows: DataFrame, schema: T.StructType,
                     table_path: str, column: str = "value") -> DataFrame:
    """JSON text rows -> typed rows -> appended to a table; returns the rows.
    A row that is no JSON object of the schema fails the import, and nothing is stored."""
    parsed = json_rows.select(F.from_json(F.col(column), schema, {"mode": "FAILFAST"}).alias("r"))
    checked = F.when(F.col("r").isNull(), F.raise_error(F.lit("not a JSON object"))).otherwise(F.col("r"))
    parsed = parsed.select(checked.alias("r")).select("r.*")
    append_parquet(parsed, table_path)
    return parsed
