"""Resume CSV and result-table sources: A3-A6, A11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalogue as cat
from ..schemas import DETAIL_COLUMNS, RESUME
from .listing import list_files, only

#: ``;`` CSV as the sinks write it: text unchanged, a wrong header fails.
CSV_OPTIONS = {"sep": ";", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def table_exists(spark: SparkSession, path_or_name: str) -> bool:
    """A catalog table of that name, or a folder at that path."""
    if "/" not in path_or_name and spark.catalog.tableExists(path_or_name):
        return True
    return "/" in path_or_name and _fs_exists(spark, path_or_name)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A6 (+A11): a result table, always with ``schema`` when one is given (text
    stays text, an empty folder is no error); an empty frame when it does
    not exist yet, so first-load and incremental runs are one plan."""
    if schema is None:
        return spark.read.parquet(path)
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_resume_csv(spark: SparkSession, paths) -> DataFrame:
    """A4: ``;`` CSV with header, all text, fixed schema.  A5: a file that
    holds its header alone gives no row, whatever its size."""
    return spark.read.options(**CSV_OPTIONS, enforceSchema=False).schema(RESUME).csv(paths)


def list_resume_files(spark: SparkSession, root: str) -> DataFrame:
    """A3: (path, name, modified, length) of every CSV below ``root`` (recursive) whose *file name*
    holds ``resume``; of files of one name the one found last (greatest path).  No file is read."""
    files = list_files(spark, root, cat.RESUME_FILE_GLOB).where(F.col("name").rlike(cat.RESUME_FILE_PATTERN))
    last = files.groupBy("name").agg(F.max_by(F.struct("path", "modified", "length"), "path").alias("f"))
    return last.select("f.path", "name", "f.modified", "f.length")


def read_listed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Rows of the files below ``root`` that ``files`` names by ``path``, with ``source_file``; others are not opened."""
    df = (spark.read.options(**CSV_OPTIONS, recursiveFileLookup=True, pathGlobFilter=cat.RESUME_FILE_GLOB,
                             enforceSchema=False).schema(RESUME).csv(root))
    df = only(df, F.col("_metadata.file_path"), files.select("path"))
    return df.select(*RESUME.fieldNames(), F.col("_metadata.file_name").alias("source_file"))


def discover_resume_csv(spark: SparkSession, root: str) -> DataFrame:
    """A3 + A4: rows of the files that ``list_resume_files`` finds, with the file they came from; the
    winners are chosen before any row is read."""
    return read_listed(spark, root, list_resume_files(spark, root))


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    """Detail rows (T3) of the files that ``write_detail`` makes, typed as the
    reducer takes them: log_dataset, sysname, log_id, type, error, event_ts,
    last_ipl_ts, msg."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in DETAIL_COLUMNS])
    rows = spark.read.options(**CSV_OPTIONS).schema(text.add("dataset", T.StringType())).csv(path)
    when = F.when(F.col("date").isNotNull() & F.col("time").isNotNull(), F.concat_ws(" ", "date", "time"))
    return rows.select(
        F.col("log_name").alias("log_dataset"), F.col("system").alias("sysname"),
        F.col("log_id").cast("bigint").alias("log_id"), "type", "error",
        F.try_to_timestamp(when, F.lit("yyyy-M-d H:m:s")).alias("event_ts"),
        F.try_to_timestamp("last_ipl", F.lit("yyyy-MM-dd HH:mm:ss")).alias("last_ipl_ts"), "msg")
