"""Files below a folder as rows, without reading them, and scans of chosen files only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of files or folders that are filtered as literals; a longer selection is joined.
MAX_LISTED = 100_000


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, modified, length) of every file below ``root`` whose name fits ``glob``.  ``path`` is
    what ``_metadata.file_path`` gives; no content is read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(root)
    meta = F.col("_metadata")
    return files.select(meta["file_path"].alias("path"), meta["file_name"].alias("name"),
                        meta["file_modification_time"].alias("modified"), meta["file_size"].alias("length"))


def only(rows: DataFrame, key: Column, chosen: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in the one column of ``chosen``.  Up to ``MAX_LISTED`` values are a
    literal filter, by which a scan leaves out folders and files; more are a semi-join."""
    names = [r[0] for r in chosen.distinct().limit(MAX_LISTED + 1).collect()]
    if len(names) <= MAX_LISTED:
        return rows.filter(key.isin(names))
    chosen = chosen.select(F.col(chosen.columns[0]).alias("_chosen")).distinct()
    return rows.join(chosen, key == F.col("_chosen"), "left_semi")
