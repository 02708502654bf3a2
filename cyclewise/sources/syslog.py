"""Syslog text sources: A1 scan with original line numbers, A2 dataset
listing, A9 message patterns, A10 restart-info lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.timefmt import dataset_name
from ..operators.parse import matches
from ..session import written
from .listing import list_files, only

MAX_PATTERNS = 10_000
#: Consecutive lines of a split whose matches share a row.
LINES_A_ROW = 1 << 16


def _text_lines(spark: SparkSession, path: str, sysname: str | None, dataset_from: str, datasets) -> DataFrame:
    """Non-empty lines with their dataset, system and split; ``datasets`` (names as
    ``list_log_datasets`` gives them) prunes folders or files before any text is read."""
    reader = spark.read.option("recursiveFileLookup", dataset_from == "file")
    if dataset_from == "partition":
        # folder names are text: without a schema 0042 would become a number
        reader = reader.schema("value string, log_dataset string")
    raw = reader.text(path)
    if datasets is not None:
        raw = only(raw, F.col("log_dataset" if dataset_from == "partition" else "_metadata.file_path"), datasets)
    parts = F.split(F.col("_metadata.file_path"), "/")
    meta = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("bigint").alias("_task"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_name").alias("_name"), F.element_at(parts, -2).alias("_folder"))
    if dataset_from == "file":
        system = F.col("_folder") if sysname is None else F.lit(sysname)
        name = F.col("_name") if sysname is None else F.concat_ws(".", "_folder", "_name")
        meta = meta.withColumn("log_dataset", dataset_name(system, name)).withColumn("sysname", system)
    elif sysname is not None:
        meta = meta.withColumn("sysname", F.lit(sysname))
    elif "sysname" not in raw.columns:
        meta = meta.withColumn("sysname", F.regexp_extract("log_dataset", "^([^._]+)", 1))
    meta = meta.withColumn("sysname", F.col("sysname").cast("string"))
    return meta.filter(F.length("value") > 0).withColumn("_mid", F.monotonically_increasing_id())


_DATASET = ["sysname", "log_dataset"]
_SPLIT = ["_task", "_file", "_block"]


def _offsets(splits: DataFrame) -> Column:
    """Lines of the dataset before a split, from a table of splits with their count ``_n``."""
    order = Window.partitionBy(*_DATASET).orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(order), F.lit(0))


def scan_syslog(spark: SparkSession, path: str, sysname: str | None = None,
                dataset_from: str = "partition", datasets: DataFrame | None = None) -> DataFrame:
    """A1 + G2: read log datasets as ``(log_dataset, sysname, line_no, line)``.

    ``dataset_from='partition'``: a dataset is a ``log_dataset=<name>`` folder of
    part files, read in the order of their task numbers; its system is the
    ``sysname=`` folder if there is one, else the name up to ``.`` or ``_``.
    ``dataset_from='file'``: a dataset is one file, its system the folder that
    holds it, and its name ``<system>_<file>`` (C10); with a ``sysname`` the
    folder goes into the name instead, so files of one name never mix.
    ``datasets``: read these only (``list_log_datasets``).

    Line numbers are the original positions counting non-empty lines only,
    assigned without ever putting a whole dataset into one task:

    1. every scan split is summarised by a partial aggregate (line count and
       first row id of the split, ``monotonically_increasing_id`` being
       consecutive inside a split);
    2. a window over the small split table gives each split's offset;
    3. the offsets are joined back to the lines (AQE broadcasts them when
       they measure small).

    All lines are wanted here, so the text is read twice rather than copied; where a filter
    keeps some of them, ``scan_matching`` reads it once.
    """
    lines = _text_lines(spark, path, sysname, dataset_from, datasets)
    splits = lines.groupBy(*_DATASET, *_SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = splits.select("_file", "_block", "_first", _offsets(splits).alias("_offset"))
    return (lines.join(offsets, ["_file", "_block"])
            .select("log_dataset", "sysname",
                    (F.col("_offset") + F.col("_mid") - F.col("_first") + 1).cast("bigint").alias("line_no"),
                    F.col("value").alias("line")))


def scan_matching(spark: SparkSession, path: str, pattern: str, sysname: str | None = None,
                  dataset_from: str = "partition", datasets: DataFrame | None = None) -> DataFrame:
    """The lines of ``scan_syslog`` that match ``pattern``, with the same numbers, in one scan of the text.

    Each split becomes a row: how many lines it has and which of them match, with their
    place in the split.  These rows are written to the shared folder; offsets come from their counts alone (other columns
    are not read), and a line's number is its split's offset and its place.  A row holds at most the
    lines of ``LINES_A_ROW`` consecutive lines of a split.
    """
    lines = _text_lines(spark, path, sysname, dataset_from, datasets)
    kept = F.when(matches(F.col("value"), pattern), F.struct(F.col("_mid").alias("at"), F.col("value").alias("line")))
    # ids start anew at each split of a task, so a stretch is counted from multiples of the id
    stretch = F.floor(F.col("_mid") / LINES_A_ROW).alias("_stretch")
    splits = lines.groupBy(*_DATASET, *_SPLIT, stretch).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), F.collect_list(kept).alias("_kept"))
    splits = written(splits, "matching-lines")
    order = Window.partitionBy(*_DATASET).orderBy(*_SPLIT, "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    places = splits.select("_file", "_block", "_stretch", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"))
    rows = splits.where(F.size("_kept") > 0).join(places, ["_file", "_block", "_stretch"])
    rows = rows.select(*_DATASET, "_offset", "_first", F.explode("_kept").alias("_k"))
    return rows.select("log_dataset", "sysname", (F.col("_offset") + F.col("_k.at") - F.col("_first") + 1).cast("bigint").alias("line_no"),
                       F.col("_k.line").alias("line"))


def list_log_datasets(spark: SparkSession, path: str, dataset_from: str = "partition") -> DataFrame:
    """A2 source: the log datasets below ``path`` from a listing of files, without reading any: (qualifier, list_pos,
    name, key, n_files, n_bytes).  ``name`` is the dataset's folder value or file name, ``qualifier`` the name up to its
    last dot (the folder, for files), ``list_pos`` its place in name order; ``key`` is what ``scan_syslog`` takes in
    ``datasets``."""
    files = list_files(spark, path)
    if dataset_from == "file":
        files = files.select("length", "name", F.element_at(F.split("path", "/"), -2).alias("qualifier"), F.col("path").alias("key"))
    else:
        # escaped twice, as the value of a folder and as a part of a url; + stands for itself in both
        value = F.regexp_extract("path", "/log_dataset=([^/]*)/", 1)
        for _ in range(2):
            value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
        files = files.where(F.col("path").rlike("/log_dataset=[^/]*/")).select("length", value.alias("name"))
        files = files.withColumn("qualifier", F.regexp_replace("name", "[.][^.]*$", "")).withColumn("key", F.col("name"))
    names = files.groupBy("qualifier", "name", "key").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    place = F.row_number().over(Window.partitionBy("qualifier").orderBy("name", "key"))
    return names.select("qualifier", place.cast("bigint").alias("list_pos"), "name", "key", "n_files", "n_bytes")


def write_syslog_text(lines: DataFrame, path: str, by_system: bool = False) -> str:
    """Write ``(log_dataset, line_no, line)`` as text, one folder per dataset (``by_system``: below
    one per system), lines in log order: range partitioning keeps every task bounded, and part
    files of one folder read back in name order = range order."""
    folders = ["sysname", "log_dataset"] if by_system else ["log_dataset"]
    (lines.repartitionByRange(*folders, "line_no")
     .sortWithinPartitions(*folders, "line_no")
     .select(*folders, "line")
     .write.mode("overwrite").partitionBy(*folders).text(path))
    return path


def load_patterns(spark: SparkSession, path: str | None = None) -> str:
    """Message patterns OR-ed into one regex, for ``parse_lines(patterns=)``:
    from a one-pattern-per-line file when given (at most ``MAX_PATTERNS``; a
    longer file is refused, it is not a pattern list), else the fixed catalogue."""
    if path is None:
        return cat.prefilter_regex()
    rows = spark.read.text(path).select(F.trim("value").alias("p")).filter(F.length("p") > 0).take(MAX_PATTERNS + 1)
    if not 0 < len(rows) <= MAX_PATTERNS:
        raise ValueError(f"{path}: {len(rows)} patterns; 1 to {MAX_PATTERNS} are expected")
    return "|".join(r["p"] for r in rows)


def scan_iplinfo(lines: DataFrame) -> DataFrame:
    """A10: trimmed ``SYSTEM IPLED`` lines of each log (all of it)."""
    return (lines.filter(F.col("line").contains(cat.SYSTEM_IPLED_TOKEN))
            .select("log_dataset", "line_no", F.trim("line").alias("iplinfo")))


def _log_names(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("name").contains(cat.DATASET_NAME_MUST_CONTAIN)
                          & ~F.col("name").contains(cat.DATASET_LISTING_SKIP))


def select_log_datasets(listing: DataFrame, n: int) -> DataFrame:
    """A2 + G3: from a catalogue listing ``(qualifier, list_pos, name)`` keep
    names holding ``LOG`` (not ``IN-CAT``), the last ``n`` per qualifier in
    list order (the source application asks for
    ``catalogue.DATASETS_KEPT_PER_QUALIFIER``)."""
    return latest_n_per_key(_log_names(listing), "qualifier", "list_pos", n)


def first_last_log_datasets(listing: DataFrame, n: int) -> DataFrame:
    """H2: the first and the last ``n`` log names per qualifier, ``side`` telling which."""
    names = _log_names(listing)
    first = first_n_per_key(names, "qualifier", "list_pos", n).withColumn("side", F.lit("first"))
    return first.unionByName(latest_n_per_key(names, "qualifier", "list_pos", n).withColumn("side", F.lit("last")))


def latest_n_per_key(frame: DataFrame, key: str, order_col: str, n: int) -> DataFrame:
    """The last ``n`` rows per key by ``order_col`` (unique per key).

    ``row_number() <= n`` is planned with a partial ``WindowGroupLimit``
    before the shuffle, so at most ``n`` rows per key leave each map task and
    a hot key never ships all its rows to one task.
    """
    return _top(frame, key, F.col(order_col).desc(), n)


def first_n_per_key(frame: DataFrame, key: str, order_col: str, n: int) -> DataFrame:
    """H2: the first ``n`` rows per key by ``order_col`` (unique per key)."""
    return _top(frame, key, F.col(order_col).asc(), n)


def _top(frame: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return (frame.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))
