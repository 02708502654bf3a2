"""K1: repeatable incremental ingest of a landing folder.

What is new is told from a listing, before any row is read: the resume files (A3: of files of one
name the last one) whose (path, modification time, length) is not in the memory, a table beside the
stream's checkpoint.  So a file that is rewritten under its name is ingested once more, a
file that another of its name replaces is not read, and batch and stream follow one rule.  The rows of the new files go
through the idempotent ingest (M3); the memory takes the files last, so a run that dies ingests them again,
which changes nothing.

``incremental_ingest`` is a Structured Streaming query over the landing folder (nested folders included): its source
streams file names, without content, and every micro-batch of new names runs ``ingest_landing``.  ``availableNow``
processes what is there and stops; a last look at the listing then takes what was rewritten in place, which a
file source never reports.  Each log dataset is a closed file, so no event-time watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions import catalogue as cat
from ..plans.jobs import ingest_results
from ..schemas import RESUME
from ..session import written
from ..sources.resume import list_resume_files, read_listed, read_parquet

MEMORY = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
                       T.StructField("modified", T.TimestampType()), T.StructField("length", T.LongType())])
_FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_landing(spark: SparkSession, landing: str, store_root: str, memory: str, rule: str = "unified") -> int:
    """Ingest the resume files below ``landing`` that the table ``memory`` does not hold as they
    are now; returns how many."""
    seen = read_parquet(spark, memory, MEMORY)
    new = list_resume_files(spark, landing).select(*MEMORY.fieldNames()).join(seen, MEMORY.fieldNames(), "left_anti")
    new = written(new, "new-files")
    n = new.count()
    if n:
        ingest_results(spark, read_listed(spark, landing, new).select(*RESUME.fieldNames()), store_root, rule)
        new.coalesce(1).write.mode("append").parquet(memory)
    return n


def incremental_ingest(spark: SparkSession, landing: str, store_root: str,
                       checkpoint: str, rule: str = "unified") -> None:
    memory = f"{checkpoint.rstrip('/')}/files"
    names = (spark.readStream.format("binaryFile").schema(_FILES)
             .options(recursiveFileLookup=True, pathGlobFilter=cat.RESUME_FILE_GLOB).load(landing).select("path"))

    def batch(df, epoch_id):
        ingest_landing(df.sparkSession, landing, store_root, memory, rule)

    q = (names.writeStream.foreachBatch(batch)
         .option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    ingest_landing(spark, landing, store_root, memory, rule)
