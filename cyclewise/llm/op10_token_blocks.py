"""Token ids of all documents in patched frame-of-reference files (``pfor``).

Documents are range-partitioned and sorted by id; each task turns its range into
segment images of about ``SEGMENT_IDS`` ids, one row an image, in a Parquet table
that Spark's own writer commits (so a lost executor leaves no half file, and any
shared store will do).  Reading takes each image on its own; an id's place in the whole
corpus is the sum of the images before it: a window within each range plus a
window over one total a range.

Cases: a null or empty text holds the end id alone; documents of one id that stand
in several rows keep a place each, ordered by text; a long text may make its segment longer than
``SEGMENT_IDS`` (a document is never split); an empty table gives an empty table of segments;
rows without a doc_id come first, in segments of their own, and come back without one; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cyclewise.llm import pfor
from cyclewise.llm.common import read_table
from cyclewise.llm.tokens import default_vocabulary, encoder
from cyclewise.session import ensure_checkpoint_dir

SEGMENT_IDS = 1 << 20
SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_ids long, no_id boolean, image binary"


def _segments(vocabulary: str, segment_ids: int):
    def run(batches):
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        docs, held, total, seq, no_id = [], [], 0, 0, False

        def image():
            data = pfor.encode(np.array(docs, dtype=np.int64), np.array([len(x) for x in held], dtype=np.uint32),
                               np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([no_id], pa.bool_()), pa.array([data], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "no_id", "image"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids, key = enc.ids_with_end(text.as_py()), doc_id.as_py()
                if docs and no_id != (key is None):
                    yield image()
                    docs, held, total, seq = [], [], 0, seq + 1
                no_id = key is None
                docs.append(key or 0)
                held.append(ids)
                total += len(ids)
                if total >= segment_ids:
                    yield image()
                    docs, held, total, seq = [], [], 0, seq + 1
        if docs:
            yield image()
    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None,
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Write ``docs`` (doc_id, text) to a table of segment images at ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(vocabulary or default_vocabulary(), segment_ids), SEGMENT_SCHEMA).write.option(
        "compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """``before``: ids in all segments before each."""
    heads = read_segments(spark, path).select("part", "seq", "n_ids")
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    across = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_part").over(across), F.lit(0)).alias("part_before"))
    return heads.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("part_before") + F.col("in_part")).alias("before"))


def _decoded(batches):
    for batch in batches:
        for part, seq, no_id, image in zip(*(batch.column(k) for k in range(4))):
            doc_ids, counts, ids = pfor.decode(image.as_py())
            ends = np.cumsum(counts.astype(np.int64))
            starts = ends - counts
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()),
                 pa.nulls(n, pa.int64()) if no_id.as_py() else pa.array(doc_ids.astype(np.int64)), pa.array(starts), pa.array(counts.astype(np.int64)),
                 pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: its place in the corpus, its number of ids and
    their checksum, decoded from the images."""
    docs = read_segments(spark, path).select("part", "seq", "no_id", "image").mapInArrow(
        _decoded, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(segment_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/tokens-{uuid.uuid4().hex[:12]}"
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
