"""Best-fit packing by exact complements.

Documents longer than a sequence are cut into full pieces, the first piece holding the
remainder.  All that packing has to know of a piece is its length, so the plan is
made from the table of piece counts by length: at most ``capacity`` rows, whatever the
corpus.  From it the planner makes patterns (multisets of lengths) with a
multiplicity: first those that fill a sequence exactly, found in the sums of one,
two and three available lengths, under the available counts; then best-fit
for what is left.  Every piece is then ranked within its length, and the rank
picks its pattern, sequence and offset.

The rank is found from counts by (length, hash bucket), so that a length that many
pieces share is spread over ``BUCKETS`` tasks.

Cases: a null or empty text is one piece of the end id; repeated rows are pieces of their
own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cyclewise.llm.common import materialise, read_table
from cyclewise.llm.tokens import default_vocabulary, encoder

CAPACITY = 1024
BUCKETS = 256
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str, capacity: int):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = enc.ids_with_end(text.as_py())
                raw, n, key = memoryview(ids.astype("<u4").tobytes()), len(ids), doc_id.as_py()
                first = n % capacity or capacity
                for k, end in enumerate(range(first, n + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    rows.append((key, k, start, end - start, zlib.crc32(raw[4 * start:4 * end])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                                 pa.int64()])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids of the documents (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(vocabulary or default_vocabulary(), capacity), PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their multiplicities that use up ``counts`` (length to number)."""
    c = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        c[length] = n
    done: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        """Take the pattern as often as the counts allow."""
        each = {x: pattern.count(x) for x in pattern}
        m = min(int(c[x]) // k for x, k in each.items())
        if m > 0:
            for x, k in each.items():
                c[x] -= m * k
            done.append((pattern, m))

    def pairs(gap: int, most: int) -> list[tuple[int, int]]:
        """Available a >= b >= 1 with a + b = gap and a <= most, largest a first."""
        a = np.arange(min(most, gap - 1), (gap + 1) // 2 - 1, -1)
        a = a[(c[a] > 0) & (c[gap - a] > 0)] if len(a) else a
        return [(int(x), int(gap - x)) for x in a]

    use((capacity,))
    for x in range(capacity - 1, 0, -1):
        if c[x] and capacity - x <= x:
            use((x, capacity - x))
    for x in range(capacity - 2, 0, -1):
        for a, b in pairs(capacity - x, x) if c[x] else []:
            if not c[x]:
                break
            use((x, a, b))
    for x in range(capacity - 3, 0, -1):
        for a in range(min(x, capacity - x - 2), 0, -1):
            if not c[x]:
                break
            if c[a]:
                for b, d in pairs(capacity - x - a, a):
                    use((x, a, b, d))
    while c.any():
        x = int(np.flatnonzero(c)[-1])
        pattern, gap = [x], capacity - x
        left = c.copy()
        left[x] -= 1
        while gap and (fit := np.flatnonzero(left[:gap + 1])).size:
            pattern.append(int(fit[-1]))
            left[pattern[-1]] -= 1
            gap -= pattern[-1]
        use(tuple(pattern))
    return done


def _ranges(patterns: list[tuple[tuple[int, ...], int]], capacity: int):
    """Per length, the ranks from ``lo`` on and the first sequence and the offset
    of their run; sorted by (length, lo)."""
    used, rows, first = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for pattern, m in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, int(used[x]), first, offset))
            used[x] += m
            offset += x
        first += m
    rows.sort()
    return [np.array(col, dtype=np.int64) for col in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 4


def _placed(table, names):
    length, lo, first, offset = table
    key = (length << 44) + lo

    def run(batches):
        for batch in batches:
            n, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (batch.schema.get_field_index("length"),
                                                                          batch.schema.get_field_index("_rank")))
            at = np.searchsorted(key, (n << 44) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(first[at] + r - lo[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])
    return run


def pack(rows: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and
    ``offset``.  ``keys`` spread and order rows of one length.  What the driver and
    every task hold is the plan: it is made from at most ``capacity`` counts."""
    bucket = F.shiftrightunsigned(F.xxhash64(*keys), 56).cast("int").alias("_b")
    names, rows = rows.columns, rows.select("*", bucket)
    by_bucket = materialise(rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = _ranges(plan(counts, capacity), capacity)
    prior = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    first = by_bucket.select("length", "_b", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy(*keys)) - 1 + F.col("_before")
    ranked = rows.join(first, ["length", "_b"]).select(*names, rank.cast("long").alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_b")
    return ranked.mapInArrow(_placed(table, names), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    cut = materialise(pieces(docs, capacity, vocabulary), "pieces")
    return pack(cut, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
