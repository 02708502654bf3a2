"""Periodic run detection: stretches of words that repeat with a period, by Baier grouping.

A run is a stretch of words with smallest period q, of length ``least`` and 2q at least, that no
neighbouring word extends keeping the period.  ``lyndon.runs`` finds all of them: phase one of the suffix
sorter gives Lyndon arrays under both orders, Lyndon roots are extended to both sides.

Every word of a run of at least 12 words stands in a 6-word window that the text holds twice
(the run's length less its period is at least half its length).  So words outside such windows are in no
run and cut the text into stretches, each searched alone; nothing is missed, and plain prose
costs one sort of its window hashes.

Texts are read in Arrow batches, each document on its own and whole: one map over the scan, no shuffle.

Cases: a null or empty text has no words, no run, null run columns, and hashes of nothing; very long texts are
taken whole, in time n log n and memory linear in their words; ties for the longest run go to the smallest
start, then period; repeated rows give repeated results; a null doc_id comes back as null, and its text is left
as it stands; an empty table gives no rows; other columns are ignored, or passed through by ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclewise.llm.common import read_table
from cyclewise.llm.lyndon import runs
from cyclewise.llm.wordhash import combine, mix

#: Least length of a run, in words; the windows below rest on it.
LEAST = 12
WINDOW = LEAST // 2
RUN = "start long, length long, period long"


def _codes(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers from 0."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches covered by windows that occur more than once."""
    n = len(codes)
    if n < LEAST:
        return []
    h = combine(mix(codes.astype(np.uint64) + np.uint64(1)), WINDOW)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(inside)
    return [(a, b) for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()) if b - a >= LEAST]


def word_runs(words: list[bytes]) -> np.ndarray:
    """(start, length, period) rows of all runs of a text's words, by start, then period."""
    codes = _codes(words)
    out = []
    for a, b in _stretches(codes):
        found = runs(np.unique(codes[a:b], return_inverse=True)[1], LEAST)
        found[:, 0] += a
        out.append(found)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words are outside all runs or in a run's first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's texts: one in ten gets a periodic end, by the CRC of its id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words and runs (an array of start, length, period, by start, then period) of every row."""
    def rows(batches):
        for batch in batches:
            n, out = [], []
            for t in batch.column(1):
                words = (t.as_py() or b"").split()
                n.append(len(words))
                out.append([dict(zip(("start", "length", "period"), r)) for r in word_runs(words).tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, kind)],
                                             names=["k", "n_words", "runs"])
    kind = docs.schema[key].dataType
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(
        rows, f"k {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>")
    return out.withColumnRenamed("k", key)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each run cut to its first period; words then stand one space apart.
    Texts without a run stay as they are."""
    @F.pandas_udf("string")
    def cut(texts):
        def one(t):
            words = t.encode().split() if t is not None else []
            found = word_runs(words)
            if not len(found):
                return t
            return b" ".join(words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()).decode()
        return texts.map(one)
    return docs.withColumn(text, cut(F.col(text).cast("string")))


def _digest(doc_id: int | None, text: bytes | None) -> tuple:
    words = planted((text or b"").split(), doc_id)
    found = word_runs(words)
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in found.tolist())
    kept = words if not len(found) else [words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()]
    best = (None, None, None, None)
    if len(found):
        s, k, p = max(found.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
        best = (s, k, p, 1000 * k // p)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


_LONGS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
_TEXTS = ["runs_sha256", "collapsed_sha256"]


def _digests(batches):
    for batch in batches:
        rows = [_digest(i, t.as_py()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
        columns = [pa.array([r[k] for r in rows], pa.int64() if k < len(_LONGS) else pa.string())
                   for k in range(len(_LONGS) + len(_TEXTS))]
        yield pa.RecordBatch.from_arrays(columns, names=[*_LONGS, *_TEXTS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_digests, ", ".join([*(f"{c} long" for c in _LONGS), *(f"{c} string" for c in _TEXTS)]))
