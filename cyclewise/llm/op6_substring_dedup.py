"""Substring dedup: every window of 13 words that also starts in a document with a
smaller id is removed, by super-k-mer partitioning.

A window's minimiser is the least hash of its 4-word parts.  Consecutive windows that
share a minimiser travel as one string of words (a super-k-mer) to the bucket of
that minimiser, so equal windows meet wherever they stand, and each word is sent about three
times instead of thirteen.  A task packs what it sends to a bucket into one compressed
row.  In a bucket, strings whose minimiser occurs once hold no repeated window; the windows of the others
are numbered by their whole word sequence, sorted by (window, document), and the first document of each
run is the smallest that holds it.  Comparison is by words, never by hash alone.

Beside a passage that very many documents share, every document has super-k-mers of its own with the
passage's minimisers.  A first pass counts runs by minimiser over all texts; windows of the
hottest minimisers (over ``HOT`` runs and over 1 / ``HOT_LIST`` of all, hence at most ``HOT_LIST``)
are keyed by the hash of their own words instead.  That depends on the window's words alone, so
equal windows still meet, and no key gathers more than a fixed share.

Copies that a map task sees itself are settled there: of equal super-k-mers only those of the
smallest document travel, the others are known to be removed and leave by a bucket of
their document, so a passage that a third of all documents share reaches its bucket
once a chunk, not once a document.

Cases: null, empty or short texts (under 13 words) keep all words; windows that repeat inside one document only
are kept; rows that are repeated exactly have the same id, so neither removes the other;
rows that share an id but not the text lose each its own windows, and none to the other; a null id neither
removes nor loses a word; very long texts are taken whole; an empty table gives no rows; other columns are kept if named in ``keep``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclewise.llm.common import materialise, read_table, with_own_id
from cyclewise.llm.ranks import ranked
from cyclewise.llm.wordhash import combine, joined, word_hashes

WINDOW = 13
PART = 4
CHUNK_BYTES = 16 << 20
LEVEL = 3
HOT, HOT_LIST = 512, 100_000
#: Runs of windows for which a bucket is made, about.
BUCKET_RUNS = 500_000
#: Bits for the texts under one id.
ID_BITS = 23


def _keys(words: list[bytes], hot: np.ndarray) -> np.ndarray:
    """Each window's minimiser (least part hash), or the hash of all its words
    where the minimiser is one of the sorted ``hot`` ones."""
    h = word_hashes(words)
    low = part = combine(h, PART)
    have, want = 1, WINDOW - PART + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    if len(hot):
        at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low)
        if len(at):
            # 13 = 4 + 4 + 4 + 1 words
            low[at] = joined([part[at], part[at + 4], part[at + 8], h[at + 12]])
    return low


def _runs(low: np.ndarray) -> np.ndarray:
    """First windows of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])


def _counted(batches):
    """(low, n): minimisers of two runs or more in a chunk; a null low counts all of the chunk's runs."""
    held, size = [], 0

    def rows():
        low, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n > 1
        return pa.RecordBatch.from_arrays(
            [pa.array([None, *low[keep].view(np.int64).tolist()], pa.int64()),
             pa.array([int(n.sum()), *n[keep].tolist()], pa.int64())], names=["low", "n"])

    for batch in batches:
        for text in batch.column(0):
            data = text.as_py().encode()
            words = data.split()
            size += len(data)
            if len(words) >= WINDOW:
                low = _keys(words, np.zeros(0, np.uint64))
                held.append(low[_runs(low)])
            if size >= CHUNK_BYTES and held:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def hot_minimisers(texts: DataFrame) -> np.ndarray:
    """Sorted minimisers with too many runs, at most ``HOT_LIST`` (column text)."""
    counts = texts.select("text").mapInArrow(_counted, "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(f"low is null or n >= {HOT}"), "minimisers")
    runs = counts.where("low is null").first()
    least = max(HOT, -(-(runs["n"] if runs else 0) // HOT_LIST))
    rows = counts.where((F.col("low").isNotNull()) & (F.col("n") >= least)).select("low").toPandas()
    return np.sort(rows["low"].to_numpy(np.int64).view(np.uint64)), (runs["n"] or 0) if runs else 0


class _Chunk:
    """Super-k-mers of some documents, packed by bucket."""

    def __init__(self, buckets: int, hot: np.ndarray, shift: int):
        self.buckets, self.hot, self.shift, self.size = buckets, hot, shift, 0
        self.docs, self.places, self.counts, self.lows, self.texts = [], [], [], [], []

    def add(self, doc_id: int, text: str) -> None:
        data = text.encode()
        words = data.split()
        self.size += len(data)
        if len(words) < WINDOW:
            return
        low = _keys(words, self.hot)
        first = _runs(low)
        count = np.diff(np.append(first, len(low)))
        line = b" ".join(words)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        a, b = at[first].tolist(), (at[first + count + WINDOW - 1] - 1).tolist()
        self.texts.extend([line[x:y] for x, y in zip(a, b)])
        self.docs.append(np.full(len(first), doc_id, np.int64))
        self.places.append(first.astype(np.int64))
        self.counts.append(count.astype(np.int64))
        self.lows.append(low[first])

    def rows(self):
        """(bucket, payload): bucket from 0 on for super-k-mers, under 0 for removed windows."""
        if not self.texts:
            return
        docs, places, counts, lows = (np.concatenate(x) for x in (self.docs, self.places, self.counts, self.lows))
        texts, gone, rank = self.texts, np.zeros(len(docs), bool), docs >> self.shift
        order = np.argsort(lows, kind="stable")
        same = lows[order][1:] == lows[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        least: dict[bytes, int] = {}
        for k in twice.tolist():
            d = int(rank[k])
            if least.get(texts[k], d) >= d:
                least[texts[k]] = d
        for k in twice.tolist():
            gone[k] = rank[k] > least[texts[k]]
        del least
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        bucket = ((lows >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        keep = np.flatnonzero(~gone)
        keep = keep[np.lexsort((places[keep], docs[keep], bucket[keep]))]
        for part in np.split(keep, np.flatnonzero(np.diff(bucket[keep])) + 1):
            if len(part):
                tags = (lows[part] & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                steps = np.diff(docs[part], prepend=0)
                body = b"".join([np.uint32(len(part)).tobytes(), np.ascontiguousarray(tags).tobytes(),
                                 np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(),
                                 np.ascontiguousarray(places[part].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(),
                                 b"\n".join([texts[k] for k in part.tolist()])])
                yield int(bucket[part[0]]), pack(body)
        lost = np.flatnonzero(gone)
        side = docs[lost] % self.buckets
        lost = lost[np.argsort(side, kind="stable")]
        for part in np.split(lost, np.flatnonzero(np.diff(docs[lost] % self.buckets)) + 1):
            if len(part):
                body = np.stack([docs[part], places[part], counts[part]]).astype("<i8").tobytes()
                yield -1 - int(docs[part[0]] % self.buckets), pack(body)


def _labels(spark: SparkSession, buckets: int) -> list[int]:
    """One number for each bucket, such that Spark's hash partitioning into
    ``buckets`` partitions gives every bucket a partition of its own."""
    k = F.col("id").cast("int")
    rows = spark.range(24 * buckets).select(k.alias("k"), F.pmod(F.hash(k), F.lit(buckets)).alias("p"))
    found = {r["p"]: r["k"] for r in rows.groupBy("p").agg(F.min("k").alias("k")).collect()}
    return [found.get(p, p) for p in range(buckets)]


def _super_kmers(buckets: int, labels: list[int], hot, shift: int):
    def run(batches):
        chunk = _Chunk(buckets, hot.value, shift)

        def packed():
            out = list(chunk.rows())
            return pa.RecordBatch.from_arrays(
                [pa.array([labels[b if b >= 0 else -1 - b] for b, _ in out], pa.int32()),
                 pa.array([b < 0 for b, _ in out], pa.bool_()), pa.array([x for _, x in out], pa.binary())],
                names=["bucket", "removed", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                chunk.add(doc_id.as_py(), text.as_py())
                if chunk.size >= CHUNK_BYTES:
                    yield packed()
                    chunk = _Chunk(buckets, hot.value, shift)
        yield packed()
    return run


def _unpacked(payload: bytes):
    body = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    at = 4
    tags = np.zeros((n, 4), np.uint8)
    tags[:, :3] = np.frombuffer(body, np.uint8, 3 * n, at).reshape(n, 3)
    at += 3 * n
    docs = np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8")[:, 0])
    at += 8 * n
    places = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4")[:, 0]
    return tags.view("<u4")[:, 0], docs, places.astype(np.int64), body, at + 4 * n


def _settle(payloads: list[bytes], shift: int):
    """doc, place, count of the runs of windows that a smaller document holds too."""
    seen = np.concatenate([_unpacked(p)[0] for p in payloads])
    value, n = np.unique(seen, return_counts=True)
    shared = value[n > 1]
    del seen, value, n
    docs, places, which, numbers = [], [], [], {}
    for p in payloads:
        tags, d, w, body, at = _unpacked(p)
        pick = np.flatnonzero(np.isin(tags, shared))
        if len(pick):
            texts = body[at:].split(b"\n")
            docs.append(d[pick])
            places.append(w[pick])
            which.extend([numbers.setdefault(texts[k], len(numbers)) for k in pick.tolist()])
    if not which:
        return
    docs, places, which = np.concatenate(docs), np.concatenate(places), np.array(which)
    rank = docs >> shift
    # the windows of each distinct super-k-mer, numbered by their words
    window: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in numbers:
        ends = np.flatnonzero(np.frombuffer(text + b" ", np.uint8) == 32).tolist()
        starts = [0, *(e + 1 for e in ends)]
        k = len(ends) - WINDOW + 1
        ids.extend([window.setdefault(text[starts[i]:ends[i + WINDOW - 1]], len(window)) for i in range(k)])
        lengths.append(k)
    del numbers, window
    ids, lengths = np.array(ids), np.array(lengths)
    first = np.cumsum(lengths) - lengths
    least_doc = np.full(len(lengths), np.iinfo(np.int64).max)
    np.minimum.at(least_doc, which, rank)
    by = np.lexsort((np.repeat(least_doc, lengths), ids))
    head = np.concatenate([[True], np.diff(ids[by]) != 0])
    holder = np.empty(int(ids.max()) + 1, np.int64)
    holder[ids[by][head]] = np.repeat(least_doc, lengths)[by][head]
    smallest = holder[ids]
    top, low = np.maximum.reduceat(smallest, first), np.minimum.reduceat(smallest, first)
    whole = top[which] < rank
    part = ~whole & (low[which] < rank)
    yield docs[whole], places[whole], lengths[which[whole]]
    out = []
    for k in np.flatnonzero(part).tolist():
        s = which[k]
        hit = smallest[first[s]:first[s] + lengths[s]] < rank[k]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        out.extend((docs[k], places[k] + a, b - a) for a, b in edge.reshape(-1, 2).tolist())
    if out:
        yield tuple(np.array(x, np.int64) for x in zip(*out))


def _repeats(shift: int):
    """One partition holds all of its buckets' rows."""
    def rows(docs, places, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (docs, places, counts)],
                                          names=["doc_id", "place", "n"])

    def run(batches):
        held = []
        for batch in batches:
            for removed, payload in zip(batch.column(1), batch.column(2)):
                if not removed.as_py():
                    held.append(payload.as_py())
                else:
                    yield rows(*np.frombuffer(zstandard.ZstdDecompressor().decompress(payload.as_py()), "<i8").reshape(3, -1))
        if held:
            for found in _settle(held, shift):
                yield rows(*found)
    return run


def repeated_windows(docs: DataFrame, shift: int = 0) -> DataFrame:
    """doc_id, place (0-based first window), n: runs of windows to remove.  Documents
    whose ids are equal but for the lowest ``shift`` bits do not remove from each other."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    found, runs = hot_minimisers(rows)
    # a bucket of its own partition; more of them, the more runs there are, so that each stays about as large
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs // BUCKET_RUNS))
    hot = spark.sparkContext.broadcast(found)
    sent = rows.mapInArrow(_super_kmers(buckets, _labels(spark, buckets), hot, shift),
                           "bucket int, removed boolean, payload binary")
    return sent.repartition(buckets, "bucket").mapInArrow(_repeats(shift), "doc_id long, place long, n long")


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """A text without some of its words and the separators after them; the rest stays as it stands."""
    spans = np.array([m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
    out, at = [], 0
    for a, b in edge.tolist():
        out.append(text[at:spans[a, 0]])
        at = int(spans[b, 0]) if b < len(spans) else len(text)
    return b"".join([*out, text[at:]])


def _cut(keep: list[str], layout: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, cuts in zip(batch.column("_text"), batch.column("_cuts")):
                data = (text.as_py() or "").encode()
                words, cuts = data.split(), cuts.values
                gone = np.zeros(len(words), bool)
                if cuts is not None and len(cuts):
                    at = np.minimum(cuts.field("place").to_numpy(), len(words))
                    end = np.minimum(at + cuts.field("n").to_numpy() + WINDOW - 1, len(words))
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, end, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append((_without(data, gone) if layout else
                             b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]) if gone.any() else b" ".join(words)).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=[*keep, "n_words", "n_removed", "kept_text"])
    return run


def dedup_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shift: int = 0, layout: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus n_words, n_removed and kept_text (kept words, one
    space between; with ``layout``, the text with only the removed words and the separators after them cut
    out).  Rows of equal doc_id have equal texts (see ``numbered_texts``)."""
    cuts = repeated_windows(docs, shift).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("place", "n")).alias("_cuts"))
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    joined = rows.join(cuts, "_id", "left").select(*keep, "_text", "_cuts")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return joined.mapInArrow(_cut(list(keep), layout), f"{schema}n_words long, n_removed long, kept_text string")


def numbered_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, key, text) and a shift: ``key`` is doc_id unless an id of the table stands over several texts; else the
    ids' numbers in their order, ``ID_BITS`` bits up, with the text's number among those of its id below."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashes = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"),
                                                     F.xxhash64(F.lit(1), "text").alias("b"))
    two = hashes.groupBy("id").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi"))
    if two.where("lo <> hi").isEmpty():
        return rows.withColumn("key", F.col("doc_id")), 0
    keys = ranked(materialise(hashes.distinct(), "texts"), "id", ["a", "b"], "numbered-texts")
    most = keys.agg(F.max("n")).first()[0]
    if most > 1 << ID_BITS:
        raise ValueError(f"{most} texts under one doc_id; at most {1 << ID_BITS} are told apart")
    ids = ranked(materialise(hashes.select("id", F.lit("").alias("all")).distinct(), "ids"), "all", ["id"], "numbered-ids")
    keys = keys.join(ids.select("id", F.col("idx").alias("rank")), "id")
    keys = materialise(keys.select(F.col("id").alias("doc_id"), "a", "b", (F.shiftleft("rank", ID_BITS) + F.col("idx")).alias("key")), "text-keys")
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")}).join(keys, ["doc_id", "a", "b"], "left")
    return materialise(rows.select("doc_id", "key", "text"), "numbered-rows"), ID_BITS


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed words and the separators after them; what is kept stays laid out as it was.  Documents
    that had words and keep none go.  Different texts under one id are documents of their own."""
    names = docs.columns
    plain = with_own_id(docs.select(*[F.col(c).alias(f"c_{c}") for c in names], "doc_id", "text"), "own")
    plain = plain.withColumn("doc_id", F.col("own")).drop("own")
    rows = dedup_documents(plain, tuple(f"c_{c}" for c in names), layout=True).where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    value = {c: F.col(f"c_{c}") for c in names}
    value["text"] = F.when(changed, F.col("kept_text")).otherwise(F.col("c_text"))
    if "n_chars" in value:
        value["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(F.col("c_n_chars")).cast(
            docs.schema["n_chars"].dataType)
    return rows.select(*[value[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shift = numbered_texts(read_table(spark, sf_dir, "documents"))
    rows = rows.select(F.col("doc_id").alias("id"), F.col("key").alias("doc_id"), "text")
    return dedup_documents(rows, ("id",), shift).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
held AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
hit AS (SELECT k, i FROM win JOIN held USING (g) WHERE doc_id > least),
gone AS (SELECT DISTINCT k, i + j AS p FROM hit, range(0, 13) AS r(j)),
word AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
left_ AS (SELECT word.k, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.k = gone.k AND word.p = gone.p GROUP BY word.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (k)
"""
