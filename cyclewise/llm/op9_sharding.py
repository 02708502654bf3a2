"""Sharding by proportional stratified interleaving [DataFrame functions only].

Rows of each stratum (source) are shuffled by a seeded hash and ranked; the row
of rank r among n gets the fractional rank (2r - 1) / (2n).  Sorting all rows by
fractional rank interleaves the strata in proportion, so that equal cuts of that
order hold the same mixture.  Law: ``rows`` (shard sizes at most one apart).

Ranks are found without one task per stratum or one global sort task: a table of
counts by (stratum, hash bucket) gives each bucket's first rank, and a window
ranks rows inside a bucket; the global order does the same over buckets of the
fractional rank.  Hash buckets are even by construction, so a stratum with a third of all rows is
spread over all of them; their number follows the counted rows (a power of two, some ``BUCKET_ROWS``
rows or fewer in each, ``MIN_BITS`` binary digits at least).  Only identifiers, sizes and checksums
are shuffled, never texts.

Cases: null text counts 1 byte of size and the checksum of no bytes; a null stratum is
a stratum of its own; rows that are repeated exactly get slots of their own; fewer rows than
shards leave the last cuts empty by turns; very long texts are summed whole; a null key
adds nothing to the hash of its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cyclewise.llm.common import materialise, read_table

MIN_BITS, BUCKET_ROWS = 10, 1 << 20
SEED = 20240917


def _offsets(counts: DataFrame, part: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, and of all buckets, within ``part``."""
    w = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    before = F.sum("n").over(w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*part, bucket, F.coalesce(before, F.lit(0)).alias("before"),
                         F.sum("n").over(w).alias("total"))


def _bits(n: int) -> int:
    """Binary digits of the bucket number for ``n`` rows."""
    return max(MIN_BITS, (n // BUCKET_ROWS).bit_length())


def interleave(rows: DataFrame, stratum: Column, keys: list[str], seed: int = SEED) -> DataFrame:
    """row (a struct of the columns of ``rows``), position (0-based place in the
    proportional order) and n_rows.  ``keys`` are the columns that order rows beside the hash."""
    names, bits = rows.columns, _bits(rows.count())
    buckets = 1 << bits
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    base = rows.select(*[F.col(c).alias(f"c_{c}") for c in names], F.coalesce(stratum, F.lit("")).alias("s"),
                       stratum.isNull().alias("s_null"), h.alias("h"))
    base = base.withColumn("b", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    order = [F.col(f"c_{k}") for k in keys]
    first = _offsets(base.groupBy("s", "s_null", "b").agg(F.count(F.lit(1)).alias("n")), ["s", "s_null"], "b")
    rank = F.row_number().over(W.partitionBy("s", "s_null", "b").orderBy("h", *order)) + F.col("before")
    ranked = base.join(first, ["s", "s_null", "b"]).withColumn("r", rank)
    frac = (2 * F.col("r") - 1) / (2 * F.col("total")).cast("double")
    ranked = materialise(ranked.withColumn("f", frac)
                         .withColumn("fb", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("int"))
                         .drop("b", "before", "total", "r"), "interleave")
    cuts = _offsets(ranked.groupBy("fb").agg(F.count(F.lit(1)).alias("n")), [], "fb")
    place = F.row_number().over(W.partitionBy("fb").orderBy("f", "s", "s_null", "h", *order)) + F.col("before") - 1
    return ranked.join(cuts, "fb").select(F.struct(*[F.col(f"c_{c}").alias(c) for c in names]).alias("row"),
                                          place.cast("long").alias("position"), F.col("total").alias("n_rows"))


def shard(rows: DataFrame, stratum: Column, keys: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` plus ``shard`` (0 to ``shards`` - 1) and ``slot`` (place in it),
    which replace columns of these names."""
    cut = f"(position * {shards}) div n_rows"
    first = F.expr(f"({cut} * n_rows + {shards} - 1) div {shards}")
    return interleave(rows, stratum, keys, seed).select(
        *[F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")],
        F.expr(cut).cast("int").alias("shard"), (F.col("position") - first).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", "source", (F.octet_length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"))
    out = shard(rows, F.col("source"), ["doc_id", "size", "text_crc32"], 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
