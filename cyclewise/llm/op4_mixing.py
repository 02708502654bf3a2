"""Mixing sources to target weights by temperature [DataFrame functions only].

Source token shares p are raised to an exponent a and normalised.  a lies in
[0, 1] (1: as found, 0: all alike) and is bisected until the mixture meets a
target: an entropy, or a limit on how often the most repeated source is read.  Each job
tries 15 exponents at once, which makes four steps of the bisection.

The token budget is either given or the least one that reads every source once
(no document is lost).  A source whose budget is r times its tokens is read
in floor(r) whole passes and one partial pass.  Every pass is its own permutation: rows
are ordered by a hash seeded with the pass, in ``BLOCKS`` hash blocks.  The partial pass
takes the blocks, then the rows of one block, whose running token count stays in
budget; only the table of block sums and the rows of that block meet a window.
Tokens are counted as words.

Cases: a null source is a source of its own; sources without tokens get weight 0 and are read
once when the budget covers all; null and empty texts have 0 tokens; rows that are repeated exactly
are mixed together; one source, or none with tokens, gets exponent 1; an
empty table gives no rows.  Other columns are kept as they are,
but for those named like an added one, which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cyclewise.llm.common import materialise, n_words, read_table

BLOCKS = 1024
SEED = 71
MAX_REPEAT = 2.0
STEPS = 8


@dataclass(frozen=True)
class Target:
    """Entropy of the mixture in nats, or the limit of reads of any source."""
    entropy: float | None = None
    max_repeat: float | None = MAX_REPEAT


def _exponent(sources: DataFrame, target: Target, budget: int | None) -> tuple[float, dict]:
    """The exponent that meets the target; the sums it needs of the source table.
    Only scalars come to the driver."""
    live = sources.where("tokens > 0")
    one = live.agg(F.sum("tokens").alias("all"), F.min("tokens").alias("least"), F.max("tokens").alias("most"),
                   F.count(F.lit(1)).alias("n")).first().asDict()
    if not one["n"] or one["n"] == 1:
        return 1.0, one
    p = F.col("tokens") / F.lit(float(one["all"]))

    def flat_enough(a: float, z: float, plogp: float) -> bool:
        """True if the mixture may be made flatter than at ``a``."""
        if target.entropy is not None:
            return math.log(z) - a * plogp / z < target.entropy
        scale = one["most"] ** (1 - a) if budget is None else budget / z * one["all"] ** (-a)
        return scale * one["least"] ** (a - 1) <= target.max_repeat

    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        tries = [lo + (hi - lo) * k / 16 for k in range(1, 16)]
        got = live.agg(*[e for k, a in enumerate(tries) for e in (
            F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{k}"))]).first()
        for k, a in enumerate(tries):
            if flat_enough(a, got[f"z{k}"], got[f"s{k}"]):
                hi = a
                break
            lo = a
    return hi, one


def weights(sources: DataFrame, target: Target = Target(), budget: int | None = None) -> DataFrame:
    """``sources`` (source, tokens) plus weight, reads (passes, with a fraction),
    whole (full passes) and partial (tokens of the partial pass)."""
    a, one = _exponent(sources, target, budget)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    total = float(budget) if budget is not None else z * float(one["most"] or 0) ** (1 - a)
    reads = F.when(F.col("tokens") > 0, F.lit(total) * F.col("weight") / F.col("tokens"))
    reads = reads.otherwise(F.lit(1.0 if budget is None else 0.0))
    near = F.round("reads")
    return (sources.withColumn("weight", power / F.lit(z)).withColumn("reads", reads)
            .withColumn("reads", F.when(F.abs(F.col("reads") - near) < 1e-9, near).otherwise(F.col("reads")))
            .withColumn("whole", F.floor("reads").cast("long"))
            .withColumn("partial", F.floor((F.col("reads") - F.col("whole")) * F.col("tokens")).cast("long")))


def _order(pass_no: Column, keys: list[str]) -> Column:
    return F.xxhash64(F.lit(SEED), pass_no, *[F.col(k) for k in keys])


def _block(h: Column) -> Column:
    return F.shiftrightunsigned(h, 54).cast("int")


def mix(rows: DataFrame, keys: list[str], target: Target = Target(), budget: int | None = None) -> DataFrame:
    """``rows`` (with ``source``) once for each read, plus ``mix_tokens``,
    ``mix_weight``, ``mix_pass``, ``mix_block`` and ``mix_order``: sorted by the
    last, the sources are interleaved at their weights.  Whole rows are never shuffled,
    but for the join with the table of sources where that is large."""
    names = rows.columns
    h_part = _order(F.col("x_whole"), ["x_" + k for k in keys])
    slim = rows.select(F.coalesce("source", F.lit("")).alias("x_source"), F.col("source").isNull().alias("x_null"),
                       n_words(F.col("text")).alias("x_tokens"), *[F.col(k).alias("x_" + k) for k in keys])
    slim = materialise(slim, "mix-rows")
    sources = materialise(slim.groupBy("x_source", "x_null").agg(F.sum("x_tokens").alias("tokens")), "mix-sources")
    w = materialise(weights(sources, target, budget).select(
        "x_source", "x_null", F.col("weight").alias("x_weight"), F.col("reads").alias("x_reads"),
        F.col("whole").alias("x_whole"), F.col("partial").alias("x_partial")), "mix-weights")

    src = ["x_source", "x_null"]
    cand = slim.join(w.where("x_partial > 0"), src).withColumn("h", h_part).withColumn("b", _block(F.col("h")))
    prior = W.partitionBy(*src).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = cand.groupBy(*src, "b", "x_partial").agg(F.sum("x_tokens").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    # the first block whose running sum passes the budget; none if the blocks all fit
    edge = sums.where(F.col("before") + F.col("n") > F.col("x_partial")).groupBy(*src).agg(
        F.min(F.struct("b", "before")).alias("edge")).select(*src, F.col("edge.b").alias("b"),
                                                              F.col("edge.before").alias("before"))
    inner = cand.join(edge, [*src, "b"])
    x_keys = ["x_" + k for k in keys]
    run = F.sum("x_tokens").over(W.partitionBy(*src).orderBy("h", *x_keys).rowsBetween(W.unboundedPreceding, 0))
    last = inner.withColumn("run", run + F.col("before")).where(F.col("run") <= F.col("x_partial")).groupBy(*src).agg(
        F.max("h").alias("x_last"))
    # rows up to the last one that fits; a block that starts past the budget ends at the block before it
    cut = w.join(edge.select(*src, F.col("b").alias("x_edge")), src, "left").join(last, src, "left")
    cut = materialise(cut, "mix-cuts")

    plain = rows.select(*[F.col(c).alias("c_" + c) for c in names], F.coalesce("source", F.lit("")).alias("x_source"),
                        F.col("source").isNull().alias("x_null"))
    c_keys = ["c_" + k for k in keys]
    h = _order(F.col("x_whole"), c_keys)
    taken = F.when(F.col("x_partial") <= 0, F.lit(False)).when(F.col("x_edge").isNull(), F.lit(True)).otherwise(
        (_block(h) < F.col("x_edge")) | ((_block(h) == F.col("x_edge"))
                                         & F.coalesce(h <= F.col("x_last"), F.lit(False))))
    passes = F.col("x_whole") + taken.cast("long")
    each = plain.join(cut, src).where(passes > 0).withColumn(
        "x_pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    h_pass = _order(F.col("x_pass"), c_keys)
    unit = (F.shiftrightunsigned(h_pass, 11).cast("double")) / F.lit(float(2**53))
    added = {"mix_tokens": n_words(F.col("c_text")), "mix_weight": F.col("x_weight"), "mix_pass": F.col("x_pass"),
             "mix_block": _block(h_pass), "mix_order": (F.col("x_pass") + unit) / F.col("x_reads")}
    return each.select(*[F.col("c_" + c).alias(c) for c in names if c not in added],
                       *[v.alias(c) for c, v in added.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, ["doc_id"]).select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"),
        F.col("mix_pass").alias("pass"), F.col("mix_block").alias("block"), F.col("mix_order").alias("order_key"))
