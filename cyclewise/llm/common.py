"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cyclewise.session import ensure_checkpoint_dir

#: Separators of words: space and 0x09-0x0D, nothing else.
SEPARATORS = " \t\n\x0b\x0c\r"
SEP_REGEX = r"[ \t-\r]+"
WORD_REGEX = r"[^ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder of
    ``spark.checkpoint.dir`` and read it back: later steps neither recompute it
    nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for made in _scopes.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialise`` makes inside are deleted at the end, so what is
    returned must not read them: write it outside, or with ``keep``, which this yields."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        made.pop()  # an outer scope, if there is one, still deletes it
        return out

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_own_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus a long column ``name`` that only rows of equal doc_id and text share, in the
    order of the ids: doc_id itself, unless an id of the table stands over several texts.  Null ids stay null."""
    text = F.col("text").cast("string")
    one = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    one = one.where("id is not null")
    texts = one.groupBy("id").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi"))
    if texts.where("lo <> hi").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    # a sort by ranges of (id, text): the numbers of the rows rise with the ids
    keys = one.distinct().orderBy("id", "a", "b").select("id", "a", "b", F.monotonically_increasing_id().alias("own"))
    keys = materialise(keys, "own-ids").alias("k")
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"d_{c}") for c in names], F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = rows.join(keys, ["id", "a", "b"], "left")
    return materialise(rows.select(*[F.col(f"d_{c}").alias(c) for c in names], F.col("own").alias(name)), "own-id-rows")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEP_REGEX), lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)
