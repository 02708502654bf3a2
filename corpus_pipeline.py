"""Corpus pipeline over the ``documents`` table: five stages, in order.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns rows with the columns of ``docs``; the last returns the packed pieces.  A missing
``lang``, ``n_chars`` or other column is no matter; ``doc_id``, ``text`` and ``source`` are needed.

Cases: null and empty texts go in the first stage; repeated rows (same id and text) count
as one document from the second stage on; ties between copies go to the smallest id; an empty table
passes through every stage; names of extra columns may be any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclewise.llm import op1_jaccard_join, op2_quality_rules, op4_mixing, op6_substring_dedup, op8_packing
from cyclewise.llm.common import materialise, read_table

#: Near copies: word shingles of this length, this similarity in per cent.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines above the frequency limit."""
    return op2_quality_rules.clean(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents."""
    return op1_jaccard_join.keep_first(docs, SHINGLE, PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that a smaller id holds; those left without a word go."""
    return op6_substring_dedup.clean(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often: sources at their target weights."""
    return op4_mixing.mix(docs, ["doc_id"]).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids in as few sequences as possible."""
    return op8_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hash orders and token ids of the last two stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written as
    Parquet in the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
