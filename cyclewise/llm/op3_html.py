"""Layout-aware HTML extraction: every page to its visible text.

Each page is parsed to a tree (implied tags, visibility) and rendered on its own, so this
is one map over the scan without a shuffle.  Pages arrive in Arrow batches.

Cells stand in the columns that row and column spans give them.  Lines of a cell with others
to its right are folded at words to 120 characters; a single longer word runs over its column.

Cases: null, empty and text-free pages give an empty text; broken markup is read as
browsers read it, but that formatting elements left open at the end of a block are not opened
again after it; very deep nesting is flattened and very long pages are read whole, their text kept; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclewise.llm.common import read_table
from cyclewise.llm.htmltree import render


def _rendered(batches):
    for batch in batches:
        texts = [render(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_lines", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text, n_lines, n_chars of every row of ``pages``."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_rendered, "page_id long, text string, n_lines long, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
