"""Places of rows inside their groups, without a task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cyclewise.llm.common import materialise

_PART_BITS = 33  # of monotonically_increasing_id: the partition stands above them


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``idx`` (place from 0 in the group by ``order``) and ``n`` (rows of the group).

    Rows are dealt by ranges of (group, order) and sorted, so a group of any size spreads over
    tasks, and so do equal keys (the row's own number is the last key).  Counts by (task, group) give each
    piece's first place.  ``group`` holds no null; ``rows`` is a table as read, so row numbers stay the same."""
    keys = [group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _PART_BITS).alias("_part")
    pieces = dealt.groupBy(part, group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return dealt.withColumn("_part", part).join(pieces, ["_part", group]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")
