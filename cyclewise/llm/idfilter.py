"""A bounded bitmap of ids, to leave out most rows before a join on the id.

The bitmap has ``BITS`` bits (2 MB) whatever the number of ids, so it may be broadcast;
a hit may be false, so hits still go through the join, and the more ids there are, the more rows do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

BITS = 1 << 24


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def bitmap(ids: DataFrame, column: str):
    """Broadcast variable of the bitmap of a long column."""
    p = _place(F.col(column))
    rows = ids.select((F.shiftright(p, 6)).cast("int").alias("w"), F.pmod(p, F.lit(64)).cast("int").alias("s"))
    rows = rows.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("b")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def hits(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which ``places`` (column ``place`` of ``with_place``) are set."""
    p = places.astype(np.uint64)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0


def place(column: str) -> Column:
    """The bit of an id."""
    return _place(F.col(column).cast("long")).cast("long")


def hit(bits, ids: Column) -> Column:
    """Whether the bitmap (a broadcast variable) may hold the id."""
    @F.pandas_udf(BooleanType())
    def test(places: pd.Series) -> pd.Series:
        return pd.Series(hits(bits.value, places.to_numpy()))
    return test(_place(ids).cast("long"))
